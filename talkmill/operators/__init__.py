"""Relational operators over sessions, messages, links and vectors."""
