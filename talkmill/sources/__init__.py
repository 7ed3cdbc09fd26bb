"""Readers of chat logs and writers of hand-off packages."""
