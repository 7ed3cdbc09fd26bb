"""Conversation-memory analytics on Spark: tables in, DataFrames out."""
