"""Conversation analytics on Spark: DataFrame-first operators for chat and catalogue data."""

__version__ = "0.1.0"
