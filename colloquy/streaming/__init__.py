"""streaming of the conversation analytics engine."""
