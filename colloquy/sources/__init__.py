"""sources of the conversation analytics engine."""
