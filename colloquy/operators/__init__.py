"""operators of the conversation analytics engine."""
