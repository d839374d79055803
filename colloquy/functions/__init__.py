"""functions of the conversation analytics engine."""
