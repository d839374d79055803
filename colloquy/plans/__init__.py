"""plans of the conversation analytics engine."""
