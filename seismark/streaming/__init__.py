"""Online scoring with Structured Streaming."""
