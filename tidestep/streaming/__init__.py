"""State machines over Structured Streaming."""
