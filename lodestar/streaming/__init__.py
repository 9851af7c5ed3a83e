"""Budget managers and stream strategies, in batch and as Structured Streaming."""
