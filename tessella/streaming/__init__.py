"""Streams: the engine's batch operators applied to each micro-batch of a Structured Streaming query."""
