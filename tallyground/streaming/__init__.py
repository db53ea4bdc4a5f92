"""The incremental update and the daily counts as Structured Streaming jobs."""
