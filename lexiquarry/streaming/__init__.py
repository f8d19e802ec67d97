"""Structured Streaming twins of the state folds and rate windows: an extension, each with a batch query that must agree once the stream is drained."""
