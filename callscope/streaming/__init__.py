"""Structured Streaming forms of the per-call smoothing and first-hit operators."""
