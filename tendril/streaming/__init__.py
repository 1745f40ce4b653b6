"""Structured Streaming jobs (re-aimed from the source triggers)."""
