"""Structured Streaming jobs over collector telemetry."""
