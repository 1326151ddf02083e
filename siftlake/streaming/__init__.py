"""Structured Streaming versions of windowed detections, sessions, freshness and de-duplication."""
