"""Structured Streaming versions of the weekly counts, the forecast and de-duplication."""
