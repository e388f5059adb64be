"""Structured Streaming: live request status and incremental context refresh."""
