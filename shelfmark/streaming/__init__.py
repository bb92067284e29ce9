"""Structured Streaming: new pages and records as they arrive."""
