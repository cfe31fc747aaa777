"""Structured Streaming versions of moderation and progress counts."""
