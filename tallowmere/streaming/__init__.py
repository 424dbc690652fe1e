"""Incremental runs over new events."""
