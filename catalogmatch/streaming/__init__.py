"""Incremental versions of sync and feedback statistics."""
