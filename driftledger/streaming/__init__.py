"""Structured Streaming counterparts of the incremental and history operators."""
