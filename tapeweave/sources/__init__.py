"""Readers, writers, wire formats and table schemas."""
