"""Streaming of script analytics."""
