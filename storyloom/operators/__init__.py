"""Operators of script analytics."""
