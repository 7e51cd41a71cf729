"""Plans of script analytics."""
