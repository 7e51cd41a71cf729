"""Sources of script analytics."""
