"""Functions of script analytics."""
