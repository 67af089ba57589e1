"""Column functions and small Python helpers."""
