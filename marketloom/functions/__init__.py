"""Column functions and small parameter tables."""
