"""Column functions: classification, formatting and paths."""
