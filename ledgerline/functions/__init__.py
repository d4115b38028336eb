"""Column functions: periods, text, numbers and hashes."""
