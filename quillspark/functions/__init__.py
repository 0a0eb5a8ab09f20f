"""Column functions: text, numbers, labels."""
