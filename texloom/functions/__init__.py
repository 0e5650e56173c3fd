"""Column functions that operators are made of."""
