"""Operators: row mode (Column to Column) and column mode (DataFrame to DataFrame)."""
