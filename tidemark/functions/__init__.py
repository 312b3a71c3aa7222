"""Column expressions: time, values and object patterns."""
