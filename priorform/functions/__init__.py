"""Column-to-column helpers; all of them stay in built-in expressions."""
