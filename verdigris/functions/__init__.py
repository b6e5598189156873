"""Column expressions and session helpers shared by the operators."""
