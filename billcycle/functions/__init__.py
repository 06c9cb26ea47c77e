"""Column and row helpers shared by the operators."""
