"""Column builders: element-wise functions with array-library edge rules."""
