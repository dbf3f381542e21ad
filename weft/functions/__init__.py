"""Column functions: paths and names, text operators, scalar kinds, hashes."""
