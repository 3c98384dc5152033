"""Column functions: string helpers and the fixed patterns of prescriptions."""
