"""Column expressions: headers, sub-specifications, bit fields, names, parameters."""
