"""Column expressions: geometry measures, geodesy, value parsing, naming and text encodings."""
