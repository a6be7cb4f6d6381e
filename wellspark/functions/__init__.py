"""Column functions: cleaning, typing, text, WKT and binary helpers. All return Columns."""
