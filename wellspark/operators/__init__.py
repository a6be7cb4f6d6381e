"""Relational operators: list folding, regrouping, nesting, id filters, curves and outlines."""
