"""Declarative document recipes, the project catalog and their table columns."""
