"""Helpers that define values: columns of cells, identifiers, key encodings."""
