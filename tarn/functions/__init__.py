"""Paths, collation, rectangles, filters and message bodies."""
