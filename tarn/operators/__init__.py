"""Operators on collections: selector matching, find, revisions, writes."""
