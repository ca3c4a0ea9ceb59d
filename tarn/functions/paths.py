"""Dotted field names."""

from __future__ import annotations


class SelectorError(ValueError):
    """A selector, sort, index or query that can't be compiled."""


def parse_field(name: str) -> tuple[str, ...]:
    """Segments of a dotted name; a backslash makes a dot literal and goes itself."""
    segments, now, escaped = [], "", False
    for c in name:
        if c == "\\":
            escaped = not escaped
            continue
        if c == "." and not escaped:
            segments.append(now)
            now = ""
        else:
            now += c
        escaped = False
    segments.append(now)
    if not all(segments):
        raise SelectorError(f"invalid field name: {name}")
    return tuple(segments)


def nest(pairs: list[tuple[tuple[str, ...], object]]) -> dict:
    """A tree of dicts with the given leaves; of equal paths the last stays."""
    tree: dict = {}
    for path, leaf in pairs:
        at = tree
        for s in path[:-1]:
            if not isinstance(at.get(s), dict):
                at[s] = {}
            at = at[s]
        at[path[-1]] = leaf
    return tree
