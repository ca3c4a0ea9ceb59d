"""Selectors: from JSON to a tree in which negation stands at the leaves.

Two negations differ. At the top, negation moves inward by De Morgan's laws to a field's condition, which then still asks that the field
exists. In the bodies of $elemMatch, $allMatch and $keyMapMatch it stays where it is and is the plain complement.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.paths import SelectorError, parse_field


@dataclass(frozen=True)
class Every:
    """Matches all documents."""


@dataclass(frozen=True)
class Group:
    """op: and, or, nor; without parts all three are true."""

    op: str
    parts: tuple


@dataclass(frozen=True)
class Complement:
    part: object


@dataclass(frozen=True)
class Test:
    """A condition on a path; negated asks for existence and the condition's failure."""

    path: tuple[str, ...]
    op: str
    arg: object
    negated: bool = False


OPPOSITE = {"lt": "gte", "gte": "lt", "lte": "gt", "gt": "lte", "eq": "ne", "ne": "eq", "in": "nin", "nin": "in"}
#: Operators that are known but need what a selector doesn't have.
UNSUPPORTED = frozenset("$text $default $where $geoWithin $geoIntersects $near $nearSphere".split())
_JAVA_ONLY = re.compile(r"\(\?<?[=!]|\(\?>|\\[1-9]|\\k|\(\?P=|[*+?}]\+")


def _is_int(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and -(2**63) <= v < 2**63


def _need(ok: bool, op: str, what: str) -> None:
    if not ok:
        raise SelectorError(f"{op} requires {what}")


def java_regex(pattern: str) -> str:
    """An unanchored search by Java's engine that reads the pattern as linear-time engines do: no look-around or back-references, Unicode classes, $ at the very end only."""
    if _JAVA_ONLY.search(pattern.replace("\\\\", "")):
        raise SelectorError("invalid $regex: look-around, back-references and possessive repetition aren't supported")
    try:
        re.compile(re.sub(r"\\[pP]\{[^}]*\}|\\[pP][A-Z]|\\z", "x", pattern))
    except re.error as e:
        raise SelectorError(f"invalid $regex: {e}") from e
    out, at, inside = [], 0, False
    multiline = re.match(r"\(\?[a-z]*m", pattern)
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(r"\z" if c == "$" and not inside and not multiline else c)
        at += 1
    return "(?dU)" + "".join(out)


def _body(value: object, op: str):
    _need(isinstance(value, dict), op, "an object argument")
    return _read(value, ())


def _argument(op: str, value: object) -> object:
    name = "$" + op
    if op in ("in", "nin", "all"):
        _need(isinstance(value, list), name, "an array argument")
    elif op == "exists":
        _need(isinstance(value, bool), name, "a boolean argument")
    elif op in ("type", "beginsWith", "regex"):
        _need(isinstance(value, str), name, "a string argument")
        return java_regex(value) if op == "regex" else value
    elif op == "size":
        _need(_is_int(value) and value >= 0, name, "a non-negative integer")
    elif op == "mod":
        _need(isinstance(value, list) and len(value) == 2 and all(map(_is_int, value)), name, "[Divisor, Remainder] integers")
    elif op in ("elemMatch", "allMatch", "keyMapMatch"):
        return _body(value, name)
    elif op not in ("lt", "lte", "eq", "ne", "gte", "gt"):
        raise SelectorError(f"{name} is not supported" if name in UNSUPPORTED else f"invalid operator: {name}")
    return value


def _read_pair(key: str, value: object, path: tuple[str, ...]):
    if not key.startswith("$"):
        return _read(value, path + parse_field(key))
    if key in ("$and", "$or", "$nor"):
        _need(isinstance(value, list), key, "an array argument")
        return Group(key[1:], tuple(_read(v, path) for v in value))
    if key == "$not":
        _need(isinstance(value, dict), key, "an object argument")
        return Complement(_read(value, path))
    return Test(path, key[1:], _argument(key[1:], value))


def _read(value: object, path: tuple[str, ...]):
    if not isinstance(value, dict) or not value:
        return Test(path, "eq", value)
    parts = tuple(_read_pair(k, v, path) for k, v in value.items())
    return parts[0] if len(parts) == 1 else Group("and", parts)


def _inward(node, negative: bool = False):
    if isinstance(node, Complement):
        return _inward(node.part, not negative)
    if isinstance(node, Group):
        # nor is "and" of failures; failing turns and into or, and the other way round
        failed = negative != (node.op == "nor")
        op = "and" if (node.op == "or") == failed else "or"
        if node.op == "nor":
            op = "or" if negative else "and"
        return Group(op, tuple(_inward(p, failed) for p in node.parts))
    if not negative:
        return node
    if node.op == "exists":
        return Test(node.path, "exists", not node.arg)
    if node.op in OPPOSITE:
        return Test(node.path, OPPOSITE[node.op], node.arg)
    return Test(node.path, node.op, node.arg, negated=True)


def parse_selector(selector: object):
    """The tree of a selector; SelectorError if there is none."""
    if not isinstance(selector, dict):
        raise SelectorError("selector must be a JSON object")
    if not selector:
        return Every()
    node = _inward(_read(selector, ()))
    if isinstance(node, Test) and not node.path:
        raise SelectorError("operator or bare value where a field name is expected")
    return node
