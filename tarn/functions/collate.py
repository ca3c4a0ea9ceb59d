"""Collation of JSON values: null, false, true, numbers, strings, arrays, objects; strings by code point, arrays and objects by their parts in order."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = {"null": 0, "boolean": 1, "number": 3, "string": 4, "array": 5, "object": 6}


def kind(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list | tuple) else "object"


def rank(v: object) -> int:
    return 1 + v if isinstance(v, bool) else RANKS[kind(v)]


def sort_key(v: object) -> bytes:
    """Bytes whose order is the collation."""
    head = bytes([rank(v) + 1])
    if isinstance(v, bool) or v is None:
        return head
    if isinstance(v, int | float):
        (bits,) = struct.unpack(">Q", struct.pack(">d", float(v) + 0.0))
        return head + struct.pack(">Q", bits ^ (2**64 - 1) if bits >> 63 else bits | 1 << 63)
    if isinstance(v, str):
        return head + v.encode("utf-8", "surrogatepass").replace(b"\0", b"\0\xff") + b"\0\0"
    parts = v if isinstance(v, list | tuple) else [x for pair in v.items() for x in pair]
    return head + b"".join(map(sort_key, parts)) + b"\0"


@F.pandas_udf(T.BinaryType())
def sort_key_of(texts: pd.Series) -> pd.Series:
    """sort_key of JSON texts; for ordering arrays and objects, which SQL can't compare across types."""
    return texts.map(lambda s: None if s is None else sort_key(json.loads(s)))
