"""Rectangles on the globe (west, south, east, north in degrees) and the cells of a quadtree that hold them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 24
#: The key of what has no valid rectangle; every search includes it.
JUNK = "4"


@dataclass(frozen=True)
class Rect:
    w: float
    s: float
    e: float
    n: float

    def valid(self) -> bool:
        return self.w <= self.e and self.s <= self.n

    def in_world(self) -> bool:
        return self.w >= -180 and self.e <= 180 and self.s >= -90 and self.n <= 90

    def intersects(self, o: Rect) -> bool:
        return self.w <= o.e and o.w <= self.e and self.s <= o.n and o.s <= self.n

    def contains(self, o: Rect) -> bool:
        return self.w <= o.w and o.e <= self.e and self.s <= o.s and o.n <= self.n


def cell(key: str) -> Rect:
    """The cell of a key: each digit halves it, east adds 1 and north adds 2."""
    w, s, e, n = -180.0, -90.0, 180.0, 90.0
    for d in key:
        x, y = (w + e) / 2, (s + n) / 2
        w, e = (x, e) if d in "13" else (w, x)
        s, n = (y, n) if d in "23" else (s, y)
    return Rect(w, s, e, n)


def quadkey(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Key of the smallest cell, LEVELS deep at most, that holds a rectangle; JUNK for none. A low half is open at its upper edge."""
    world = F.struct(F.lit(-180.0).alias("w"), F.lit(-90.0).alias("s"), F.lit(180.0).alias("e"), F.lit(90.0).alias("n"), F.lit("").alias("k"), F.lit(False).alias("done"))

    def halve(a: Column, _: Column) -> Column:
        x, y = (a["w"] + a["e"]) / 2, (a["s"] + a["n"]) / 2
        east, north = w >= x, s >= y
        fits = (east | (e < x)) & (north | (n < y)) & ~a["done"]
        digit = (F.when(east, 1).otherwise(0) + F.when(north, 2).otherwise(0)).cast("string")
        keep = lambda now, new: F.when(fits, new).otherwise(now)
        return F.struct(
            keep(a["w"], F.when(east, x).otherwise(a["w"])).alias("w"),
            keep(a["s"], F.when(north, y).otherwise(a["s"])).alias("s"),
            keep(a["e"], F.when(east, a["e"]).otherwise(x)).alias("e"),
            keep(a["n"], F.when(north, a["n"]).otherwise(y)).alias("n"),
            keep(a["k"], F.concat(a["k"], digit)).alias("k"),
            (~fits).alias("done"),
        )

    sound = (w <= e) & (s <= n) & (w >= -180) & (e <= 180) & (s >= -90) & (n <= 90)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), world, halve)["k"]
    return F.when(F.coalesce(sound, F.lit(False)), found).otherwise(F.lit(JUNK))


def covering(q: Rect, cells: int = 64) -> tuple[list[str], list[str]]:
    """(subtrees, keys): prefixes whose subtrees, and single keys, that together hold the key of every rectangle which meets q."""
    keys, todo = [], [""]
    while todo and len(todo) + 3 <= cells:
        k = min(todo, key=len)
        if len(k) >= LEVELS or q.contains(cell(k)):
            break
        todo.remove(k)
        keys.append(k)
        todo += [k + d for d in "0123" if cell(k + d).intersects(q)]
    return sorted(todo), [*sorted(keys), JUNK]


def covering_condition(key: Column, q: Rect, stored: bool = True) -> Column:
    """Whether a key may belong to a rectangle that meets q. stored: as prefix ranges and a short list, which prune sorted files; else as one pattern, which computes key only once."""
    subtrees, keys = covering(q)
    if not stored:
        return key.rlike("^(?:" + "|".join([*(k + "[0-3]*" for k in subtrees), *keys]) + ")$")
    out = key.isin(keys)
    for k in subtrees:
        out = out | ((key >= k) & (key < k + "~")) if k else F.lit(True)
    return out
