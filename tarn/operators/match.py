"""Selector trees as boolean columns: over typed columns, where Catalyst can push the result into the scan, and over one VARIANT column."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.collate import RANKS, kind, rank
from ..plans.selector import Complement, Every, Group, Test, parse_selector

#: A condition is a column, or a bool known when the selector is compiled.
Cond = Column | bool
_ORDER = {
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gte": lambda a, b: a >= b,
    "gt": lambda a, b: a > b,
}


def both(*parts: Cond) -> Cond:
    out: Cond = True
    for p in parts:
        out = p if out is True else out if p is True else False if p is False or out is False else out & p
    return out


def either(*parts: Cond) -> Cond:
    out: Cond = False
    for p in parts:
        out = p if out is False else out if p is False else True if p is True or out is True else out | p
    return out


def fails(p: Cond) -> Cond:
    return not p if isinstance(p, bool) else ~F.coalesce(p, F.lit(False))


def as_column(p: Cond) -> Column:
    return F.lit(p) if isinstance(p, bool) else p


class Typed:
    """A value with a static type. With nulls="missing" SQL NULL is an absent path, as to_json reads it; with "null" it is a JSON null."""

    def __init__(self, col: Column | None, dtype: T.DataType, nulls: str, exists: Cond | None = None, within: str | None = None):
        """within: what NULL is in the fields of the value, if not what it is for the value itself; a NULL element of an array is always a JSON null."""
        self.col, self.dtype, self.nulls, self.within = col, dtype, nulls, within or nulls
        self.exists: Cond = exists if exists is not None else (col.isNotNull() if nulls == "missing" else True)
        self.known = kind_of(dtype)

    def _child(self, col: Column, dtype: T.DataType, there: Cond) -> Typed:
        return Typed(col, dtype, self.within, None if self.within == "missing" else there)

    def _element(self, col: Column) -> Typed:
        return Typed(col, self.dtype.elementType, "null", within=self.within)

    def get(self, path: tuple[str, ...]) -> Typed | None:
        now: Typed | None = self
        for s in path:
            now = now._step(s) if now else None
        return now

    def _step(self, s: str) -> Typed | None:
        if isinstance(self.dtype, T.StructType):
            if s not in self.dtype.names:
                return None
            col = F.col(_quote(s)) if self.col is None else self.col.getField(s)
            return self._child(col, self.dtype[s].dataType, True if self.col is None else self.col.isNotNull())
        if isinstance(self.dtype, T.MapType) and isinstance(self.dtype.keyType, T.StringType):
            return self._child(F.try_element_at(self.col, F.lit(s)), self.dtype.valueType, F.map_contains_key(self.col, s))
        if isinstance(self.dtype, T.ArrayType) and s.isascii() and s.isdigit():
            return self._child(F.get(self.col, F.lit(int(s))), self.dtype.elementType, F.size(self.col) > int(s))
        return None

    def whole(self) -> Column:
        return F.struct(*[F.col(_quote(n)) for n in self.dtype.names]) if self.col is None else self.col

    def _null_case(self, if_null: bool, p: Cond) -> Cond:
        """p for values, if_null for a JSON null."""
        if self.nulls == "missing" or self.col is None:
            return both(self.exists, p) if isinstance(p, bool) else p
        return both(self.exists, F.when(self.col.isNull(), F.lit(if_null)).otherwise(as_column(p)))

    def _plain(self) -> Column:
        if isinstance(self.dtype, T.TimestampType | T.TimestampNTZType | T.DateType):
            return F.unix_millis(self.col.cast("timestamp"))
        return self.col.cast("string") if isinstance(self.dtype, T.CharType | T.VarcharType) else self.col

    def compare(self, op: str, v: object) -> Cond:
        test, mine, other = _ORDER[op], RANKS[self.known], rank(v)
        null = test(0, other)
        if self.known == "boolean" and isinstance(v, bool):
            return self._null_case(null, test(self.col, F.lit(v)))
        if self.known != kind(v):
            return self._null_case(null, test(mine, other))
        if self.known in ("number", "string"):
            return self._null_case(null, test(self._plain(), _literal(v, self.dtype)))
        if self.known == "array" and op in ("eq", "ne"):
            same = both(F.size(self.col) == len(v), *[self._element(F.get(self.col, F.lit(i))).compare("eq", x) for i, x in enumerate(v)])
            return self._null_case(null, same if op == "eq" else both(self.exists, fails(same)))
        return self._null_case(null, self._json().compare(op, v))

    def _json(self) -> Variant:
        """The value as JSON gives it: an array or an object."""
        return Variant(F.parse_json(F.to_json(self.whole())))

    def elements(self, f: Callable[[Typed], Cond], every: bool) -> Cond:
        if not isinstance(self.dtype, T.ArrayType):
            return False
        inner = lambda x: F.coalesce(as_column(f(self._element(x))), F.lit(False))
        return both(F.size(self.col) > 0, F.forall(self.col, inner)) if every else F.exists(self.col, inner)

    def keys(self, f: Callable[[Typed], Cond]) -> Cond:
        if isinstance(self.dtype, T.MapType):
            return F.exists(F.map_keys(self.col), lambda k: F.coalesce(as_column(f(Typed(k, T.StringType(), "null"))), F.lit(False)))
        if isinstance(self.dtype, T.StructType):
            there = lambda n: True if self.nulls == "null" else F.col(_quote(n)).isNotNull() if self.col is None else self.col.getField(n).isNotNull()
            return both(self.exists, either(*[both(there(n), f(Typed(F.lit(n), T.StringType(), "null"))) for n in self.dtype.names]))
        return False

    def is_kind(self, name: str) -> Cond:
        return self._null_case(name == "null", self.known == name)

    def is_array(self) -> bool:
        return self.known == "array"

    def size(self, n: int) -> Cond:
        return both(self.col.isNotNull(), F.size(self.col) == n) if self.known == "array" else False

    def mod(self, d: int, r: int) -> Cond:
        whole = isinstance(self.dtype, T.IntegralType)
        return F.try_mod(self.col.cast("long"), F.lit(d)) == r if whole and d else False

    def text(self, f: Callable[[Column], Column]) -> Cond:
        return f(self.col) if self.known == "string" else False

    def contains(self, v: object) -> Cond:
        """An element strictly equal to v: 1 isn't 1.0."""
        e = self.dtype.elementType
        if kind(v) == "number" and kind_of(e) == "number" and isinstance(e, T.IntegralType) != isinstance(v, int):
            return False
        if kind(v) in ("array", "object"):
            return self.elements(lambda x: x._json().strictly(v), False) if kind_of(e) == kind(v) else False
        return self.elements(lambda x: x.compare("eq", v), False)

    def strictly(self, v: list) -> Cond:
        return self._json().strictly(v)


class Variant:
    """A value of type VARIANT; its kind is known at run time only, and JSON null differs from an absent path."""

    def __init__(self, col: Column):
        self.col = col
        self.exists: Cond = col.isNotNull()
        self.schema = F.schema_of_variant(col)

    def get(self, path: tuple[str, ...]) -> Variant:
        col = self.col
        for s in path:
            key = F.try_variant_get(col, "$[" + json.dumps(s, ensure_ascii=False) + "]", "variant")
            col = F.coalesce(F.try_variant_get(col, f"$[{int(s)}]", "variant"), key) if s.isascii() and s.isdigit() and int(s) < 2**31 else key
        return Variant(col) if path else self

    def _as(self, t: str) -> Column:
        return F.try_variant_get(self.col, "$", t)

    def _kind(self, name: str) -> Column:
        s = self.schema
        if name == "null":
            return F.is_variant_null(self.col)
        if name == "number":
            return s.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
        return s.startswith({"boolean": "BOOLEAN", "string": "STRING", "array": "ARRAY", "object": "OBJECT"}[name])

    def _rank(self) -> Column:
        ranked = F.when(self._kind("null"), 0).when(self._kind("boolean"), F.when(self._as("boolean"), 2).otherwise(1))
        for name in ("number", "string", "array", "object"):
            ranked = ranked.when(self._kind(name), RANKS[name])
        return ranked

    def compare(self, op: str, v: object) -> Cond:
        return both(self.exists, _ORDER[op](self.order(v), 0))

    def order(self, v: object) -> Column:
        """-1, 0 or 1 as the value comes before, with or after v in collation; arrays by their elements, objects by their sorted keys and values, then by size."""
        k, apart = kind(v), F.when(self._rank() < rank(v), -1).otherwise(1)
        if k in ("null", "boolean"):
            return F.when(self._rank() == rank(v), 0).otherwise(apart)
        if k == "number":
            exact = isinstance(v, int) and abs(v) > 2**53
            same = _sign(self._as("decimal(38,10)" if exact else "double"), F.lit(v).cast("decimal(38,10)") if exact else F.lit(float(v)))
        elif k == "string":
            same = _sign(self._as("string"), F.lit(v))
        elif k == "array":
            parts = self._elements()
            same = _sign(F.size(parts), F.lit(len(v)))
            for i, x in reversed(list(enumerate(v))):
                same = F.when(F.size(parts) <= i, -1).otherwise(_first(Variant(F.get(parts, F.lit(i))).order(x), same))
        else:
            names = F.array_sort(F.map_keys(self._fields()))
            same = _sign(F.size(names), F.lit(len(v)))
            for i, (name, x) in reversed(list(enumerate(sorted(v.items())))):
                value = Variant(F.try_element_at(self._fields(), F.lit(name))).order(x)
                same = F.when(F.size(names) <= i, -1).otherwise(_first(_sign(F.get(names, F.lit(i)), F.lit(name)), _first(value, same)))
        return F.when(self._kind(k), same).otherwise(apart)

    def _fields(self) -> Column:
        return F.when(self._kind("object"), self._as("map<string,variant>"))

    def _elements(self) -> Column:
        return F.when(self._kind("array"), self._as("array<variant>"))

    def elements(self, f: Callable[[Variant], Cond], every: bool) -> Cond:
        inner = lambda x: F.coalesce(as_column(f(Variant(x))), F.lit(False))
        return both(F.size(self._elements()) > 0, F.forall(self._elements(), inner)) if every else F.exists(self._elements(), inner)

    def keys(self, f: Callable[[Typed], Cond]) -> Cond:
        names = F.map_keys(self._fields())
        return F.exists(names, lambda k: F.coalesce(as_column(f(Typed(k, T.StringType(), "null"))), F.lit(False)))

    def is_kind(self, name: str) -> Cond:
        return both(self.exists, self._kind(name)) if name in RANKS else False

    def is_array(self) -> Column:
        return self._kind("array")

    def size(self, n: int) -> Cond:
        return F.size(self._elements()) == n

    def mod(self, d: int, r: int) -> Cond:
        return F.when(self.schema.rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), F.try_mod(self._as("long"), F.lit(d)) == r) if d else False

    def text(self, f: Callable[[Column], Column]) -> Cond:
        return F.when(self._kind("string"), f(self._as("string")))

    def contains(self, v: object) -> Cond:
        strict = lambda x: both(x.schema.rlike("^(BIGINT|INT|SMALLINT|TINYINT)") if isinstance(v, int) else ~x.schema.rlike("^(BIGINT|INT|SMALLINT|TINYINT)")) if kind(v) == "number" else True
        if kind(v) in ("array", "object"):
            return self.elements(lambda x: x.strictly(v), False)
        return self.elements(lambda x: both(strict(x), x.compare("eq", v)), False)

    def strictly(self, v: list | dict) -> Cond:
        return F.when(self._kind(kind(v)), F.to_json(self.col) == F.to_json(F.parse_json(F.lit(json.dumps(v)))))


def _sign(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def _first(a: Column, b: Column) -> Column:
    """The first of two orders that isn't 0."""
    return F.when(a != 0, a).otherwise(b)


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def kind_of(t: T.DataType) -> str:
    """The JSON kind that a column type holds."""
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType | T.TimestampType | T.TimestampNTZType | T.DateType):
        return "number"
    if isinstance(t, T.ArrayType):
        return "array"
    return "object" if isinstance(t, T.StructType | T.MapType) else "null" if isinstance(t, T.NullType) else "string"


def _literal(v: object, t: T.DataType) -> Column:
    if isinstance(v, datetime.datetime):
        return F.unix_millis(F.lit(v))
    if isinstance(v, int) and not -(2**63) <= v < 2**63:
        return F.lit(float(v))
    return F.lit(v)


def _test(value, op: str, arg) -> Cond:
    """Whether an existing value meets a condition."""
    if op in _ORDER:
        return value.compare(op, arg)
    if op in ("in", "nin"):
        scalar = either(*[value.compare("eq", a) for a in arg]) if arg else False
        among = value.elements(lambda x: either(*[x.compare("eq", a) for a in arg]), False) if arg else False
        array = value.is_array()
        hit = among if array is True else scalar if array is False else F.when(array, as_column(among)).otherwise(as_column(scalar))
        return hit if op == "in" else both(value.exists, fails(hit))
    if op == "exists":
        return value.exists
    if op == "type":
        return value.is_kind(arg)
    if op == "mod":
        return value.mod(*arg)
    if op == "regex":
        return value.text(lambda c: c.rlike(arg))
    if op == "beginsWith":
        return value.text(lambda c: c.startswith(arg))
    if op == "size":
        return value.size(arg)
    if op == "all":
        if not arg or value.is_array() is False:
            return False
        whole = value.strictly(arg[0]) if len(arg) == 1 and isinstance(arg[0], list) else False
        return either(both(*[value.contains(a) for a in arg]), whole)
    if op == "keyMapMatch":
        return value.keys(lambda k: match(arg, k))
    return value.elements(lambda x: match(arg, x), op == "allMatch")


def match(node, value) -> Cond:
    """The condition of a tree on a value (Typed or Variant)."""
    if isinstance(node, Every):
        return True
    if isinstance(node, Complement):
        return fails(match(node.part, value))
    if isinstance(node, Group):
        if not node.parts:
            return True
        parts = [match(p, value) for p in node.parts]
        return both(*parts) if node.op == "and" else either(*parts) if node.op == "or" else fails(either(*parts))
    here = value.get(node.path)
    if node.op == "exists" and not node.arg:
        return True if here is None else fails(here.exists)
    if here is None:
        return False
    p = _test(here, node.op, node.arg)
    return both(here.exists, fails(p)) if node.negated else p


def condition(df: DataFrame, selector: dict, nulls: str = "missing", body: str | None = None) -> Column:
    """selector as a boolean column of df. body: the VARIANT column that holds the documents; without it, the columns of df are the document."""
    root = Variant(F.col(body)) if body else Typed(None, df.schema, nulls, True)
    return as_column(match(parse_selector(selector), root))
