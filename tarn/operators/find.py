"""find, explain and indexes over a collection."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.collate import kind, sort_key_of
from ..functions.paths import SelectorError, nest, parse_field
from ..functions.spatial import Rect, covering_condition, quadkey
from ..plans.planner import LAST, IndexDef, Range, choose, parse_sort, ranges
from ..plans.selector import parse_selector
from ..sources.collection import Collection
from .match import Typed, Variant, condition

DEFAULT_LIMIT = 25
#: Ids from an index that are looked up by a condition on the scan, at most.
FEW = 1000
NO_INDEX = "No matching index found, create an index to optimize query time."


@dataclass(frozen=True)
class Query:
    selector: dict
    limit: int = DEFAULT_LIMIT
    skip: int = 0
    fields: tuple[str, ...] | None = None
    sort: tuple[str, ...] = ()
    descending: bool = False
    use_index: str | None = None


def _count(v: object, default: int) -> int:
    return v if isinstance(v, int) and not isinstance(v, bool) and v >= 0 else default


def parse_query(query: dict) -> Query:
    if not isinstance(query, dict) or "selector" not in query:
        raise SelectorError("a query needs a selector")
    fields = query.get("fields")
    if fields is not None and not (isinstance(fields, list) and all(isinstance(f, str) for f in fields)):
        raise SelectorError("fields must be an array of names")
    sort, descending = parse_sort(query.get("sort"))
    use = query.get("use_index")
    return Query(query["selector"], _count(query.get("limit"), DEFAULT_LIMIT), _count(query.get("skip"), 0), None if fields is None else tuple(fields), tuple(sort), descending, use if isinstance(use, str) and use else None)


@dataclass(frozen=True)
class Found:
    """The rows of a query, lazily; warning as a reply would hold it; statistics once df has run: index rows and documents examined, which are counted only when asked for, and results."""

    df: DataFrame
    index: IndexDef | None
    warning: str | None
    keys: DataFrame | None
    docs: DataFrame
    returned: Observation
    bookmark: str = "nil"

    def stats(self) -> dict:
        keys = self.keys.count() if self.keys is not None else 0
        return {"total_keys_examined": keys, "total_docs_examined": keys if self.keys is not None else self.docs.count(), "results_returned": self.returned.get["n"]}


def _value(c: Collection, df: DataFrame, path: tuple[str, ...]):
    return (Variant(F.col(c.body)) if c.body else Typed(None, df.schema, c.nulls, True)).get(path)


def _sort_columns(c: Collection, df: DataFrame, field: str) -> tuple[list[Column], Column]:
    """Columns that order a field by collation, and whether it exists."""
    v = _value(c, df, parse_field(field))
    if v is None:
        return [], F.lit(False)
    if isinstance(v, Typed):
        there = v.exists if isinstance(v.exists, Column) else F.lit(True)
        return [v.col], there
    nested = sort_key_of(F.when(v._kind("array") | v._kind("object"), F.to_json(v.col)))
    return [v._rank(), F.when(v._kind("number"), v._as("double")), F.when(v._kind("string"), v._as("string")), nested], v.exists


def project(c: Collection, df: DataFrame, fields: tuple[str, ...] | None) -> DataFrame:
    """Columns under the names of fields, nested where they are dotted; paths that the schema lacks are left out."""
    if fields is None:
        return df
    if c.body:
        return df.select(*[_value(c, df, p).col.alias(".".join(p)) for p in map(parse_field, fields)])
    found = [(p, v.col if v.col is not None else v.whole()) for p in map(parse_field, fields) if (v := _value(c, df, p)) is not None]

    def build(tree: dict) -> list[Column]:
        return [(F.struct(*build(x)) if isinstance(x, dict) else x).alias(k) for k, x in tree.items()]

    return df.select(*build(nest(found)))


def _bounds(column: Column, r: Range, dtype: str, nulls: bool) -> Column | None:
    """r as a condition on a key column of a materialized index; None where the column's type has another rank than a bound, so that the bound says nothing about it."""
    same = {"string": "string", "double": "number", "float": "number", "boolean": "boolean"}.get(dtype, "number" if dtype in ("tinyint", "smallint", "int", "bigint") or dtype.startswith("decimal") else "")
    parts = []
    for bound, inside, outside in ((r.low, "__ge__", "__gt__"), (r.high, "__le__", "__lt__")):
        if bound is not None and kind(bound[0]) == same:
            value = bound[0]
            if isinstance(value, str) and value.endswith(LAST):
                continue  # the end of a prefix; the condition itself is checked on the document
            parts.append(getattr(column, inside if bound[1] else outside)(F.lit(float(value) if isinstance(value, int) and not -(2**63) <= value < 2**63 else value)))
    if not parts:
        return None
    out = parts[0] if len(parts) == 1 else parts[0] & parts[1]
    # a JSON null comes before all numbers and texts
    return out | column.isNull() if nulls and r.low is None else out


def index_scan(c: Collection, index: IndexDef, node) -> DataFrame | None:
    """The rows of a materialized index that can belong to matches: key bounds reach its sorted files, for a box also those of the cells that cover it. None if the index isn't written, or its keys are VARIANT, or nothing bounds it."""
    if index.materialized is None or c.body:
        return None
    rows = c.df.sparkSession.read.parquet(index.materialized)
    found, types = ranges(node), dict(rows.dtypes)
    conditions = []
    for f, k in zip(index.fields, "wsen" if index.kind == "spatial" else [f"k{i}" for i in range(len(index.fields))]):
        r = found.get(parse_field(f))
        if r is not None and k in types and (bound := _bounds(F.col(k), r, types[k], c.nulls == "null")) is not None:
            conditions.append(bound)
    if index.kind == "spatial":
        value = lambda f, side, default: float(b[0]) if (r := found.get(parse_field(f))) and (b := getattr(r, side)) and kind(b[0]) == "number" else default
        w, s, e, n = index.fields
        box = Rect(value(e, "low", -180.0), value(n, "low", -90.0), value(w, "high", 180.0), value(s, "high", 90.0))
        if not box.valid() or not conditions:
            return None
        conditions.append(covering_condition(F.col("quadkey"), box))
    if not conditions:
        return None
    for p in conditions:
        rows = rows.where(p)
    return rows.select("id")


def find(c: Collection, query: dict, strict_sort: bool = False) -> Found:
    """The documents that a query matches, in its order: by sort fields and then the id, else by the id. strict_sort refuses a sort that no index gives.

    A materialized index that suits the query gives the ids to read, by ranges of its keys; the selector is checked on the documents in any case, so an index must be as new as the collection, see refresh(). Without one the selector's conditions reach the scan, and the reply has a warning.
    """
    q = parse_query(query)
    node = parse_selector(q.selector)
    index, _ = choose(node, q.selector, c.indexes, list(q.sort), q.use_index)
    if q.use_index and index is None:
        raise SelectorError(f"index {q.use_index} can't be used for this query")
    if q.sort and index is None and strict_sort:
        raise SelectorError("no index exists for this sort")
    returned = Observation()
    keys = index_scan(c, index, node) if index else None
    df = c.scan()
    if keys is not None:
        some = [r[0] for r in keys.limit(FEW + 1).collect()]
        # few ids reach the scan as a condition; many are joined
        df = df.where(F.col(c.id).isin(some)) if len(some) <= FEW else df.join(keys.withColumnRenamed("id", c.id), c.id, "left_semi")
    df = df.where(condition(c.df, q.selector, c.nulls, c.body))
    order: list[Column] = []
    for f in q.sort:
        columns, there = _sort_columns(c, df, f)
        df = df.where(there)
        order += columns
    order = [*order, F.col(c.id)]
    df = df.orderBy(*[o.desc() if q.descending else o.asc() for o in order])
    df = (df.offset(q.skip) if q.skip else df).limit(q.limit)
    return Found(project(c, df, q.fields).observe(returned, F.count(F.lit(1)).alias("n")) if q.fields != () else project(c, df, q.fields), index, NO_INDEX if keys is None else None, keys, c.scan(), returned)


def explain(c: Collection, query: dict) -> dict:
    q = parse_query(query)
    index, rejected = choose(parse_selector(q.selector), q.selector, c.indexes, list(q.sort), q.use_index)
    plan = find(c, query).df._jdf.queryExecution().explainString(c.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return {
        "index": index.as_dict() if index else c.list_indexes()[0],
        "selector": q.selector,
        "limit": q.limit,
        "skip": q.skip,
        "fields": "all_fields" if q.fields is None else list(q.fields),
        "sort": [{f: "desc" if q.descending else "asc"} for f in q.sort],
        "rejected": rejected,
        "plan": plan,
    }


def index_rows(c: Collection, index: IndexDef) -> DataFrame:
    """Rows of an index: its keys, and the id; documents that lack a key have none. Spatial: the quadkey and the box."""
    import json

    df = c.df.where(c.live()) if c.deleted else c.df
    if index.partial != "{}":
        df = df.where(condition(c.df, json.loads(index.partial), c.nulls, c.body))
    columns: list[Column] = []
    if index.kind == "spatial":
        box = [_value(c, df, parse_field(f)) for f in index.fields]
        box = [F.lit(None).cast("double") if v is None else v.col.cast("double") if isinstance(v, Typed) and v.known == "number" else F.when(v._kind("number"), v._as("double")) if isinstance(v, Variant) else F.lit(None).cast("double") for v in box]
        return df.select(quadkey(*box).alias("quadkey"), *[b.alias(n) for b, n in zip(box, "wsen")], F.col(c.id).alias("id"))
    for k, f in enumerate(index.fields):
        keys, there = _sort_columns(c, df, f)
        df = df.where(there)
        columns += [x.alias(f"k{k}" + (f"_{j}" if len(keys) > 1 else "")) for j, x in enumerate(keys)]
    return df.select(*columns, F.col(c.id).alias("id"))


def materialize(c: Collection, index: IndexDef, path: str, partitions: int | None = None) -> DataFrame:
    """Writes the rows of an index as Parquet, range-partitioned and sorted by key, so that ranges prune files; reads it back."""
    rows = index_rows(c, index)
    keys = [n for n in rows.columns if n == "quadkey" or n[0] == "k"] or ["id"]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys, "id").write.mode("overwrite").parquet(path)
    return c.df.sparkSession.read.parquet(path)


def with_materialized(c: Collection, index: IndexDef, path: str, partitions: int | None = None) -> Collection:
    """The collection with an index whose rows are written to path, for find() to read."""
    materialize(c, index, path, partitions)
    return replace(c, indexes=(*[i for i in c.indexes if not i.same(index)], replace(index, materialized=path)))


def refresh(old: DataFrame, c: Collection, index: IndexDef, changed: DataFrame) -> DataFrame:
    """Rows of an index after changes: those of changed ids (one column, the id) are made anew."""
    ids = changed.select(F.col(changed.columns[0]).alias("id")).distinct()
    new = index_rows(Collection(c.df.join(ids.withColumnRenamed("id", c.id), c.id, "left_semi"), c.id, c.body, c.deleted, c.nulls), index)
    return old.join(ids, "id", "left_anti").select(*old.columns).unionByName(new)
