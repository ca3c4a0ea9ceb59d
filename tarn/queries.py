"""The query catalogue over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import proto, validate
from .functions.jsfilter import js_filter
from .functions.stamps import http_date, iso8601
from .functions.spatial import Rect, covering_condition, quadkey
from .operators import documents as dc
from .operators import revisions as rv
from .operators.find import find, index_rows, materialize, with_materialized
from .operators.match import condition
from .plans.planner import index_def
from .sources.collection import Collection, shared_folder
from .streaming import changes as ch
from .streaming.replicate import delta

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _selects(name: str, table: str, selector: dict, columns: str, where: str) -> None:
    query(name, f"SELECT {columns} FROM {table} WHERE {where}")(lambda spark, d: (t := read(spark, d, table)).where(condition(t, selector)).selectExpr(*columns.split(", ")))


def _finds(name: str, table: str, key: str, q: dict, sql: str, prepare=lambda df: df) -> None:
    query(name, sql)(lambda spark, d: find(Collection(prepare(read(spark, d, table)), key), q).df)


# selectors

_O = "o_orderkey, o_totalprice"
for _name, _table, _selector, _columns, _where in [
    ("sel_eq", "orders", {"o_orderstatus": "F"}, _O, "o_orderstatus = 'F'"),
    ("sel_ne", "orders", {"o_orderstatus": {"$ne": "F"}}, _O, "o_orderstatus <> 'F'"),
    ("sel_range", "orders", {"o_totalprice": {"$gte": 100000, "$lt": 200000}}, _O, "o_totalprice >= 100000 AND o_totalprice < 200000"),
    ("sel_cross_type_gt", "orders", {"o_orderstatus": {"$gt": 99999}}, _O, "true"),
    ("sel_cross_type_lt", "orders", {"o_totalprice": {"$lt": "a"}}, _O, "true"),
    ("sel_null_literal", "orders", {"o_totalprice": {"$gt": None}}, _O, "true"),
    ("sel_in", "events", {"event_type": {"$in": ["click", "view"]}}, "event_id, event_type", "event_type IN ('click', 'view')"),
    ("sel_nin", "events", {"event_type": {"$nin": ["click", "view"]}}, "event_id, event_type", "event_type NOT IN ('click', 'view')"),
    ("sel_in_mixed_types", "events", {"event_type": {"$in": ["click", 5, None]}}, "event_id, event_type", "event_type = 'click'"),
    ("sel_and_or_nor_not", "orders", {"$or": [{"o_orderstatus": "F", "o_totalprice": {"$gt": 300000}}, {"$nor": [{"o_orderstatus": "F"}, {"o_orderpriority": {"$beginsWith": "1"}}]}], "$not": {"o_custkey": {"$lt": 100}}}, _O, "((o_orderstatus = 'F' AND o_totalprice > 300000) OR NOT (o_orderstatus = 'F' OR o_orderpriority LIKE '1%')) AND NOT o_custkey < 100"),
    ("sel_demorgan", "orders", {"$not": {"$and": [{"o_orderstatus": "O"}, {"o_totalprice": {"$gt": 50000}}]}}, _O, "NOT (o_orderstatus = 'O' AND o_totalprice > 50000)"),
    ("sel_empty_or", "region", {"$or": []}, "r_regionkey, r_name", "true"),
    ("sel_exists_true", "nation", {"n_name": {"$exists": True}}, "n_nationkey", "true"),
    ("sel_exists_false", "nation", {"n_nope": {"$exists": False}}, "n_nationkey", "true"),
    ("sel_not_missing", "nation", {"nope": {"$not": {"$eq": 1}}}, "n_nationkey", "false"),
    ("sel_type_number", "part", {"p_size": {"$type": "number"}}, "p_partkey", "true"),
    ("sel_type_string", "part", {"p_size": {"$type": "string"}}, "p_partkey", "false"),
    ("sel_mod_int", "part", {"p_size": {"$mod": [7, 3]}}, "p_partkey, p_size", "p_size % 7 = 3"),
    ("sel_mod_float", "lineitem", {"l_quantity": {"$mod": [2, 0]}}, "l_orderkey", "false"),
    ("sel_regex", "part", {"p_name": {"$regex": "^small"}}, "p_partkey, p_name", "regexp_matches(p_name, '^small')"),
    ("sel_beginswith", "orders", {"o_orderpriority": {"$beginsWith": "1-"}}, _O, "starts_with(o_orderpriority, '1-')"),
    ("sel_size", "embeddings", {"embedding": {"$size": 64}}, "vec_id", "len(embedding) = 64"),
    ("sel_elem_match", "embeddings", {"embedding": {"$elemMatch": {"$gt": 0.3}}}, "vec_id", "list_max(embedding) > 0.3"),
    ("sel_all_match", "embeddings", {"embedding": {"$allMatch": {"$gt": -0.4}}}, "vec_id", "list_min(embedding) > -0.4"),
    ("sel_array_index", "embeddings", {"embedding.0": {"$gt": 0.1}}, "vec_id", "embedding[1] > 0.1"),
    ("sel_timestamp", "events", {"ts": {"$gte": 1704585600000}}, "event_id", "ts >= TIMESTAMP '2024-01-07'"),
]:
    _selects(_name, _table, _selector, _columns, _where)


@query("sel_elem_not", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role <> 'user') > 0")
def _(spark, d):
    t = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    return t.where(condition(t, {"turns": {"$elemMatch": {"$not": {"role": "user"}}}})).select("conv_id")


@query("sel_all_strict", "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['red', 'ring'])")
def _(spark, d):
    t = read(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return t.where(condition(t, {"words": {"$all": ["red", "ring"]}})).select("p_partkey")


@query("sel_keymap", "SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type = 'error')")
def _(spark, d):
    t = read(spark, d, "events").groupBy("user_id").agg(F.map_from_entries(F.collect_set(F.struct("event_type", F.lit(1)))).alias("kinds"))
    return t.where(condition(t, {"kinds": {"$keyMapMatch": {"$eq": "error"}}})).select("user_id")


@query("sel_json_path", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 50")
def _(spark, d):
    t = read(spark, d, "events").select("event_id", F.parse_json("props").alias("v"))
    return t.where(condition(t, {"k": {"$gt": 50}}, body="v")).select("event_id")


def _turns(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"), F.collect_list(F.array("role")).alias("roles"))


for _name, _selector, _having in [
    ("sel_in_objects", {"turns": {"$in": [{"role": "user", "turn": 2}, "x"]}}, "bool_or(turn = 2 AND role = 'user')"),
    ("sel_nin_arrays", {"roles": {"$nin": [["assistant"], 5]}}, "NOT bool_or(role = 'assistant')"),
    ("sel_all_objects", {"turns": {"$all": [{"turn": 0, "role": "user"}, {"turn": 3, "role": "assistant"}]}}, "bool_or(turn = 0 AND role = 'user') AND bool_or(turn = 3 AND role = 'assistant')"),
    ("sel_elem_match_order", {"roles": {"$elemMatch": {"$gt": ["assistant", "x"], "$lt": ["user"]}}}, "bool_or(role > 'assistant' AND role < 'user')"),
]:
    _sql = f"SELECT conv_id FROM conversations GROUP BY conv_id HAVING {_having}"
    query(_name, _sql)(lambda spark, d, s=_selector: (t := _turns(spark, d)).where(condition(t, s)).select("conv_id"))
    query(f"{_name}_json", _sql)(lambda spark, d, s=_selector: (t := _turns(spark, d).select("conv_id", F.parse_json(F.to_json(F.struct("turns", "roles"))).alias("v"))).where(condition(t, s, body="v")).select("conv_id"))


# find

_finds("find_sort_asc", "orders", "o_orderkey", {"selector": {"o_orderstatus": "F"}, "fields": ["o_orderkey", "o_totalprice"], "sort": ["o_totalprice"], "limit": 50}, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 50")
_finds("find_sort_desc", "orders", "o_orderkey", {"selector": {"o_orderstatus": "F", "o_totalprice": {"$gte": 400000}}, "fields": ["o_orderkey", "o_totalprice"], "sort": [{"o_totalprice": "desc"}], "limit": 50}, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 400000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50")
_finds("find_skip_limit", "customer", "c_custkey", {"selector": {}, "fields": ["c_custkey", "c_name"], "skip": 10, "limit": 25}, "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 10")
_finds("find_default_limit", "customer", "c_custkey", {"selector": {}, "fields": ["c_custkey"]}, "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25")
_finds("find_sort_const_prefix", "events", "event_id", {"selector": {"event_type": "click"}, "fields": ["event_id", "user_id"], "sort": ["ts"], "limit": 40}, "SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 40")


@query("find_project_nested", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 450000 ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    t = read(spark, d, "orders").select("o_orderkey", F.struct("o_custkey", "o_orderstatus", "o_totalprice").alias("db"))
    rows = find(Collection(t, "o_orderkey"), {"selector": {"db.o_totalprice": {"$gt": 450000}}, "fields": ["o_orderkey", "db.o_custkey", "db.o_orderstatus", "nope"], "limit": 100}).df
    return rows.select("o_orderkey", "db.o_custkey", "db.o_orderstatus")


@query("find_project_nested_all", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 450000")
def _(spark, d):
    t = read(spark, d, "orders").select("o_orderkey", F.struct("o_custkey", "o_orderstatus", "o_totalprice").alias("db"))
    rows = find(Collection(t, "o_orderkey"), {"selector": {"db.o_totalprice": {"$gt": 450000}}, "fields": ["o_orderkey", "db.o_custkey", "db.o_orderstatus", "nope"], "limit": max(1, t.count())}).df
    return rows.select("o_orderkey", "db.o_custkey", "db.o_orderstatus")


@query("find_partial_index", "SELECT user_id AS k0, event_id AS id FROM events WHERE event_type = 'purchase'")
def _(spark, d):
    c = Collection(read(spark, d, "events"), "event_id")
    return index_rows(c, index_def({"fields": ["user_id"], "partial_filter_selector": {"event_type": "purchase"}}))


@query("index_rows", "SELECT count(*) AS n, count(DISTINCT event_type) AS types FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL")
def _(spark, d):
    rows = index_rows(Collection(read(spark, d, "events"), "event_id"), index_def({"fields": ["event_type", "ts"]}))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("k0").alias("types"))


def _boxes(spark, d):
    e = read(spark, d, "events")
    w, s = F.col("user_id") % 300 - 150 + F.lit(0.5), F.col("event_id") % 120 - 60 + F.lit(0.25)
    return e.select("event_id", w.alias("w"), s.alias("s"), (w + F.col("event_id") % 3).alias("e"), (s + F.col("event_id") % 2).alias("n"))


_BOXES = "(SELECT event_id, user_id % 300 - 150 + 0.5 AS w, event_id % 120 - 60 + 0.25 AS s, user_id % 300 - 150 + 0.5 + event_id % 3 AS e, event_id % 120 - 60 + 0.25 + event_id % 2 AS n FROM events)"


@query("find_bbox", f"SELECT event_id FROM {_BOXES} WHERE w <= 20 AND e >= -10 AND s <= 30 AND n >= 5")
def _(spark, d):
    t = _boxes(spark, d)
    return t.where(condition(t, {"w": {"$lte": 20}, "e": {"$gte": -10}, "s": {"$lte": 30}, "n": {"$gte": 5}})).select("event_id")


@query("spatial_covering", f"SELECT event_id FROM {_BOXES} WHERE w <= 20 AND e >= -10 AND s <= 30 AND n >= 5")
def _(spark, d):
    t = _boxes(spark, d).withColumn("key", quadkey(F.col("w"), F.col("s"), F.col("e"), F.col("n")))
    near = t.where(covering_condition(F.col("key"), Rect(-10.0, 5.0, 20.0, 30.0), stored=False))
    return near.where("w <= 20 and e >= -10 and s <= 30 and n >= 5").select("event_id")


@query("spatial_quadkey", "SELECT event_id, CASE WHEN event_id % 2 = 1 THEN '' ELSE (CASE WHEN x >= 0 THEN '1' ELSE '0' END) END AS first FROM (SELECT event_id, user_id % 170 + 1 AS x FROM events)")
def _(spark, d):
    x = F.col("user_id") % 170 + F.lit(1.0)
    t = read(spark, d, "events").select("event_id", quadkey(F.when(F.col("event_id") % 2 == 1, -x).otherwise(x), F.lit(-10.0), x, F.lit(-10.0)).alias("k"))
    return t.select("event_id", F.when(F.col("event_id") % 2 == 1, "").otherwise(F.substring("k", 1, 1)).alias("first"))


_CORNERS = f"(SELECT event_id, ((w + 180) * 4)::BIGINT * 16777216 // 1440 AS w, ((e + 180) * 4)::BIGINT * 16777216 // 1440 AS e, ((s + 90) * 4)::BIGINT * 16777216 // 720 AS s, ((n + 90) * 4)::BIGINT * 16777216 // 720 AS n FROM {_BOXES})"


@query("spatial_quadkey_whole", f"SELECT event_id, coalesce(string_agg(((w >> (24 - k)) & 1) + 2 * ((s >> (24 - k)) & 1), '' ORDER BY k) FILTER (w >> (24 - k) = e >> (24 - k) AND s >> (24 - k) = n >> (24 - k)), '') AS key FROM {_CORNERS}, range(1, 25) l(k) GROUP BY event_id")
def _(spark, d):
    return _boxes(spark, d).select("event_id", quadkey(F.col("w"), F.col("s"), F.col("e"), F.col("n")).alias("key"))


_WRITTEN: dict[tuple[str, str, str], Collection] = {}


def _indexed(spark: SparkSession, d: str, name: str, c: Collection, fields: list[str], kind: str = "json") -> Collection:
    """c with an index that is written once for each table and application."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = with_materialized(c, index_def({"fields": fields}, kind=kind), f"{shared_folder(spark)}/tarn-index-{uuid.uuid4().hex}")
    return Collection(c.df, c.id, indexes=_WRITTEN[key].indexes)


def _orders(spark, d):
    return Collection(read(spark, d, "orders"), "o_orderkey")


def _every(c: Collection, q: dict) -> DataFrame:
    """All that a query finds."""
    return find(c, {**q, "limit": 2**31 - 1}).df


query("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")(lambda spark, d: _orders(spark, d).get(77).select("o_orderkey", "o_custkey", "o_totalprice"))
query("find_point", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 77")(lambda spark, d: _every(_indexed(spark, d, "custkey", _orders(spark, d), ["o_custkey"]), {"selector": {"o_custkey": 77}, "fields": ["o_orderkey", "o_totalprice"]}))
query("find_index_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 200000 AND o_totalprice < 240000 AND o_orderstatus <> 'F'")(lambda spark, d: _every(_indexed(spark, d, "price", _orders(spark, d), ["o_totalprice"]), {"selector": {"o_totalprice": {"$gte": 200000, "$lt": 240000}, "o_orderstatus": {"$ne": "F"}}, "fields": ["o_orderkey", "o_custkey"]}))


@query("find_bbox_indexed", f"SELECT event_id FROM {_BOXES} WHERE w <= -140 AND e >= -146 AND s <= 8 AND n >= 5")
def _(spark, d):
    c = _indexed(spark, d, "boxes", Collection(_boxes(spark, d), "event_id"), ["w", "s", "e", "n"], "spatial")
    return _every(c, {"selector": {"w": {"$lte": -140}, "e": {"$gte": -146}, "s": {"$lte": 8}, "n": {"$gte": 5}}, "fields": ["event_id"]})


@query("index_build", "SELECT event_type AS k0, value AS k1, event_id AS id FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL")
def _(spark, d):
    return materialize(Collection(read(spark, d, "events"), "event_id"), index_def({"fields": ["event_type", "value"]}), f"{shared_folder(spark)}/tarn-index-{uuid.uuid4().hex}")


# documents by id, and revisions: each lineitem row is a leaf of its order


def _leaves(spark, d):
    rev = F.md5(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.unix_millis(F.col("l_shipdate").cast("timestamp")).cast("string")).cast("binary"))
    t = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber").cast("long").alias("pos"), F.array(rev).alias("path"), (F.col("l_returnflag") == "R").alias("deleted"), F.col("l_partkey").alias("seq"), F.lit(100).cast("long").alias("size"), F.col("l_suppkey").alias("body"))
    return t.dropDuplicates(["id", "pos", "path"])


_LEAVES = """(SELECT id, pos, rev, bool_and(del) AS del, max(seq) AS seq FROM (SELECT l_orderkey::VARCHAR AS id, l_linenumber::BIGINT AS pos,
  md5(concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, epoch_ms(l_shipdate))) AS rev, l_returnflag = 'R' AS del, l_partkey AS seq FROM lineitem) GROUP BY id, pos, rev)"""
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY id ORDER BY del, pos DESC, rev DESC) AS k FROM {_LEAVES})"


@query("revs_winner", f"SELECT id, pos, rev, del AS deleted FROM {_RANKED} WHERE k = 1")
def _(spark, d):
    return rv.winners(_leaves(spark, d)).select("id", "pos", F.col("path")[0].alias("rev"), "deleted")


@query("revs_conflicts", f"SELECT id, count(*) FILTER (k > 1 AND NOT del) AS n, coalesce(string_agg(pos || '-' || rev, ',' ORDER BY pos DESC, rev DESC) FILTER (k > 1 AND NOT del), '') AS revs FROM {_RANKED} GROUP BY id")
def _(spark, d):
    c = rv.conflicts(_leaves(spark, d))
    return c.select("id", F.size("_conflicts").cast("long").alias("n"), F.array_join("_conflicts", ",").alias("revs"))


@query("revs_deleted_conflicts", f"SELECT id, count(*) FILTER (k > 1 AND del) AS n FROM {_RANKED} GROUP BY id")
def _(spark, d):
    return rv.conflicts(_leaves(spark, d)).select("id", F.size("_deleted_conflicts").cast("long").alias("n"))


@query("revs_all", f"SELECT id, count(*) AS n FROM (SELECT DISTINCT id, pos, rev FROM {_LEAVES}) GROUP BY id")
def _(spark, d):
    return rv.all_revs(_leaves(spark, d)).groupBy("id").agg(F.count("*").alias("n"))


@query("revs_diff", "SELECT d.doc_id::VARCHAR AS id, 1::BIGINT AS n_missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, d):
    rev = lambda c: F.md5(c.cast("string").cast("binary"))
    have = read(spark, d, "labels").select("doc_id").distinct().select(F.col("doc_id").cast("string").alias("id"), F.lit(1).cast("long").alias("pos"), F.array(rev(F.col("doc_id"))).alias("path"))
    asked = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("1-"), rev(F.col("doc_id"))).alias("rev"))
    return rv.revs_diff(have, asked).select("id", F.size("missing").cast("long").alias("n_missing"))


@query("possible_ancestors", f"SELECT id, count(*) AS n FROM {_LEAVES} WHERE pos < 5 AND CAST(id AS BIGINT) % 3 = 0 GROUP BY id")
def _(spark, d):
    leaves = _leaves(spark, d)
    asked = leaves.select("id").distinct().where(F.col("id").cast("long") % 3 == 0).select("id", F.lit("5-unknown").alias("rev"))
    return rv.revs_diff(leaves, asked).where("possible_ancestors is not null").select("id", F.size("possible_ancestors").cast("long").alias("n"))


@query("possible_ancestors_all", f"SELECT id, count(*) AS n FROM {_LEAVES} WHERE pos < 5 GROUP BY id")
def _(spark, d):
    leaves = _leaves(spark, d)
    asked = leaves.select("id").distinct().select("id", F.lit("5-unknown").alias("rev"))
    return rv.revs_diff(leaves, asked).where("possible_ancestors is not null").select("id", F.size("possible_ancestors").cast("long").alias("n"))


@query("bulk_get", f"SELECT k.n, k.id, r.pos || '-' || r.rev AS found, CASE WHEN r.id IS NULL THEN 'not_found' END AS error FROM (SELECT o_orderkey AS n, (o_orderkey * 2)::VARCHAR AS id FROM orders) k LEFT JOIN (SELECT * FROM {_RANKED} WHERE k = 1 AND NOT del) r ON r.id = k.id")
def _(spark, d):
    asked = read(spark, d, "orders").select(F.col("o_orderkey").alias("n"), (F.col("o_orderkey") * 2).cast("string").alias("id"), F.lit(None).cast("string").alias("rev"))
    return rv.bulk_get(_leaves(spark, d), asked).select("n", "id", "found", "error")


@query("purge_reelect", f"SELECT id, pos, rev, del AS deleted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY del, pos DESC, rev DESC) AS k2 FROM {_RANKED} WHERE k > 1) WHERE k2 = 1")
def _(spark, d):
    leaves = _leaves(spark, d)
    asked = rv.winners(leaves).select("id", rv.rev_text(F.col("pos"), rv.leaf_rev()).alias("rev"))
    return rv.winners(rv.purge(leaves, asked, 10**6)[0]).select("id", "pos", F.col("path")[0].alias("rev"), "deleted")


@query("revs_stem", f"SELECT id, count(*) AS n, sum(least(pos, 2)) AS kept FROM {_LEAVES} GROUP BY id")
def _(spark, d):
    deep = _leaves(spark, d).withColumn("path", F.transform(F.sequence(F.lit(1).cast("long"), F.col("pos")), lambda k: F.concat(F.col("path")[0], k.cast("string"))))
    return rv.stem(deep, 2).groupBy("id").agg(F.count("*").alias("n"), F.sum(F.size("path").cast("long")).alias("kept"))


# histories: an order has a revision for each of its lines, in a row; each third order has a second leaf that leaves the row after its first revision


def _histories(spark, d):
    t = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("k")).select(F.col("l_orderkey").cast("string").alias("id"), "l_orderkey", "k")
    rev = lambda n: F.md5(F.concat_ws("-", "id", n.cast("string")))
    row = F.transform(F.sequence(F.col("k"), F.lit(1), F.lit(-1)), rev)
    facts = [F.lit(False).alias("deleted"), F.col("l_orderkey").alias("seq"), F.col("k").alias("body")]
    main = t.select("id", F.col("k").cast("long").alias("pos"), row.alias("path"), *facts)
    side = t.where("l_orderkey % 3 = 0").select("id", F.lit(2).cast("long").alias("pos"), F.array(F.lit("side"), rev(F.lit(1))).alias("path"), *facts)
    return main.union(side)


_ROWS = "(SELECT l_orderkey::VARCHAR AS id, l_orderkey, count(*) AS k FROM lineitem GROUP BY l_orderkey)"
_REVS = f"(SELECT id, k, n AS pos, md5(id || '-' || n) AS rev FROM {_ROWS}, LATERAL (SELECT unnest(range(1, k + 1)) AS n))"


@query("histories_all_revs", f"SELECT id, pos, rev FROM {_REVS} UNION ALL SELECT id, 2, 'side' FROM {_ROWS} WHERE l_orderkey % 3 = 0")
def _(spark, d):
    return rv.all_revs(_histories(spark, d))


@query("histories_diff", f"SELECT id, CASE WHEN k < 3 THEN '3-' || md5(id || '-3') || ',' ELSE '' END || '9-x' AS missing, nullif(array_to_string(list_sort(list_filter([CASE WHEN k < 9 THEN k || '-' || md5(id || '-' || k) END, CASE WHEN l_orderkey % 3 = 0 THEN '2-side' END], lambda x: x IS NOT NULL)), ','), '') AS possible FROM {_ROWS}")
def _(spark, d):
    leaves = _histories(spark, d)
    asked = leaves.select("id").distinct().select("id", F.explode(F.array(F.concat(F.lit("3-"), F.md5(F.concat("id", F.lit("-3")))), F.lit("9-x"))).alias("rev"))
    return rv.revs_diff(leaves, asked).select("id", F.array_join("missing", ",").alias("missing"), F.array_join("possible_ancestors", ",").alias("possible"))


@query("histories_latest", f"SELECT id, k || '-' || md5(id || '-' || k) AS found, k AS body FROM {_ROWS} UNION ALL SELECT id, '2-side', k FROM {_ROWS} WHERE l_orderkey % 3 = 0")
def _(spark, d):
    leaves = _histories(spark, d)
    asked = leaves.select("id").distinct().select(F.col("id").cast("long").alias("n"), "id", F.concat(F.lit("1-"), F.md5(F.concat("id", F.lit("-1")))).alias("rev"))
    return rv.bulk_get(leaves, asked, latest=True).select("id", "found", F.col("body").cast("long").alias("body"))


@query("histories_merge", f"SELECT id, k AS pos, string_agg(rev, ',' ORDER BY pos DESC) AS path FROM {_REVS} GROUP BY id, k")
def _(spark, d):
    from .operators.writes import merge_revs

    whole = _histories(spark, d).where(F.col("path")[0] != "side")
    # each second order lacks its last revision, which comes with its parent only
    late = (F.col("seq") % 2 == 0) & (F.col("pos") > 1)
    old = whole.withColumns({"path": F.when(late, F.slice("path", 2, 100)).otherwise(F.col("path")), "pos": F.col("pos") - late.cast("long")})
    new = whole.where(late).withColumn("path", F.slice("path", 1, 2))
    return merge_revs(old, new, 10**9)[0].select("id", "pos", F.array_join("path", ",").alias("path"))


@query("changes_all_revs", "SELECT user_id::VARCHAR AS id, string_agg((event_id + 1) || '-' || md5(event_id::VARCHAR), ',' ORDER BY event_type = 'error', event_id DESC) AS changes FROM events GROUP BY user_id")
def _(spark, d):
    return ch.changes(_events(spark, d), style="all_docs").select("id", F.array_join("changes", ",").alias("changes"))


@query("db_info", f"SELECT count(*) FILTER (NOT del) AS doc_count, count(*) FILTER (del) AS doc_del_count, (SELECT max(seq) FROM {_LEAVES}) AS update_seq, (SELECT count(*) FROM {_LEAVES}) AS leaf_count, (SELECT count(*) * 100 FROM {_LEAVES})::BIGINT AS active_size FROM {_RANKED} WHERE k = 1")
def _(spark, d):
    return rv.db_info(_leaves(spark, d))


def _customers(spark, d):
    t = read(spark, d, "customer")
    return t.select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("id"), F.lit(1).cast("long").alias("pos"), F.array(F.md5("c_name")).alias("path"), (F.col("c_acctbal") < 0).alias("deleted"), F.col("c_custkey").alias("seq"))


_CUSTOMERS = "(SELECT lpad(c_custkey::VARCHAR, 8, '0') AS id, '1-' || md5(c_name) AS rev, c_acctbal < 0 AS deleted FROM customer)"


@query("all_docs_range", f"SELECT id, rev FROM {_CUSTOMERS} WHERE NOT deleted AND id >= '00000100' AND id < '00000900' ORDER BY id LIMIT 200 OFFSET 5")
def _(spark, d):
    return rv.all_docs(_customers(spark, d), "00000100", "00000900", inclusive_end=False, skip=5, limit=200)[0]


@query("all_docs_desc", f"SELECT id, rev FROM {_CUSTOMERS} WHERE NOT deleted AND id <= '00000900' AND id >= '00000100' ORDER BY id DESC LIMIT 100")
def _(spark, d):
    return rv.all_docs(_customers(spark, d), "00000900", "00000100", descending=True, limit=100)[0]


@query("all_docs_keys", f"SELECT n, k.id, c.rev, c.deleted, CASE WHEN c.id IS NULL THEN 'not_found' END AS error FROM (SELECT o_orderkey AS n, lpad(((o_orderkey * 7) % 3000)::VARCHAR, 8, '0') AS id FROM orders) k LEFT JOIN {_CUSTOMERS} c ON c.id = k.id")
def _(spark, d):
    keys = read(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.lpad((F.col("o_orderkey") * 7 % 3000).cast("string"), 8, "0").alias("id"))
    return rv.all_docs_keys(_customers(spark, d), keys)


# changes: each event is an update of its user


def _events(spark, d):
    return read(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), (F.col("event_id") + 1).alias("pos"), F.array(F.md5(F.col("event_id").cast("string").cast("binary"))).alias("path"), (F.col("event_type") == "error").alias("deleted"), (F.col("event_id") + 1).alias("seq"), F.struct("event_type", "value").alias("body"))


_WON = "(SELECT user_id::VARCHAR AS id, max(event_id) + 1 AS seq, max(event_id) FILTER (event_type <> 'error') AS live, max(event_id) AS last FROM events GROUP BY user_id)"
_FEED = f"(SELECT w.id, w.seq, coalesce(live, last) AS e FROM {_WON} w)"


@query("changes_since", f"SELECT seq, id FROM {_FEED} WHERE seq > (SELECT 100) ORDER BY seq")
def _(spark, d):
    return ch.changes(_events(spark, d), 100).select("seq", "id")


@query("changes_latest", f"SELECT id, seq, (e + 1) || '-' || md5(e::VARCHAR) AS rev FROM {_FEED}")
def _(spark, d):
    return ch.changes(_events(spark, d)).select("id", "seq", F.col("changes")[0].alias("rev"))


@query("changes_all_docs", "SELECT user_id::VARCHAR AS id, count(*) AS n FROM events GROUP BY user_id")
def _(spark, d):
    return ch.changes(_events(spark, d), style="all_docs").select("id", F.size("changes").cast("long").alias("n"))


@query("changes_selector", f"SELECT f.id, f.seq FROM {_FEED} f JOIN events x ON x.event_id = f.e WHERE x.event_type = 'click'")
def _(spark, d):
    return ch.changes(_events(spark, d), selector={"event_type": "click"}).select("id", "seq")


@query("changes_doc_ids", f"SELECT id, seq FROM {_FEED} WHERE id IN ('1', '2', '3', '5', '8')")
def _(spark, d):
    return ch.changes(_events(spark, d), doc_ids=["1", "2", "3", "5", "8"]).select("id", "seq")


@query("jsfilter", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id <> 5")
def _(spark, d):
    t = read(spark, d, "events")
    return t.where(condition(t, js_filter("function(doc, req) { return doc.event_type === req.query.t && doc.user_id !== 5; }", {"t": "click"}))).select("event_id")


# writes and replication


@query("replicate_delta", "SELECT doc_id::VARCHAR AS id, n_chars + 1 AS seq FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    rev = F.array(F.md5(F.col("doc_id").cast("string").cast("binary")))
    leaf = [F.col("doc_id").cast("string").alias("id"), F.lit(1).cast("long").alias("pos"), rev.alias("path"), F.lit(False).alias("deleted")]
    source = read(spark, d, "documents").select(*leaf, (F.col("n_chars") + 1).alias("seq"))
    target = read(spark, d, "labels").select("doc_id").distinct().select(*leaf, F.lit(1).cast("long").alias("seq"))
    return delta(source, target).select("id", "seq")


@query("merge_upsert", "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END::BIGINT AS pos, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS body FROM orders")
def _(spark, d):
    from .operators.writes import merge_revs

    t = read(spark, d, "orders")
    old = t.select(F.col("o_orderkey").cast("string").alias("id"), F.lit(1).cast("long").alias("pos"), F.array(F.lit("a")).alias("path"), F.lit(False).alias("deleted"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("body"))
    new = old.where(F.col("seq") % 10 == 0).withColumns({"pos": F.lit(2).cast("long"), "path": F.array(F.lit("b"), F.lit("a")), "body": F.col("body") + 1})
    return rv.winners(merge_revs(old, new, 10**9)[0]).select("id", "pos", "body")


@query("save_outcomes", "SELECT o_orderkey::VARCHAR AS id, o_orderkey % 3 <> 1 AS ok, CASE WHEN o_orderkey % 3 = 1 THEN 'conflict' END AS error FROM orders")
def _(spark, d):
    from .operators.writes import save

    t = read(spark, d, "orders")
    old = t.where("o_orderkey % 3 <> 2").select(F.col("o_orderkey").cast("string").alias("id"), F.lit(1).cast("long").alias("pos"), F.array(F.lit("a")).alias("path"), F.lit(False).alias("deleted"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("body"))
    docs = t.select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "1-a").alias("rev"), F.lit(False).alias("deleted"), F.col("o_totalprice").alias("body"))
    return save(old, docs, 10**9)[1].select("id", "ok", "error")


@query("validator", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_custkey > 100 THEN 'soft delete requires db object (with ownership metadata)' WHEN o_orderkey % 4 = 1 AND o_custkey > 100 THEN 'soft delete requires db.CreatedByUid when the old document had one' WHEN o_orderkey % 4 = 2 THEN 'soft delete must preserve db.DocType' END AS reason FROM orders")
def _(spark, d):
    key, user = F.col("o_orderkey") % 4, F.when(F.col("o_custkey") > 100, F.col("o_custkey").cast("string")).otherwise("")
    t = read(spark, d, "orders").select("o_orderkey", F.struct(user.alias("CreatedByUid"), F.lit("order").alias("DocType")).alias("old"), F.when(key != 0, F.struct(F.when(key != 1, user).otherwise("").alias("CreatedByUid"), F.when(key != 2, "order").alias("DocType"))).alias("new"))
    return t.select("o_orderkey", validate.keeps_ownership(F.col("new"), F.col("old"), t.schema["old"].dataType).alias("reason"))


# documents as readers see them


# of an order with a row of at most two revisions the second leaf wins, if it has one
_SIDE = "k <= 2 AND id::BIGINT % 3 = 0"


@query("documents_assembled", f"SELECT id AS _id, CASE WHEN {_SIDE} THEN '2-side' ELSE k || '-' || md5(id || '-' || k) END AS _rev, k AS body, CASE WHEN {_SIDE} THEN 2 ELSE k END AS start, CASE WHEN {_SIDE} THEN 'side,' || md5(id || '-1') ELSE string_agg(rev, ',' ORDER BY pos DESC) END AS ids FROM {_REVS} GROUP BY id, k")
def _(spark, d):
    t = dc.assemble(_histories(spark, d), revs=True)
    return t.select("_id", "_rev", F.col("body").cast("long").alias("body"), "_revisions.start", F.array_join("_revisions.ids", ",").alias("ids"))


@query("documents_open_revs", f"SELECT r.id AS _id, r.pos || '-' || r.rev AS _rev, coalesce((SELECT string_agg(o.pos || '-' || o.rev, ',' ORDER BY o.pos DESC, o.rev DESC) FROM {_RANKED} o WHERE o.id = r.id AND NOT o.del AND (o.pos <> r.pos OR o.rev <> r.rev)), '') AS conflicts, coalesce((SELECT string_agg(o.pos || '-' || o.rev, ',' ORDER BY o.pos DESC, o.rev DESC) FROM {_RANKED} o WHERE o.id = r.id AND o.del AND (o.pos <> r.pos OR o.rev <> r.rev)), '') AS deleted_conflicts FROM {_LEAVES} r")
def _(spark, d):
    leaves = _leaves(spark, d).withColumn("body", F.lit(None).cast("string"))
    asked = leaves.select("id", rv.rev_text(F.col("pos"), rv.leaf_rev()).alias("rev"))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return dc.assemble(leaves, asked, conflicts=True).select("_id", "_rev", text("_conflicts").alias("conflicts"), text("_deleted_conflicts").alias("deleted_conflicts"))


@query("dump_lines", f"SELECT '{{\"_id\":\"' || id || '\",\"_rev\":\"' || CASE WHEN {_SIDE} THEN '2-side' ELSE k || '-' || md5(id || '-' || k) END || '\",\"lines\":' || k || '}}' AS value FROM {_ROWS}")
def _(spark, d):
    return dc.dump(_histories(spark, d).withColumn("body", F.struct(F.col("body").alias("lines"))))


@query("changes_lines", f"SELECT seq, '{{\"seq\":' || seq || ',\"id\":\"' || id || '\",\"rev\":\"' || (e + 1) || '-' || md5(e::VARCHAR) || '\"' || CASE WHEN NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id = e AND x.event_type <> 'error') THEN ',\"deleted\":true' ELSE '' END || '}}' AS value FROM {_FEED}")
def _(spark, d):
    return ch.changes_lines(_events(spark, d))


def _with_files(spark, d):
    t = read(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.lit(1).cast("long").alias("pos"), F.array(F.lit("a")).alias("path"), F.lit(False).alias("deleted"), F.col("doc_id").alias("seq"), F.col("lang").alias("body"), "text")
    entry = dc.attachment(F.lit("text/plain"), F.col("text").cast("binary"), F.lit(1))
    return t.select("id", "pos", "path", "deleted", "seq", "body", F.map_from_entries(F.array(F.struct(F.lit("text").alias("name"), entry.alias("a")))).alias("attachments"))


@query("attachment_read", "SELECT doc_id::VARCHAR AS id, strlen(text)::BIGINT AS length, 'md5-' || to_base64(unhex(md5(text))) AS digest, md5(text) AS content FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    leaves = _with_files(spark, d)
    return dc.get_attachments(leaves, leaves.select("id", F.lit("text").alias("name"))).select("id", "length", "digest", F.md5("data").alias("content"))


@query("attachment_put", "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN 'note:2' WHEN doc_id % 3 = 1 THEN 'note:2,text:1' ELSE 'text:1' END AS names, lang AS body FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    leaves = _with_files(spark, d)
    kind = F.col("seq") % 3
    put = leaves.where(kind < 2).select("id", F.lit("1-a").alias("rev"), F.lit("note").alias("name"), F.lit("text/plain").alias("content_type"), F.col("body").cast("binary").alias("data"))
    gone = leaves.where(kind == 0).select("id", F.lit("1-a").alias("rev"), F.lit("text").alias("name"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("binary").alias("data"))
    after, _ = dc.put_attachments(leaves, put.union(gone), 10**9)
    names = F.array_sort(F.transform(F.map_entries("attachments"), lambda e: F.concat_ws(":", e["key"], e["value"]["revpos"].cast("string"))))
    return after.select("id", F.array_join(names, ",").alias("names"), "body")


@query("local_range", "SELECT '_local/' || lpad(c_custkey::VARCHAR, 8, '0') AS _id, '0-' || CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 1 END AS _rev, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'old' END AS body FROM customer WHERE c_custkey >= 10 AND c_custkey <= 900")
def _(spark, d):
    t = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("_local/"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("id"), "c_name")
    old = t.select("id", F.lit(1).cast("long").alias("n"), F.lit("old").alias("body"))
    twice = t.where("c_custkey % 2 = 0").select("id", "c_custkey", F.explode(F.array(F.lit("first"), F.col("c_name"))).alias("body"))
    docs = twice.select((F.col("c_custkey") * 2 + (F.col("body") != "first").cast("int")).alias("n"), "id", F.lit(None).cast("string").alias("rev"), F.lit(False).alias("deleted"), "body")
    none = spark.createDataFrame([], "id string, pos long, path array<string>, deleted boolean, seq long, body string")
    return dc.local_docs(dc.bulk_docs(none, old, docs, 1)[1], "_local/00000010", "_local/00000900")


@query("bulk_docs", "SELECT o_orderkey * 2 + k AS n, o_orderkey::VARCHAR AS id, k = 0 AS ok, CASE WHEN k = 1 THEN 'conflict' END AS error FROM orders, range(2) r(k) WHERE k = 0 OR o_orderkey % 5 = 0")
def _(spark, d):
    t = read(spark, d, "orders").select("o_orderkey", F.explode(F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k"))
    docs = t.select((F.col("o_orderkey") * 2 + F.col("k")).alias("n"), F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast("string").alias("rev"), F.lit(False).alias("deleted"), F.col("k").cast("string").alias("body"))
    none = spark.createDataFrame([], "id string, pos long, path array<string>, deleted boolean, seq long, body string")
    return dc.bulk_docs(none, none.select("id", F.col("pos").alias("n"), "body"), docs, 1)[2].select("n", "id", "ok", "error")


@query("dates", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS http FROM events")
def _(spark, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return read(spark, d, "events").select("event_id", iso8601(seconds).alias("iso"), http_date(seconds).alias("http"))


# documents by kind and range, nested forms, and what a sort asks


@query("sel_nested_form", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 50")
def _(spark, d):
    t = read(spark, d, "events").select("event_id", F.struct("event_type", "value").alias("doc"))
    return t.where(condition(t, {"doc": {"event_type": "click", "value": {"$gt": 50}}})).select("event_id")


@query("find_sort_existence", "SELECT o_orderkey, o_orderstatus AS open FROM orders WHERE o_orderstatus <> 'F'")
def _(spark, d):
    t = read(spark, d, "orders").withColumn("open", F.nullif("o_orderstatus", F.lit("F")))
    return _every(Collection(t, "o_orderkey"), {"selector": {}, "sort": ["open"], "fields": ["o_orderkey", "open"]})


@query("find_or_indexed", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 300000 OR o_totalprice >= 200000 AND o_totalprice < 210000")
def _(spark, d):
    either = [{"o_totalprice": {"$gte": 300000}}, {"o_totalprice": {"$gte": 200000, "$lt": 210000}}]
    return _every(_indexed(spark, d, "price", _orders(spark, d), ["o_totalprice"]), {"selector": {"$or": either}, "fields": ["o_orderkey", "o_totalprice"]})


@query("id_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 4000")
def _(spark, d):
    return _orders(spark, d).id_range(100, 4000).select("o_orderkey", "o_custkey")


def _designs(spark, d):
    name = F.concat(F.when(F.col("o_orderstatus") == "P", "_design/").otherwise(""), F.col("o_orderkey").cast("string"))
    return Collection(read(spark, d, "orders").select(name.alias("_id"), (F.col("o_totalprice") < 100000).alias("gone")), "_id", deleted="gone")


query("design_docs", "SELECT '_design/' || o_orderkey AS _id FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 100000")(lambda spark, d: _designs(spark, d).design_docs().select("_id"))
query("scan_live", "SELECT o_orderkey::VARCHAR AS _id FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 100000")(lambda spark, d: _designs(spark, d).scan().select("_id"))


@query("rev_parse", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey + 1)::BIGINT END AS pos, CASE WHEN o_orderstatus <> 'P' THEN 'r-' || o_orderstatus END AS rev FROM orders")
def _(spark, d):
    t = read(spark, d, "orders")
    p = rv.parse_rev(F.concat(F.when(F.col("o_orderstatus") == "P", "x").otherwise(""), (F.col("o_orderkey") + 1).cast("string"), F.lit("-r-"), "o_orderstatus"))
    return t.select("o_orderkey", p["pos"].alias("pos"), p["rev"].alias("rev"))


# more of revisions


@query("revs_missing", f"SELECT id, '9-unknown' AS missing FROM {_LEAVES} GROUP BY id")
def _(spark, d):
    leaves = _leaves(spark, d)
    asked = leaves.select("id", rv.rev_text(F.col("pos"), rv.leaf_rev()).alias("rev")).union(leaves.select("id", F.lit("9-unknown")))
    return rv.missing_revs(leaves, asked).select("id", F.array_join("missing", ",").alias("missing"))


@query("revs_deleted_conflicts_all", f"SELECT id, coalesce(string_agg(pos || '-' || rev, ',' ORDER BY pos DESC, rev DESC) FILTER (k > 1 AND del), '') AS revs FROM {_RANKED} GROUP BY id")
def _(spark, d):
    return rv.conflicts(_leaves(spark, d)).select("id", F.array_join("_deleted_conflicts", ",").alias("revs"))


@query("histories_descendants", f"SELECT id, k AS pos, md5(id || '-' || k) AS leaf FROM {_ROWS} UNION ALL SELECT id, 2, 'side' FROM {_ROWS} WHERE l_orderkey % 3 = 0")
def _(spark, d):
    leaves = _histories(spark, d)
    first = leaves.select("id", F.lit(1).cast("long").alias("pos"), F.md5(F.concat("id", F.lit("-1"))).alias("rev")).distinct()
    return rv.descendants(leaves, first).select("id", "pos", F.col("path")[0].alias("leaf"))


@query("histories_stem", f"SELECT id, string_agg(rev, ',' ORDER BY pos DESC) AS path FROM {_REVS} WHERE pos > k - 2 GROUP BY id UNION ALL SELECT id, 'side,' || md5(id || '-1') FROM {_ROWS} WHERE l_orderkey % 3 = 0")
def _(spark, d):
    return rv.stem(_histories(spark, d), 2).select("id", F.array_join("path", ",").alias("path"))


@query("histories_graft", f"SELECT id, k AS pos, string_agg(rev, ',' ORDER BY pos DESC) AS path FROM {_REVS} GROUP BY id, k")
def _(spark, d):
    from .operators.writes import merge_revs

    # the known path is the lower part of the row, what comes in is the upper part; they meet in one revision
    whole = _histories(spark, d).where(F.col("path")[0] != "side")
    half = F.floor((F.col("pos") + 1) / 2)
    old = whole.withColumns({"path": F.slice("path", (F.col("pos") - half + 1).cast("int"), half.cast("int")), "pos": half})
    new = whole.withColumn("path", F.slice("path", F.lit(1), (F.col("pos") - half + 1).cast("int")))
    return merge_revs(old, new, 10**9)[0].select("id", "pos", F.array_join("path", ",").alias("path"))


@query("histories_verify", f"SELECT count(*) AS docs, (count(*) + count(*) FILTER (l_orderkey % 3 = 0))::BIGINT AS leaves, true AS seqs_unique, (sum(k) + 2 * count(*) FILTER (l_orderkey % 3 = 0))::BIGINT AS path_revs, bool_and(l_orderkey % 3 <> 0 OR k >= 1) AS paths_sound FROM {_ROWS}")
def _(spark, d):
    return rv.verify(_histories(spark, d))


@query("purge_seq", f"SELECT (10 + count(*))::BIGINT AS purge_seq FROM {_RANKED} WHERE k = 1")
def _(spark, d):
    leaves = _leaves(spark, d)
    asked = rv.winners(leaves).select("id", rv.rev_text(F.col("pos"), rv.leaf_rev()).alias("rev"))
    return rv.purge_seq(rv.purge_log(rv.purge(leaves, asked, 10**6)[1], 10))


@query("changes_docs", f"SELECT f.id, f.seq, x.event_type, x.value FROM {_FEED} f JOIN events x ON x.event_id = f.e")
def _(spark, d):
    return ch.changes(_events(spark, d), include_docs=True).select("id", "seq", "doc.event_type", "doc.value")


@query("changes_limit", f"SELECT id, seq FROM {_FEED} ORDER BY seq LIMIT 25")
def _(spark, d):
    return ch.changes(_events(spark, d), limit=25).select("id", "seq")


@query("save_delete", "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END::BIGINT AS pos, o_orderstatus = 'F' AS deleted FROM orders")
def _(spark, d):
    from .operators.writes import save

    t = read(spark, d, "orders")
    old = t.select(F.col("o_orderkey").cast("string").alias("id"), F.lit(1).cast("long").alias("pos"), F.array(F.lit("a")).alias("path"), F.lit(False).alias("deleted"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("body"))
    # a tombstone needs the revision that it follows
    docs = t.select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "1-a").alias("rev"), F.lit(True).alias("deleted"), F.lit(None).cast(t.schema["o_totalprice"].dataType).alias("body"))
    return rv.winners(save(old, docs, 10**9)[0].drop("body")).select("id", "pos", "deleted")


@query("local_save", "SELECT c_custkey::VARCHAR AS id, CASE WHEN o.k IS NULL THEN 3 ELSE 4 END::BIGINT AS n FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON k = c_custkey")
def _(spark, d):
    from .operators.writes import save_local

    local = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit(3).cast("long").alias("n"), F.col("c_name").alias("body"))
    docs = read(spark, d, "orders").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_custkey").cast("string").alias("id")).distinct()
    return save_local(local, docs.withColumn("body", F.lit("again"))).select("id", "n")


def event_registry() -> proto.Registry:
    """message Event { int64 event_id = 1; string kind = 2; double value = 3; }"""
    from google.protobuf import descriptor_pb2

    f = descriptor_pb2.FileDescriptorProto(name="event.proto", package="tarn", syntax="proto3")
    m = f.message_type.add(name="Event")
    for k, (name, t) in enumerate((("event_id", 3), ("kind", 9), ("value", 1)), 1):
        m.field.add(name=name, number=k, type=t, label=1, json_name=name)
    return proto.Registry(descriptor_pb2.FileDescriptorSet(file=[f]).SerializeToString())


@query("proto_match", "SELECT event_id FROM events WHERE event_type = 'click' AND CASE WHEN event_id % 2 = 0 THEN 0 ELSE value END >= 0")
def _(spark, d):
    registry = event_registry()

    @F.pandas_udf("binary")
    def encode(ids: pd.Series, kinds: pd.Series, values: pd.Series) -> pd.Series:
        m = registry.message("tarn.Event")
        return pd.Series([m(event_id=i, kind=k, value=0.0 if i % 2 == 0 else v).SerializeToString() for i, k, v in zip(ids, kinds, values)])

    t = read(spark, d, "events").select("event_id", encode("event_id", "event_type", "value").alias("pb_body"), F.lit("tarn.Event").alias("pb_type"))
    t = t.select("event_id", proto.document(registry, F.col("pb_type"), F.col("pb_body")).alias("doc"))
    return t.where(condition(t, {"kind": "click", "value": {"$gte": 0}}, body="doc")).select("event_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query end to end: parse, compile, push down, sort, limit."""
    q = {"selector": {"o_orderstatus": "F", "o_totalprice": {"$gte": 400000}}, "fields": ["o_orderkey", "o_totalprice"], "sort": [{"o_totalprice": "desc"}], "limit": 50}
    return find(Collection(read(spark, sf_dir, "orders"), "o_orderkey"), q).df
