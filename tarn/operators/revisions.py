"""Revisions: one row per leaf (id, pos, path, deleted, seq, body ...), path being the revision ids from the leaf back. Trees stay implicit; what asks about them is a join, an aggregate or an array function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVS_LIMIT = 1000


def leaf_rev() -> Column:
    return F.col("path")[0]


def rev_text(pos: Column, rev: Column) -> Column:
    return F.concat(pos.cast("string"), F.lit("-"), rev)


def parse_rev(text: Column) -> Column:
    """struct<pos, rev> of a text like 3-abc; null if it isn't one."""
    ok = text.rlike("^[1-9][0-9]{0,17}-.+")
    return F.when(ok, F.struct(F.substring_index(text, "-", 1).cast("long").alias("pos"), F.regexp_replace(text, "^[0-9]+-", "").alias("rev")))


def _order() -> Column:
    return F.struct((~F.col("deleted")).alias("live"), F.col("pos"), leaf_rev().alias("rev"))


def winners(leaves: DataFrame) -> DataFrame:
    """The winning leaf of each id: live before deleted, then the longest history, then the greatest revision id. Aggregated before the shuffle, so an id with many leaves isn't gathered; seq becomes the id's greatest. A condition on the id reaches the scan; who needs no bodies leaves them out before."""
    rest = [c for c in leaves.columns if c not in ("id", "seq")]
    best = leaves.groupBy("id").agg(F.max_by(F.struct(*rest), _order()).alias("w"), *([F.max("seq").alias("seq")] if "seq" in leaves.columns else []))
    return best.select(*[(F.col("w")[c] if c in rest else F.col(c)).alias(c) for c in leaves.columns])


def conflicts(leaves: DataFrame) -> DataFrame:
    """(id, _rev, _conflicts, _deleted_conflicts): the winner, and the other live and deleted leaves, greatest first."""
    every = leaves.select("id", _order().alias("o")).groupBy("id").agg(F.sort_array(F.collect_list("o"), asc=False).alias("all"))
    other = lambda live: F.transform(F.filter("all", lambda o, i: (i > 0) & (o["live"] == live)), lambda o: rev_text(o["pos"], o["rev"]))
    return every.select("id", rev_text(F.col("all")[0]["pos"], F.col("all")[0]["rev"]).alias("_rev"), other(True).alias("_conflicts"), other(False).alias("_deleted_conflicts"))


def bare(leaves: DataFrame) -> DataFrame:
    """leaves without bodies: what an election needs."""
    return leaves.select(*[c for c in ("id", "pos", "path", "deleted", "seq") if c in leaves.columns])


def all_revs(leaves: DataFrame) -> DataFrame:
    """(id, pos, rev) of all revisions, leaves and ancestors."""
    return leaves.select("id", "pos", F.posexplode("path").alias("back", "rev")).select("id", (F.col("pos") - F.col("back")).alias("pos"), "rev").distinct()


def revs_diff(leaves: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, missing, possible_ancestors) of asked (id, rev text): revisions that the leaves lack, and leaves that may be their ancestors. Ids that lack nothing are left out; texts that are no revisions count as missing."""
    wanted = asked.select("id", "rev", parse_rev(F.col("rev")).alias("p")).distinct()
    known = all_revs(leaves).select("id", rev_text(F.col("pos"), F.col("rev")).alias("rev"))
    missing = wanted.join(known, ["id", "rev"], "left_anti").groupBy("id").agg(F.sort_array(F.collect_set("rev")).alias("missing"), F.max("p.pos").alias("most"))
    near = missing.join(leaves.select("id", "pos", leaf_rev().alias("leaf")), "id").where(F.col("pos") < F.col("most"))
    near = near.groupBy("id").agg(F.sort_array(F.collect_set(rev_text(F.col("pos"), F.col("leaf")))).alias("possible_ancestors"))
    return missing.drop("most").join(near, "id", "left")


def missing_revs(leaves: DataFrame, asked: DataFrame) -> DataFrame:
    return revs_diff(leaves, asked).select("id", "missing")


def descendants(leaves: DataFrame, asked: DataFrame) -> DataFrame:
    """Leaves whose history holds an asked revision (id, pos, rev), with it as asked."""
    a = asked.select("id", F.col("pos").alias("_pos"), F.col("rev").alias("_rev"))
    return leaves.join(a, "id").where(F.get(F.col("path"), (F.col("pos") - F.col("_pos")).cast("int")) == F.col("_rev")).where("pos >= _pos")


def bulk_get(leaves: DataFrame, asked: DataFrame, latest: bool = False) -> DataFrame:
    """One row or more per row of asked (n, id, rev text or null): n, id, rev, found revision, deleted, body (if there) and error. Without a rev the live winner; with one that leaf or ancestor (an ancestor has no body), with latest its leaves."""
    has_body = "body" in leaves.columns
    body = F.col("body") if has_body else F.lit(None).cast("string")
    a = asked.select("n", "id", "rev", parse_rev(F.col("rev")).alias("p"))
    leaves = leaves.join(asked.select("id").distinct(), "id", "left_semi")
    won = winners(leaves).where(~F.col("deleted")).select("id", rev_text(F.col("pos"), leaf_rev()).alias("found"), "deleted", body.alias("body"))
    plain = a.where("rev is null").join(won, "id", "left")
    rows = a.where("rev is not null").join(leaves.select("id", "pos", "path", "deleted", body.alias("body")), "id", "left")
    hit = F.coalesce((F.col("pos") >= F.col("p.pos")) & (F.get(F.col("path"), (F.col("pos") - F.col("p.pos")).cast("int")) == F.col("p.rev")), F.lit(False))
    top = F.col("pos") == F.col("p.pos")
    best = F.struct(F.lit(True).alias("ok"), F.when(F.lit(latest), rev_text(F.col("pos"), F.col("path")[0])).otherwise(F.col("rev")).alias("found"), F.when(F.lit(latest) | top, F.col("deleted")).alias("deleted"), F.when(F.lit(latest) | top, F.col("body")).alias("body"))
    got = rows.groupBy("n", "id", "rev").agg(F.collect_set(F.when(hit, best)).alias("got"))
    exact = got.select("n", "id", "rev", F.explode_outer("got").alias("g")).select("n", "id", "rev", "g.found", "g.deleted", "g.body").distinct()
    out = plain.select("n", "id", "rev", "found", "deleted", "body").unionByName(exact)
    error = F.when(F.coalesce(F.col("id"), F.lit("")) == "", "illegal_docid").when(F.col("found").isNull(), "not_found")
    return out.withColumn("error", error)


def all_docs(leaves: DataFrame, start: str | None = None, end: str | None = None, key: str | None = None, descending: bool = False, inclusive_end: bool = True, skip: int = 0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows (id, rev), total): live documents in a range of ids, and the one-row count of all live ones. Descending goes from start down to end."""
    live = winners(bare(leaves)).where(~F.col("deleted")).select("id", rev_text(F.col("pos"), leaf_rev()).alias("rev"))
    total, rows = live.agg(F.count("*").alias("total_rows")), live
    if key is not None:
        rows = rows.where(F.col("id") == key)
    else:
        low, high = (end, start) if descending else (start, end)
        if low is not None:
            rows = rows.where(F.col("id") >= low if inclusive_end or not descending else F.col("id") > low)
        if high is not None:
            rows = rows.where(F.col("id") <= high if inclusive_end or descending else F.col("id") < high)
    rows = rows.orderBy(F.col("id").desc() if descending else F.col("id").asc())
    rows = rows.offset(skip) if skip else rows
    return (rows if limit is None else rows.limit(limit)), total


def all_docs_keys(leaves: DataFrame, keys: DataFrame) -> DataFrame:
    """A row for each row of keys (n, id), in their order: id, rev, deleted, error. Tombstones are told, unknown ids are not_found."""
    won = winners(bare(leaves.join(keys.select("id").distinct(), "id", "left_semi"))).select("id", rev_text(F.col("pos"), leaf_rev()).alias("rev"), "deleted")
    return keys.join(won, "id", "left").select("n", "id", "rev", "deleted", F.when(F.col("rev").isNull(), "not_found").alias("error")).orderBy("n")


def stem(leaves: DataFrame, limit: int = REVS_LIMIT) -> DataFrame:
    return leaves.withColumn("path", F.slice("path", 1, limit))


def merge(leaves: DataFrame, incoming: DataFrame) -> DataFrame:
    """Leaves after a merge of incoming leaves of the same columns, all of them; merge_revs gives it only the ids it needs. A path that holds another's leaf replaces it; a stemmed path takes on the ancestors of a known path where they meet; of equal leaves the known one stays. Commutative up to that."""
    marked = leaves.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    one = marked.groupBy("id", "pos", leaf_rev().alias("_leaf")).agg(F.min_by(F.struct(*[F.col(c) for c in leaves.columns]), F.struct("_new", -F.size("path"))).alias("w"), F.max_by("path", F.size("path")).alias("_long"))
    one = one.select("id", "pos", "_leaf", *[F.col("w")[c].alias(c) for c in leaves.columns if c not in ("id", "pos", "path")], F.col("_long").alias("path"))
    # revisions without the paths they stand on, so a long history isn't repeated for each of them
    steps = one.select("id", "pos", "_leaf", F.size("path").alias("n"), F.posexplode("path").alias("back", "rev")).withColumn("at", F.col("pos") - F.col("back"))
    # grafting: the oldest revision of a path is extended by the longest history known there
    ends = one.withColumn("at", F.col("pos") - F.size("path") + 1).withColumn("rev", F.element_at("path", -1))
    met = steps.join(ends.select("id", "at", "rev").distinct(), ["id", "at", "rev"], "left_semi")
    most = met.groupBy("id", "at", "rev").agg(F.max(F.struct((F.col("n") - F.col("back")).alias("known"), "pos", "_leaf", "back")).alias("m")).where("m.known > 1")
    tails = most.select("id", "at", "rev", "m.pos", "m._leaf", "m.back").join(one.select("id", "pos", "_leaf", "path"), ["id", "pos", "_leaf"])
    tails = tails.select("id", "at", "rev", F.slice("path", F.col("back") + 2, F.size("path")).alias("tail"))
    grown = ends.join(tails, ["id", "at", "rev"], "left").withColumn("path", F.concat("path", F.coalesce("tail", F.array().cast("array<string>"))))
    # a revision that lies inside another path is no leaf
    inner = steps.where("back > 0").select("id", F.col("at").alias("pos"), F.col("rev").alias("_leaf")).distinct()
    return grown.join(inner, ["id", "pos", "_leaf"], "left_anti").select(*leaves.columns)


def purge(leaves: DataFrame, asked: DataFrame, next_seq: int) -> tuple[DataFrame, DataFrame]:
    """(leaves without the asked ones (id, rev text), purged (id, rev)): no tombstones; what is no leaf is ignored; ids that keep a leaf get a fresh seq each, from next_seq on."""
    rows = leaves.withColumn("_rev", rev_text(F.col("pos"), leaf_rev()))
    gone = asked.select("id", F.col("rev").alias("_rev")).distinct().join(rows.select("id", "_rev"), ["id", "_rev"], "left_semi")
    kept = rows.join(gone, ["id", "_rev"], "left_anti").drop("_rev")
    touched = gone.select("id").distinct().join(kept.select("id").distinct(), "id", "left_semi")
    fresh = numbered(touched, hashed(), [F.col("id")], next_seq, "_seq")
    out = kept.join(fresh, "id", "left").withColumn("seq", F.coalesce("_seq", "seq").cast("long")).select(*leaves.columns)
    return out, gone.select("id", F.col("_rev").alias("rev"))


def purge_log(purged: DataFrame, last: int = 0) -> DataFrame:
    """(purge_seq, id, rev) of purged leaves, numbered on from last."""
    return numbered(purged, hashed(), [F.col("id"), F.col("rev")], last + 1, "purge_seq").select("purge_seq", "id", "rev")


def purge_seq(log: DataFrame) -> DataFrame:
    """One row: the greatest purge_seq of a log, 0 if it is empty."""
    return log.agg(F.coalesce(F.max("purge_seq"), F.lit(0)).cast("long").alias("purge_seq"))


def numbered(rows: DataFrame, bucket: Column, order: list[Column], start: int, name: str) -> DataFrame:
    """rows with consecutive numbers from start, in the order of bucket and then order. Only the counts per bucket meet in one task."""
    from pyspark.sql import Window

    b = rows.withColumn("_b", bucket)
    before = F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    base = b.groupBy("_b").count().select("_b", F.coalesce(before, F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return b.join(base, "_b").withColumn(name, (F.col("_base") + place + F.lit(start - 1)).cast("long")).drop("_b", "_base")


def hashed(key: str = "id", buckets: int = 4096) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def db_info(leaves: DataFrame) -> DataFrame:
    """One row: doc_count, doc_del_count, update_seq, leaf_count, and active_size if leaves have size."""
    w = winners(bare(leaves)).agg(F.count_if(~F.col("deleted")).alias("doc_count"), F.count_if("deleted").alias("doc_del_count"), F.coalesce(F.max("seq"), F.lit(0)).alias("update_seq"))
    more = [F.count("*").alias("leaf_count")] + ([F.coalesce(F.sum("size"), F.lit(0)).alias("active_size")] if "size" in leaves.columns else [])
    return w.crossJoin(F.broadcast(leaves.agg(*more)))


def verify(leaves: DataFrame) -> DataFrame:
    """One row of checks: documents, leaves, revisions, and whether ids, paths and seqs are sound."""
    docs = leaves.groupBy("id").agg(F.max("seq").alias("seq"), F.count("*").alias("leaves"))
    a = docs.agg(F.count("*").alias("docs"), F.sum("leaves").alias("leaves"), (F.count("*") == F.count_distinct("seq")).alias("seqs_unique"))
    b = leaves.agg(F.sum(F.size("path")).alias("path_revs"), F.coalesce(F.bool_and((F.size("path") >= 1) & (F.size("path") <= F.col("pos"))), F.lit(True)).alias("paths_sound"))
    return a.crossJoin(F.broadcast(b))
