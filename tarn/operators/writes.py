"""Writes: interactive saves with outcomes, replicated merges, local documents, commits and compaction."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .revisions import bare, hashed, leaf_rev, merge, numbered, parse_rev, stem, winners


def save(leaves: DataFrame, docs: DataFrame, next_seq: int, validator: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(leaves after, outcomes (id, ok, rev, error, reason)) of saving docs (id, rev text or null, deleted, body), one row per id; leaves have id, pos, path, deleted, seq, body.

    No rev on a live document, or a rev that is no leaf, is a conflict; no rev on a tombstone makes its child; ids that start with _ but not _design/ are refused. validator(new body, old body) gives a reason to reject.
    """
    asked = docs.select("id", "rev", "deleted", F.col("body").alias("new"), parse_rev(F.col("rev")).alias("p"))
    # only the asked ids are elected
    won = winners(bare(leaves).join(docs.select("id").distinct(), "id", "left_semi")).select("id", F.col("pos").alias("wpos"), F.col("path").alias("wpath"), F.col("deleted").alias("wdel"))
    rows = asked.join(won, "id", "left")
    at = leaves.select("id", F.col("pos").alias("lpos"), F.col("path").alias("lpath"), F.col("deleted").alias("ldel"), F.col("body").alias("old"))
    # the parent: the leaf that rev names, or the winning tombstone where there is no rev
    want = F.when(F.col("rev").isNotNull(), F.struct(F.col("p.pos").alias("pos"), F.col("p.rev").alias("rev"))).when(F.col("wdel"), F.struct(F.col("wpos").alias("pos"), F.col("wpath")[0].alias("rev")))
    rows = rows.withColumn("want", want).alias("r")
    rows = rows.join(at.alias("l"), (F.col("r.id") == F.col("l.id")) & (F.col("want.pos") == F.col("lpos")) & (F.col("want.rev") == F.col("lpath")[0]), "left").drop(F.col("l.id"))
    bad_id = (F.col("id") == "") | F.col("id").startswith("_") & ~F.col("id").startswith("_design/")
    conflict = F.col("rev").isNotNull() & F.col("lpath").isNull() | F.col("rev").isNull() & F.col("wpath").isNotNull() & ~F.coalesce("wdel", F.lit(False))
    reason = validator(F.col("new"), F.when(~F.col("ldel"), F.col("old"))) if validator else F.lit(None).cast("string")
    reason = F.when(~F.coalesce("deleted", F.lit(False)), reason) if validator is None else reason
    error = F.when(F.coalesce(bad_id, F.lit(True)), "bad_request").when(conflict, "conflict").when(reason.isNotNull(), "forbidden")
    rows = rows.withColumn("error", error).withColumn("reason", F.when(F.col("error") == "forbidden", reason).when(F.col("error") == "conflict", "Document update conflict.").when(F.col("error") == "bad_request", "Only reserved document ids may start with underscore."))
    gone = F.coalesce("deleted", F.lit(False))
    pos = F.coalesce("lpos", F.lit(0)) + 1
    rev = F.md5(F.concat_ws("|", "id", gone.cast("string"), F.coalesce(F.concat_ws("-", F.col("lpos").cast("string"), F.col("lpath")[0]), F.lit("")), F.to_json(F.struct("new"))).cast("binary"))
    rows = rows.select("id", "error", "reason", gone.alias("gone"), "new", pos.alias("npos"), rev.alias("nrev"), "lpos", "lpath")
    good = rows.where("error is null")
    new = numbered(good, hashed(), [F.col("id")], next_seq, "_seq").select("id", F.col("npos").cast("long").alias("pos"), F.concat(F.array("nrev"), F.coalesce("lpath", F.array().cast("array<string>"))).alias("path"), F.col("gone").alias("deleted"), F.col("_seq").alias("seq"), F.col("new").alias("body"))
    parents = good.where("lpath is not null").select("id", F.col("lpos").alias("pos"), F.col("lpath")[0].alias("_leaf"))
    kept = leaves.withColumn("_leaf", leaf_rev()).join(parents, ["id", "pos", "_leaf"], "left_anti").select("id", "pos", "path", "deleted", "seq", "body")
    outcome = rows.select("id", F.col("error").isNull().alias("ok"), F.when(F.col("error").isNull(), F.concat_ws("-", F.col("npos").cast("string"), "nrev")).alias("rev"), "error", "reason")
    return stem(kept.unionByName(new)), outcome


def merge_revs(leaves: DataFrame, incoming: DataFrame, next_seq: int) -> tuple[DataFrame, DataFrame]:
    """(leaves after, errors (id, rev, error)) of a replicated write: histories are merged without conflict checks. Ids whose leaves change get one new seq each, from next_seq in order of their first incoming seq; a position shorter than its history is an error."""
    bad = F.size("path") > F.col("pos")
    errors = incoming.where(bad).select("id", F.concat_ws("-", F.col("pos").cast("string"), leaf_rev()).alias("rev"), F.lit("bad_request").alias("error"))
    new = incoming.where(~bad)
    # only the ids that come in are merged; all others stay as they are
    touched = new.select("id").distinct()
    before = leaves.join(touched, "id", "left_semi")
    after = merge(before, new)
    # a leaf that goes is inside a new one, so an id changes if it has a leaf that it hadn't, or of which less was known
    old = before.select("id", "pos", leaf_rev().alias("_leaf"), F.size("path").alias("_known"))
    marked = after.withColumn("_leaf", leaf_rev()).join(old, ["id", "pos", "_leaf"], "left")
    changed = marked.where(F.col("_known").isNull() | (F.col("_known") < F.size("path"))).select("id").distinct()
    order = changed.join(new.groupBy("id").agg(F.min("seq").alias("_first")), "id")
    # in blocks of the incoming seq, so that the order holds and no task numbers all ids
    fresh = numbered(order, F.floor(F.col("_first") / 65536), [F.col("_first"), F.col("id")], next_seq, "_seq").select("id", "_seq")
    out = after.join(fresh, "id", "left").withColumn("seq", F.coalesce("_seq", "seq").cast("long")).select(*leaves.columns)
    return stem(out).unionByName(leaves.join(touched, "id", "left_anti")), errors


def save_local(local: DataFrame, docs: DataFrame) -> DataFrame:
    """Local documents (id, n, body) after saving docs (id, body): n counts the saves; they take no part in replication."""
    new = docs.join(local.select("id", "n"), "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("n"), "body")
    return local.join(docs.select("id"), "id", "left_anti").unionByName(new)


class Store:
    """Versions of a table under one path: each commit writes a folder and then moves a pointer, so readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def read(self, version: int | None = None) -> DataFrame | None:
        known = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{known[-1] if version is None else version}") if known else None

    def commit(self, df: DataFrame) -> int:
        """Writes df as the next version. The rename of a folder is the pointer; if another writer was first, it fails."""
        version = (self.versions() or [0])[-1] + 1
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        df.write.parquet(draft)
        target = self._path(f"{self.path}/v{version}")
        if self._fs.exists(target) or not self._fs.rename(self._path(draft), target):
            self._fs.delete(self._path(draft), True)
            raise RuntimeError(f"version {version} was written by another writer")
        return version

    def compact(self, keep: int = 1) -> list[int]:
        """Drops all but the last versions."""
        old = self.versions()[:-keep]
        for v in old:
            self._fs.delete(self._path(f"{self.path}/v{v}"), True)
        return old
