"""Replication between stores of leaves: changes since the checkpoint, less what the target has, merged into it."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.revisions import all_revs, leaf_rev
from ..operators.writes import Store, merge_revs
from .changes import changes

HISTORY = 50


def replication_id(source: str, target: str, doc_ids: list[str] | None = None, selector: dict | None = None, winning_revs_only: bool = False) -> str:
    """Names a replication by what it does."""
    what = {"source": source, "target": target, "doc_ids": sorted(doc_ids) if doc_ids is not None else None, "selector": selector, "winning_revs_only": winning_revs_only}
    return hashlib.md5(json.dumps(what, sort_keys=True).encode()).hexdigest()


def delta(source: DataFrame, target: DataFrame, since: int = 0, doc_ids: list[str] | None = None, selector: dict | None = None, winning_revs_only: bool = False) -> DataFrame:
    """Leaves of the source that changed after since, pass the filter, and are in no history of the target."""
    ids = changes(source, since, doc_ids=doc_ids, selector=selector, style="main_only").select("id", F.col("changes")[0].alias("_won"))
    rows = source.join(ids, "id")
    if winning_revs_only:
        rows = rows.where(F.concat_ws("-", F.col("pos").cast("string"), leaf_rev()) == F.col("_won"))
    known = all_revs(target).select("id", "pos", F.col("rev").alias("_leaf"))
    return rows.drop("_won").withColumn("_leaf", leaf_rev()).join(known, ["id", "pos", "_leaf"], "left_anti").select(*source.columns)


def common_seq(a: list[dict], b: list[dict]) -> int:
    """The last seq of the newest session that both histories hold."""
    known = {h["session_id"]: h["recorded_seq"] for h in b}
    return next((min(h["recorded_seq"], known[h["session_id"]]) for h in a if h["session_id"] in known), 0)


class Checkpoints:
    """Histories of replications, newest first, HISTORY long at most, beside a store; one small JSON text per replication."""

    def __init__(self, store: Store):
        self.store = store

    def _file(self, rep: str):
        return self.store._path(f"{self.store.path}/_local/{rep}.json")

    def load(self, rep: str) -> list[dict]:
        fs, path = self.store._fs, self._file(rep)
        if not fs.exists(path):
            return []
        return json.loads(self.store.spark.read.text(path.toString(), wholetext=True).first()[0])

    def save(self, rep: str, history: list[dict]) -> None:
        out = self.store._fs.create(self._file(rep), True)
        out.write(bytearray(json.dumps(history[:HISTORY]).encode()))
        out.close()


def replicate(source: Store, target: Store, **options) -> dict:
    """One pass: copies what the target lacks, commits it, and records the seq reached on both sides, the target first. A pass that fails leaves the old checkpoint, and repeating is harmless."""
    started, rep = time.time(), replication_id(source.path, target.path, **options)
    ours, theirs = Checkpoints(source).load(rep), Checkpoints(target).load(rep)
    since = common_seq(ours, theirs)
    have = source.read()
    if have is None:
        return {"replication_id": rep, "docs_written": 0, "last_seq": 0, "since": since}
    last = have.agg(F.max("seq")).first()[0] or 0
    held = target.read()
    held = held if held is not None else have.limit(0)
    missing = delta(have, held, since, **options)
    written = missing.count() if last > since else 0
    if written:
        top = held.agg(F.max("seq")).first()[0] or 0
        target.commit(merge_revs(held, missing, top + 1)[0])
    entry = {"session_id": uuid.uuid4().hex, "recorded_seq": last, "start_last_seq": since, "end_last_seq": last, "docs_written": written, "start_time": started, "end_time": time.time()}
    Checkpoints(target).save(rep, [entry, *theirs])
    Checkpoints(source).save(rep, [entry, *ours])
    return {"replication_id": rep, "docs_written": written, "last_seq": last, "since": since}
