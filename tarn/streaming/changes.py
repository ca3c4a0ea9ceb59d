"""The changes feed: documents in the order of their last update, one row each, in batches or as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.jsfilter import js_filter
from ..functions.paths import SelectorError
from ..operators.match import condition
from ..operators.revisions import bare, leaf_rev, rev_text, winners


def parse_since(since: object, last: int) -> int:
    """0, N, "N-anything" or "now"."""
    if since in (None, ""):
        return 0
    if since == "now":
        return last
    try:
        return int(str(since).split("-")[0])
    except ValueError as e:
        raise SelectorError(f"bad since: {since}") from e


@dataclass(frozen=True)
class Feed:
    rows: DataFrame
    last_seq: int
    pending: int


def changes(leaves: DataFrame, since: object = 0, limit: int | None = None, style: str = "main_only", doc_ids: list[str] | None = None, selector: dict | None = None, body: str = "body", include_docs: bool = False, descending: bool = False, js: str | None = None, query: dict | None = None) -> DataFrame:
    """Rows (seq, id, changes, deleted, and doc if asked) after since, in order. A selector sees the winner as a document, tombstones too. limit is 1 at least."""
    start = parse_since(since, 0) if since != "now" else None
    if start is None:
        start = leaves.agg(F.max("seq")).first()[0] or 0
    if doc_ids is not None:
        leaves = leaves.where(F.col("id").isin(doc_ids)) if len(doc_ids) <= 1000 else leaves.join(leaves.sparkSession.createDataFrame([(i,) for i in set(doc_ids)], "id string"), "id", "left_semi")
    if start > 0:
        # an id has changed if one of its leaves has: this condition reaches the scan, and only those ids are elected
        leaves = leaves.join(leaves.where(F.col("seq") > start).select("id").distinct(), "id", "left_semi")
    bodies = include_docs or selector is not None or js is not None
    rows = winners(leaves if bodies else bare(leaves))
    if js is not None:
        selector = js_filter(js, query)
    if selector is not None:
        kind = dict(leaves.dtypes)[body]
        if kind == "variant":
            rows = rows.where(condition(rows, selector, body=body))
        else:
            doc = rows.select("*", F.col("id").alias("_id"), F.when(F.col("deleted"), F.lit(True)).alias("_deleted"), *([f"{body}.*"] if kind.startswith("struct") else []))
            fields = ["_id", "_deleted", *(leaves.schema[body].dataType.names if kind.startswith("struct") else [])]
            view = doc.select(*[F.col(f"`{f}`") for f in dict.fromkeys(fields)])
            rows = doc.where(condition(view, selector)).select(*rows.columns)
    if style == "all_docs":
        order = F.struct((~F.col("deleted")).alias("live"), F.col("pos"), leaf_rev().alias("rev"))
        revs = leaves.groupBy("id").agg(F.sort_array(F.collect_list(order), asc=False).alias("o")).select("id", F.transform("o", lambda o: rev_text(o["pos"], o["rev"])).alias("changes"))
        rows = rows.join(revs, "id")
    else:
        rows = rows.withColumn("changes", F.array(rev_text(F.col("pos"), leaf_rev())))
    out = rows.select(F.col("seq"), "id", "changes", "deleted", *([F.col(body).alias("doc")] if include_docs else []))
    out = out.orderBy(F.col("seq").desc() if descending else F.col("seq").asc(), "id")
    return out if limit is None else out.limit(max(1, limit))


def feed(leaves: DataFrame, **options) -> Feed:
    """changes() with last_seq, and pending as the gap between it and the last update."""
    rows = changes(leaves, **options)
    top = leaves.agg(F.max("seq")).first()[0] or 0
    last = rows.agg(F.max("seq")).first()[0] if options.get("limit") is not None else top
    last = parse_since(options.get("since", 0), top) if last is None else last
    return Feed(rows, last, top - last)


def changes_lines(leaves: DataFrame, since: object = 0) -> DataFrame:
    """(seq, value): a JSON text {seq, id, rev, and deleted on tombstones} for each id that changed after since, in order."""
    rows = changes(leaves, since)
    return rows.select("seq", F.to_json(F.struct("seq", "id", F.col("changes")[0].alias("rev"), F.when(F.col("deleted"), F.lit(True)).alias("deleted"))).alias("value"))


def longpoll(read: Callable[[], DataFrame], since: object = "now", timeout: float = 60.0, poll: float = 0.5, **options) -> Feed:
    """feed() as soon as it has a row, else after the next write or the timeout, scanned once more. read gives the leaves of the moment; since "now" is the last update at the call."""
    leaves = read()
    top = leaves.agg(F.max("seq")).first()[0] or 0
    start = parse_since(since, top)
    got = feed(leaves, since=start, **options)
    end = time.monotonic() + timeout
    if not got.rows.isEmpty():
        return got
    while time.monotonic() < end:
        time.sleep(min(poll, max(0.0, end - time.monotonic())))
        leaves = read()
        if (leaves.agg(F.max("seq")).first()[0] or 0) > top:
            break
    return feed(leaves, since=start, **options)


def continuous(read: Callable[[], DataFrame], since: object = 0, timeout: float | None = 60.0, heartbeat: float | None = None, poll: float = 0.5, limit: int | None = None, **options) -> Iterator[Row | None]:
    """Rows of changes() as they come, without an end until limit rows were given or nothing came for timeout seconds. With heartbeat, None is given that often while nothing comes, and there is no timeout. Rows come through the driver, a partition at a time."""
    leaves = read()
    top = leaves.agg(F.max("seq")).first()[0] or 0
    at, left = parse_since(since, top), limit
    quiet = beat = time.monotonic()
    while True:
        top = leaves.agg(F.max("seq")).first()[0] or 0
        if top > at:
            for row in changes(leaves, at, limit=left, **options).toLocalIterator():
                yield row
                quiet = beat = time.monotonic()
                if left is not None:
                    left -= 1
            if left is not None and left <= 0:
                return
            at = top
        now = time.monotonic()
        if heartbeat is not None and now - beat >= heartbeat:
            beat = now
            yield None
        elif heartbeat is None and timeout is not None and now - quiet >= timeout:
            return
        time.sleep(poll)
        leaves = read()


def changes_stream(spark: SparkSession, path: str, schema, selector: dict | None = None, doc_ids: list[str] | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a folder of Parquet commits of winners (id, seq, ...): rows as they are committed, filtered. Use sink_latest to hold one row per id."""
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
    if doc_ids is not None:
        rows = rows.where(F.col("id").isin(doc_ids))
    return rows if selector is None else rows.where(condition(rows, selector))


def latest(rows: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """One row per key: that of the greatest seq."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, F.col(seq)).alias("w")).select("w.*")


def run_stream(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Drains what is there, batch by batch, and returns; a later call goes on from the checkpoint."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sink_latest(path: str, key: str = "id", seq: str = "seq") -> Callable[[DataFrame, int], None]:
    """For run_stream: a table at path, in a folder for each batch, that holds one row per key, that of the greatest seq. A batch that is run again, or rows that come late or twice, change nothing. read_latest gives the table."""

    def each(rows: DataFrame, batch: int) -> None:
        old = _versions(rows.sparkSession, path)
        before = [n for n in old if n < batch]
        if before:
            rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/batch={before[-1]}").unionByName(rows)
        latest(rows, key, seq).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        for n in before[:-1]:
            _delete(rows.sparkSession, f"{path}/batch={n}")

    return each


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The table of sink_latest after its last whole batch."""
    return spark.read.parquet(f"{path}/batch={_versions(spark, path)[-1]}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Batches that were written to their end, in order."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return []
    found = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName()[6:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
