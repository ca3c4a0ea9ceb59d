"""Token counts: pieces are counted once per distinct pre-token, joined to the pre-token frequencies of each document, and summed. No ids are kept.

The counts of the most frequent pre-tokens, at most HEAD of them, are broadcast and summed at once; all others go through a shuffled join, where none of them is frequent enough to be skewed.

Defined results: a null text counts as empty; repeated rows and null ids give a row each.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .common import bound_batches, releasing, save

HEAD = 150_000
FLUSH = 400_000


def _frequencies(path: str):
    def run(batches):
        import pyarrow as pa

        bpe, seen = load(path), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(bpe.pretokens(text))
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    return run


def _count_pieces(path: str):
    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        for batch in batches:
            out = bpe.counts(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["piece", "n", "tokens"])

    return run


def _documents(path: str, head):
    """Rows of documents (row, doc_id, n_bytes, tokens of the head), and (row, piece, n) of the other pieces."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        bpe, known = load(path), head.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for start in range(0, len(ids), 500):
                part = batch.slice(start, 500)
                docs, sizes, sums, owner, piece, n = [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    total = 0
                    for x, k in Counter(bpe.pretokens(text)).items():
                        c = known.get(x)
                        if c is None:
                            owner.append(row)
                            piece.append(x)
                            n.append(k)
                        else:
                            total += c * k
                    docs.append(row)
                    sizes.append(len(text.encode("utf-8", "surrogatepass")))
                    sums.append(total)
                    row += 1
                m, k = len(docs), len(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs + owner, pa.int64()),
                        pa.concat_arrays([part.column(0).cast(pa.int64()), pa.nulls(k, pa.int64())]),
                        pa.array(sizes + [None] * k, pa.int64()),
                        pa.array(sums + [None] * k, pa.int64()),
                        pa.array([None] * m + piece, pa.string()),
                        pa.array([None] * m + n, pa.int64()),
                    ],
                    names=["row", "doc_id", "n_bytes", "head", "piece", "n"],
                )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit. path: a byte-level BPE file of the tokenizers library, readable on every executor."""
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = base.select("text").mapInArrow(releasing(_frequencies(path)), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = save(seen.mapInArrow(releasing(_count_pieces(path)), "piece string, n long, tokens long"))
    steps = [2**k for k in range(0, 63)]
    sizes = pieces.agg(*[F.count_if(F.col("n") >= s).alias(str(s)) for s in steps]).first()
    least = next(s for s in steps if sizes[str(s)] <= HEAD)
    head = spark.sparkContext.broadcast({r["piece"]: r["tokens"] for r in pieces.where(F.col("n") >= least).select("piece", "tokens").toLocalIterator()})
    rows = save(base.mapInArrow(releasing(_documents(path, head)), "row long, doc_id long, n_bytes long, head long, piece string, n long"))
    tail = rows.where("piece is not null").select("row", "piece", "n")
    sums = tail.join(pieces.where(F.col("n") < least).select("piece", "tokens"), "piece").groupBy("row").agg(F.sum(F.col("n") * F.col("tokens")).alias("tail"))
    whole = rows.where("piece is null").select("row", "doc_id", "n_bytes", "head").join(sums, "row", "left")
    n_tokens = F.col("head") + F.coalesce("tail", F.lit(0))
    return whole.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
