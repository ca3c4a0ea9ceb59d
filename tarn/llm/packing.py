"""Packing into sequences of a fixed length by the sum-of-squares rule.

Only documents longer than a sequence are cut: into full pieces, each a sequence of its own, and a shorter first piece.
What remains is packed longest first. Each piece goes where the sum over gaps of (open sequences with that gap) squared
becomes smallest: into an open sequence, whose gap then shrinks, or into a new one. Rows are dealt by a hash of id, text and place into groups
of about GROUP documents, and each group is packed on its own: its state is a count per gap, so a task needs little memory.

Defined results: a null text counts as empty and holds the end id alone; repeated rows and null ids are packed row by row; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .common import releasing, releasing_group, save

GROUP = 25_000


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    first = n % size
    return [(0, first)] * (first > 0) + [(a, size) for a in range(first, n, size)]


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length (1 to size), in the order given."""
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    n = np.zeros(size + 1, np.int64)
    where, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    far = np.int64(2**62)
    for i, s in enumerate(lengths.tolist()):
        # from gap g to g - s: -(2 n[g] - 1) + (2 n[g - s] + 1); full sequences aren't open
        after = 2 * n[: size + 1 - s] + 1
        after[0] = 0
        cost = np.where(n[s:] > 0, after - 2 * n[s:] + 1, far)
        g = int(cost.argmin()) + s
        fresh = 2 * int(n[size - s]) + 1 if s < size else 0
        if cost[g - s] <= fresh:
            k = open_by_gap[g].pop()
            n[g] -= 1
        else:
            k, g, made = made, size, made + 1
        where[i], offset[i] = k, size - g
        if g > s:
            open_by_gap[g - s].append(k)
            n[g - s] += 1
    return where, offset


def _encode(path: str, end: int, size: int):
    """Per document: how many ids it has, the checksum of each piece, and a number that differs between equal rows of a task."""

    def run(batches):
        import pyarrow as pa

        bpe, tail, seen = load(path), end.to_bytes(4, "little"), 0
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                lengths, sums, salts = [], [], []
                for text in part.column(1).to_pylist():
                    ids = bpe.packed(text or "") + tail
                    lengths.append(len(ids) // 4)
                    sums.append([zlib.crc32(ids[4 * a : 4 * (a + m)]) for a, m in cut(len(ids) // 4, size)])
                    salts.append(zlib.crc32(ids) << 31 | seen & 0x7FFFFFFF)
                    seen += 1
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(salts, pa.int64())], names=["doc_id", "n", "crcs", "salt"])

    return run


def _pack(size: int):
    def run(table):
        import pyarrow as pa

        order = sorted(range(len(table)), key=lambda i, n=table.column("n").to_pylist(), d=table.column("doc_id").to_pylist(): (-(n[i] % size), d[i] is None, d[i] or 0))
        table = table.take(pa.array(order, pa.int64()))
        ids, crcs, group = table.column("doc_id").to_pylist(), table.column("crcs").to_pylist(), table.column("grp")[0].as_py()
        n = table.column("n").to_numpy()
        rest = n % size
        m = int((rest > 0).sum())
        where, offset = sum_of_squares(rest[:m], size)
        made, base = int(where.max()) + 1 if m else 0, group << 32
        out: list[list] = [[] for _ in range(7)]
        for i, (doc, total, sums) in enumerate(zip(ids, n.tolist(), crcs)):
            for piece, (start, length) in enumerate(cut(total, size)):
                if length < size:
                    seq, at = int(where[i]), int(offset[i])
                else:
                    seq, at, made = made, 0, made + 1
                for column, x in zip(out, (doc, piece, start, length, sums[piece], base + seq, at)):
                    column.append(x)
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 2) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset. path: a byte-level BPE file, readable on every executor."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = save(base.mapInArrow(releasing(_encode(path, end, size)), "doc_id long, n long, crcs array<long>, salt long"))
    groups = max(1, -(-rows.count() // GROUP))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return rows.groupBy("grp").applyInArrow(releasing_group(_pack(size)), schema)
