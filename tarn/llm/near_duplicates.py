"""Exact n-gram Jaccard join by a token-group matrix, and the classes of near duplicates that it links.

Texts become sets of hashed word shingles; equal sets are one from then on. A sketch of fixed size estimates how
common each shingle is, and only fixes an order of shingles that is the same for all sets: rare ones first. Two sets
that are similar enough share a shingle of their prefixes in that order, so shingles in one prefix only are left out.

The join itself: (1) sets that share a prefix shingle are linked, if similar, to a few leaders of that shingle, which
partitions similar sets into groups of any size at linear cost. (2) The matrix holds the union of prefix shingles of
each group. (3) Each set counts the shingles it shares with groups other than its own; that bounds its overlap with
any member. (4) Only groups whose bound reaches the threshold are opened: their members are compared with the set, first by shared
prefix shingles, then by the whole sets. Every pair of sets in different groups is either compared or excluded by its
bound, and pairs in one group are connected already; so the classes are those of all links. Hashes have 64 bits; nothing
else is approximate.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; repeated rows are copies
of each other and give a row each; a null id gets the class of its text but is never its smallest id.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, keyed, outlive, releasing, releasing_group, save, spare_tables, with_keys, without
from .components import components
from .shingles import mix, set_id, shingle_sets

WORDS = 5
#: The threshold of similarity, as a fraction.
OVER, UNDER = 3, 4
#: The sketch has 2**SKETCH_BITS counters of a byte in 2**CHUNK_BITS pieces; its size doesn't depend on the data.
SKETCH_BITS, CHUNK_BITS = 24, 8
#: Prefix shingles in a bucket, roughly. Each bucket is one row group of Python work.
BUCKET = 400_000
#: Leaders of each shingle in the first step, and the run length up to which all pairs are taken at once.
LEADERS, SHORT_RUN = 3, 4
#: Members of a group that stand for it before it is opened as a whole.
CENTRES = 8
#: Members of a group that are opened as one block.
OPEN = 64
BROADCAST_ROWS = 100_000
#: Classes that can be too large for a task, at most.
HOT_CLASSES = 1_000


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _prefix_len(n: int) -> int:
    return n - -(-OVER * n // UNDER) + 1


def _measure(batches):
    """For each row: its keys, the size and name of its set. At the end of the task: pieces of the sketch of the distinct sets it has seen."""
    import pyarrow as pa

    sketch, seen = np.zeros(1 << SKETCH_BITS, np.uint8), set()
    waiting, amount = [], 0

    def count():
        nonlocal waiting, amount
        if waiting:
            slots, times = np.unique(_slot(np.concatenate(waiting)), return_counts=True)
            sketch[slots] = np.minimum(255, sketch[slots].astype(np.int64) + times)
        waiting, amount = [], 0

    names = ["doc_id", "_d", "_r", "n", "sid", "piece", "blob"]
    for batch in batches:
        sizes, ids = [], []
        for s in shingle_sets(batch.column(1), WORDS):
            sizes.append(len(s))
            ids.append(x := set_id(s))
            if len(s) and x not in seen:
                seen.add(x)
                waiting.append(s)
                amount += len(s)
                if amount > 1_000_000:
                    count()
        m = len(sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
    count()
    pieces = sketch.reshape(1 << CHUNK_BITS, -1)
    for k in np.flatnonzero(pieces.any(axis=1)).tolist():
        empty = [pa.nulls(1, pa.int64()) for _ in range(5)]
        yield pa.RecordBatch.from_arrays([*empty, pa.array([k], pa.int32()), pa.array([zlib.compress(pieces[k].tobytes(), 1)], pa.binary())], names=names)


def _add_up(table):
    """One piece of the sketch, summed over the tasks."""
    import pyarrow as pa

    total = np.zeros(1 << (SKETCH_BITS - CHUNK_BITS), np.int64)
    for blob in table.column("blob").to_pylist():
        total += np.frombuffer(zlib.decompress(blob), np.uint8)
    return pa.table({"piece": table.column("piece").slice(0, 1), "blob": pa.array([zlib.compress(np.minimum(total, 65535).astype(np.uint16).tobytes(), 1)], pa.binary())})


def _levels(spark: SparkSession, sketch: DataFrame):
    """Broadcasts a byte for each counter: 0 for shingles that are about as rare as most, else more for more common ones. Its size is fixed."""
    counts = np.zeros((1 << CHUNK_BITS, 1 << (SKETCH_BITS - CHUNK_BITS)), np.uint16)
    for row in sketch.groupBy("piece").applyInArrow(releasing_group(_add_up), "piece int, blob binary").collect():  # 32 MB at most
        counts[row["piece"]] = np.frombuffer(zlib.decompress(row["blob"]), np.uint16)
    mean = float(counts.mean())
    usual = mean + 8 * mean**0.5 + 8
    # by way of a level for each value, so that the driver needs no more than the counts and a byte for each
    values = np.arange(1 << 16)
    level = np.where(values > usual, np.floor(np.log2(np.maximum(values, 1) / usual) * 2) + 1, 0).astype(np.uint8)
    levels = level[counts]
    return spark.sparkContext.broadcast(zlib.compress(levels.tobytes(), 1))


def _rare_first(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    rank = levels[_slot(s)]
    return s[np.argsort(rank, kind="stable")] if rank.any() else s


def _prefixes(levels, buckets: int):
    """Per task and bucket one row: the prefix shingles and set names, packed."""

    def deal(batches):
        import pyarrow as pa

        table, seen = np.frombuffer(zlib.decompress(levels.value), np.uint8), set()
        parts, owners, amount = [], [], 0

        def flush():
            nonlocal parts, owners, amount
            if not parts:
                return
            tokens = np.concatenate(parts)
            names = np.repeat(np.array([x for x, _ in owners], np.int64), [k for _, k in owners])
            bucket = (tokens % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, tokens, names = bucket[order], tokens[order], names[order]
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            rows = [(int(bucket[a]), tokens[a:b].tobytes(), names[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            parts, owners, amount = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "tokens", "sids"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), WORDS):
                if len(s) and (x := set_id(s)) not in seen:
                    seen.add(x)
                    p = _prefix_len(len(s))
                    parts.append(_rare_first(s, table)[:p])
                    owners.append((x, p))
                    amount += p
                    if amount > 2_000_000:
                        yield from flush()
        yield from flush()

    return deal


def _shared(table):
    """Of a bucket: the shingles of two or more sets as (token, sid), and pairs (a, b) of sets with leaders of their runs."""
    import pyarrow as pa

    tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()])
    sids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("sids").to_pylist()])
    order = np.lexsort((sids, tokens))
    tokens, sids = tokens[order], sids[order]
    keep = np.ones(len(tokens), bool)
    keep[1:] = (tokens[1:] != tokens[:-1]) | (sids[1:] != sids[:-1])
    tokens, sids = tokens[keep], sids[keep]
    cuts = np.concatenate(([0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1, [len(tokens)]))
    pairs, used = set(), np.zeros(len(tokens), bool)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a < 2:
            continue
        used[a:b] = True
        run = sids[a:b]
        if b - a <= SHORT_RUN:
            run = run.tolist()
            pairs.update((x, y) for i, x in enumerate(run) for y in run[i + 1 :])
        else:
            for k in range(LEADERS):
                lead = int(run[np.argmin(mix(run.view(np.uint64) + np.uint64(k)))])
                pairs.update((min(lead, x), max(lead, x)) for x in run.tolist() if x != lead)
    token = tokens[used].view(np.int64)
    a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    m, k = len(token), len(pairs)
    return pa.table({"token": pa.chunked_array([pa.array(token), pa.nulls(k, pa.int64())]), "a": pa.chunked_array([pa.array(sids[used]), pa.array(a)]), "b": pa.chunked_array([pa.nulls(m, pa.int64()), pa.array(b)])})


def _pack(batches):
    """(sid, blob): the set of each text."""
    import pyarrow as pa

    for batch in batches:
        blobs = [s.tobytes() for s in shingle_sets(batch.column(1), WORDS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["sid", "blob"])


def _similar(batches):
    """The pairs (a, b) whose sets x and y are similar enough."""
    import pyarrow as pa

    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((x, y))
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            keep.append(UNDER * same >= OVER * (len(x) + len(y) - same))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _need(n: str, m: str):
    """The least overlap of similar sets of n and m shingles."""
    return F.ceil((F.col(n) + F.col(m)) * OVER / (OVER + UNDER))


def _rest(n: str):
    """Shingles of a set that are not in its prefix."""
    return F.ceil(F.col(n) * OVER / UNDER) - 1


class _Join:
    def __init__(self, base: DataFrame, sets: DataFrame, shared: DataFrame):
        self.base, self.shared = base, shared
        held = shared.groupBy("sid").agg(F.collect_set("token").alias("tokens"))
        one = sets.where("n > 0").groupBy("sid").agg(F.min("n").alias("n"), F.min(F.struct("_d", "_r")).alias("at"))
        self.known = save(held.join(one, "sid").select("sid", "tokens", "n", "at._d", "at._r"))
        self.blobs: DataFrame | None = None

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and shared prefix shingles allow them to be similar."""
        left = self.known.select(F.col("sid").alias("a"), F.col("tokens").alias("x"), F.col("n").alias("n"))
        right = self.known.select(F.col("sid").alias("b"), F.col("tokens").alias("y"), F.col("n").alias("m"))
        rows = pairs.join(left, "a").join(right, "b").where((F.col("n") * OVER <= F.col("m") * UNDER) & (F.col("m") * OVER <= F.col("n") * UNDER))
        return rows.where(F.size(F.array_intersect("x", "y")) + F.greatest(_rest("n"), _rest("m")) >= _need("n", "m")).select("a", "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        pairs = save(self.plausible(pairs))
        needed = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        if self.blobs is not None:
            needed = needed.join(self.blobs.select("sid"), "sid", "left_anti")
        rows = save(needed.join(self.known, "sid").select("sid", "_d", "_r"))
        texts = self.base.join(broadcast_if(rows, BROADCAST_ROWS), ["_d", "_r"])
        more = save(texts.select("sid", "text").mapInArrow(releasing(_pack), "sid long, blob binary").groupBy("sid").agg(F.first("blob").alias("blob")))
        self.blobs = more if self.blobs is None else self.blobs.union(more)
        left, right = (self.blobs.select(F.col("sid").alias(k), F.col("blob").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(releasing(_similar), "a long, b long")

    def qualifying(self, groups: DataFrame) -> DataFrame:
        """(sid, g): sets and groups other than their own whose bound allows a link; groups: (sid, gid) of all shared sets. Each pair of groups is asked from one side."""
        rows = save(self.shared.join(groups, "sid"))
        split = save(rows.groupBy("token").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi")).where("lo <> hi").select("token"))
        rows = rows.join(broadcast_if(split, BROADCAST_ROWS), "token", "left_semi")
        sizes = self.known.select("sid", "n").join(groups, "sid").groupBy("gid").agg(F.min("n").alias("least"), F.max("n").alias("most"))
        matrix = rows.select("token", F.col("gid").alias("g")).distinct()
        bound = rows.join(matrix, "token").where("g < gid").groupBy("sid", "g").agg(F.count("*").alias("common"))
        bound = bound.join(self.known.select("sid", "n"), "sid").join(sizes.withColumnRenamed("gid", "g"), "g")
        bound = bound.withColumn("least", F.greatest("least", F.ceil(F.col("n") * OVER / UNDER))).withColumn("most", F.least("most", F.floor(F.col("n") * UNDER / OVER)))
        # Larger members than the set fit the more easily the larger they are, smaller ones the smaller they are. Both sides are rounded up, so just below the largest size one more shingle can do.
        fits = lambda m, spare: F.col("common") + F.greatest(_rest("n"), _rest(m)) + spare >= _need("n", m)
        return save(bound.where("least <= most").where(fits("least", 0) | fits("most", 1)).select("sid", "g"))

    def centres(self, groups: DataFrame, asked: DataFrame) -> DataFrame:
        """(g, other): of each asked group up to CENTRES members whose prefix shingles are the commonest in the group, one of each hash class."""
        rows = self.shared.join(groups, "sid").join(asked.select(F.col("g").alias("gid")).distinct(), "gid", "left_semi")
        held = rows.groupBy("gid", "token").agg(F.count("*").alias("by"))
        scores = rows.join(held, ["gid", "token"]).groupBy("gid", "sid").agg(F.sum("by").alias("score")).join(self.known.select("sid", "n"), "sid")
        classes = scores.groupBy("gid", F.pmod(F.xxhash64("sid"), F.lit(CENTRES)).alias("class"))
        return classes.agg(F.max(F.struct((F.col("score") / F.col("n")).alias("share"), "sid")).alias("best")).select(F.col("gid").alias("g"), F.col("best.sid").alias("other"))


    def opened(self, qualify: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs (a, b) of qualifying (sid, g) with members of the group that could be linked. Large groups are opened in blocks of members, against which each query counts its shared shingles; a block gives only the pairs that may be similar."""
        sizes = save(groups.groupBy(F.col("gid").alias("g")).agg(F.ceil(F.count("*") / OPEN).cast("int").alias("blocks")).join(qualify.select("g").distinct(), "g", "left_semi"))
        members = groups.select(F.col("gid").alias("g"), F.col("sid").alias("other")).join(sizes, "g")
        small = _pairs(qualify.join(sizes.where("blocks = 1"), "g", "left_semi"), members.where("blocks = 1").select("g", "other"))
        facts = self.known.select(F.col("sid").alias("other"), "n", "tokens")
        held = save(members.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("other"), F.col("blocks")).cast("int")).join(facts, "other").select("g", "block", "other", "n", "tokens"))
        asked = qualify.join(sizes.where("blocks > 1"), "g").join(facts.withColumnRenamed("other", "sid"), "sid")
        asked = save(asked.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "sid", "n", "tokens"))
        large = asked.groupBy("g", "block").cogroup(held.groupBy("g", "block")).applyInArrow(releasing_group(_open), "a long, b long")
        return small.union(large)


def _open(queries, members):
    """Pairs of the queries and members of a block whose sizes and shared prefix shingles allow them to be similar."""
    import pyarrow as pa

    out = ([], [])
    if len(queries) and len(members):
        owners: dict[int, list[int]] = {}
        for i, tokens in enumerate(members.column("tokens").to_pylist()):
            for t in tokens:
                owners.setdefault(t, []).append(i)
        names, m = members.column("other").to_numpy(), members.column("n").to_numpy()
        for sid, n, tokens in zip(queries.column("sid").to_pylist(), queries.column("n").to_pylist(), queries.column("tokens").to_pylist()):
            hits = [i for t in tokens for i in owners.get(t, ())]
            common = np.bincount(np.array(hits, np.int64), minlength=len(m))
            rest = np.maximum(-(-OVER * n // UNDER), -(-OVER * m // UNDER)) - 1
            ok = (common > 0) & (common + rest >= -(-OVER * (n + m) // (OVER + UNDER))) & (OVER * n <= UNDER * m) & (OVER * m <= UNDER * n)
            for other in names[ok].tolist():
                out[0].append(min(sid, other))
                out[1].append(max(sid, other))
    return pa.table([pa.array(x, pa.int64()) for x in out], names=["a", "b"])


def _pairs(qualify: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of qualifying (sid, g) with members (g, other)."""
    return qualify.join(members, "g").select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b"))


@spare_tables()
def _classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, its name (_d, _r), n shingles, and its class c; null without shingles. A saved table."""
    spark = docs.sparkSession
    base = keyed(docs)
    measured = save(base.select("doc_id", "text", "_d", "_r").mapInArrow(releasing(_measure), "doc_id long, _d long, _r long, n long, sid long, piece int, blob binary"))
    sets = measured.where("piece is null").select("doc_id", "_d", "_r", "n", "sid")
    levels = _levels(spark, measured.where("piece is not null").select("piece", "blob"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(total // UNDER // BUCKET), int(spark.conf.get("spark.sql.shuffle.partitions")) if total > 10 * BUCKET else 1)
    dealt = base.select("text").mapInArrow(releasing(_prefixes(levels, buckets)), "bucket int, tokens binary, sids binary")
    found = save(dealt.groupBy("bucket").applyInArrow(releasing_group(_shared), "token long, a long, b long"))
    shared = found.where("token is not null").select("token", F.col("a").alias("sid"))
    pairs = save(found.where("token is null").select("a", "b").distinct())
    join = _Join(base, sets, shared)
    links = save(join.links(pairs))
    for last in (False, True):
        roots = components(links)
        groups = save(join.known.select("sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("gid")))
        qualify = join.qualifying(groups)
        more = join.opened(qualify, groups) if last else _pairs(qualify, join.centres(groups, qualify))
        more = save(more.join(pairs, ["a", "b"], "left_anti"))
        pairs = pairs.union(more)
        links = save(links.union(join.links(more)))
    roots = save(components(links))
    classes = sets.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select("doc_id", "_d", "_r", "n", F.when(F.col("n") > 0, F.coalesce("root", "sid")).alias("c"))
    return outlive(classes)


def _of_classes(classes: DataFrame, facts: DataFrame) -> DataFrame:
    """classes with the facts (c, rows and others, rows > 1) of their class, null where there are none. The largest classes, of more than a HOT_CLASSES-th of all rows and so HOT_CLASSES at most, are broadcast; in the join of the rest no class is large. Rows without a class, which may be many, aren't joined."""
    most = classes.count() // HOT_CLASSES
    facts = save(facts)
    large = F.broadcast(facts.where(F.col("rows") > most))
    named = classes.where("c is not null")
    rest = named.join(large.select("c"), "c", "left_anti").join(facts.where(F.col("rows") <= most), "c", "left")
    out = named.join(large, "c").unionByName(rest)
    return out.unionByName(classes.where("c is null"), allowMissingColumns=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included)."""
    classes = _classes(docs)
    lows = classes.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")).where("rows > 1")
    return _of_classes(classes, lows).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns: that with the smallest doc_id, or where several have it, or none has an id, the smallest hash of its text. Rows equal in id and text are one document. Rows without shingles stay, and of those without an id all do."""
    classes = _classes(docs)
    first = classes.where("c is not null").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "_d", "_r")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    gone = _of_classes(classes, first).where((F.col("_d") != F.col("first._d")) | (F.col("_r") != F.col("first._r"))).select("_d", "_r").distinct()
    rest = without(docs, save(gone), 2 * BROADCAST_ROWS)
    again = save(classes.where("c is not null or doc_id is not null").groupBy("_d", "_r").count().where("count > 1").select("_d", "_r"))
    if again.isEmpty():
        return rest
    named = again.select(F.col("_d").alias("__tarn_d"), F.col("_r").alias("__tarn_r"))
    repeated = with_keys(rest).join(broadcast_if(named, 2 * BROADCAST_ROWS), ["__tarn_d", "__tarn_r"], "left_semi")
    return without(rest, again, 2 * BROADCAST_ROWS).unionByName(repeated.dropDuplicates(["__tarn_d", "__tarn_r"]).drop("__tarn_d", "__tarn_r"))
