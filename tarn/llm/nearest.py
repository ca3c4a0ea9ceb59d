"""Approximate nearest neighbours by cosine, from balanced posting lists.

Index: centroids of a balanced k-means, fitted on at most SAMPLE vectors; every vector goes into the list of its nearest
centroid, and boundary vectors also into lists that are hardly farther. Search: a graph over the centroids, held in
memory, is walked to find the lists near a query; lists much farther than the nearest are pruned by the ratio of
distances. Equal directions are one point of the index with the smallest ids that can matter, so lists stay balanced when a
third of all vectors are equal; lists that are still long are split into blocks, searched apart and merged.

Scores are computed in double precision on the original vectors. Defined results: vectors that are null, of zero length, or hold null or
non-finite components take no part; ties go to the smaller id; a null id takes no part; fewer candidates give fewer rows; vectors of other sizes than the most common one take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Vectors that fit the centroids, at most.
SAMPLE = 20_000
#: Vectors per list, roughly, and lists at most.
LIST, MOST_LISTS = 400, 4096
#: A vector is in up to COPIES lists whose distance is within (1 + SLACK) of the nearest.
COPIES, SLACK = 4, 0.10
#: The first search opens lists within RATIO of the nearest distance, LEAST of them at least and MOST at most.
RATIO, LEAST, MOST = 1.35, 12, 48
BLOCK = 4_000
BEAM = 96
#: The second search deals blocks of lists to shards of about SHARD points, FEWEST shards at least, and queries to parts of about PART.
SHARD, FEWEST, PART = 20_000, 12, 20_000
#: Angles and scores are compared with so much room for rounding.
ROOM, NEAR = 1e-6, 1e-9


def fit(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors x by k-means that charges crowded clusters a penalty."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    fill = np.ones(len(c))
    for _ in range(rounds):
        near = np.concatenate([(part @ c.T * 2 - 0.05 * np.log(fill / fill.mean())).argmax(1) for part in np.array_split(x, len(x) // 4096 + 1)])
        fill = np.bincount(near, minlength=len(c)) + 1.0
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


class CentroidGraph:
    """Each centroid knows its nearest others; a search walks from fixed entries along the best so far."""

    def __init__(self, c: np.ndarray, degree: int = 24):
        self.c = c
        order = np.argsort(-(c @ c.T), axis=1, kind="stable")[:, : degree + 1]
        self.links = [[int(j) for j in row if j != i] for i, row in enumerate(order)]
        for i, row in enumerate(order):  # both ways, so that no centroid is out of reach
            for j in row[:4]:
                if i != j and i not in self.links[j]:
                    self.links[int(j)].append(i)
        self.entries = list(range(0, len(c), max(1, len(c) // 16)))

    def search(self, q: np.ndarray, beam: int) -> list[tuple[float, int]]:
        """The beam nearest centroids found, as (distance, centroid), nearest first."""
        sims = self.c[self.entries] @ q
        seen = set(self.entries)
        todo = [(-float(s), j) for s, j in zip(sims, self.entries)]
        best = [(float(s), -j) for s, j in zip(sims, self.entries)]
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > beam:
            heapq.heappop(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= beam and -s < best[0][0]:
                break
            new = [j for j in self.links[i] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for t, j in zip((self.c[new] @ q).tolist(), new):
                if len(best) < beam or t > best[0][0]:
                    heapq.heappush(todo, (-t, j))
                    heapq.heappush(best, (t, -j))
                    if len(best) > beam:
                        heapq.heappop(best)
        return [(max(0.0, 2 - 2 * s) ** 0.5, -j) for s, j in sorted(best, key=lambda p: (-p[0], -p[1]))]


def probes(graph: CentroidGraph, q: np.ndarray) -> list[int]:
    near = graph.search(q, min(BEAM, len(graph.c)))[:MOST]
    return [j for k, (d, j) in enumerate(near) if k < LEAST or d <= RATIO * near[0][0] + 1e-9]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _angles(cosine):
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact measure of q with each row of v; row by row, so that it doesn't depend on what else is in v."""
    return (v * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(1)))


def _assign(graph):
    """(list, point) of each point: its nearest list, with the angle to its centroid, and others about as near, with a null."""

    def run(batches):
        import pyarrow as pa

        g: CentroidGraph = graph.value
        for batch in batches:
            if not len(batch):
                continue
            lists, rows, angles = [], [], []
            u = _unit(_matrix(batch.column(1)))
            for i, q in enumerate(u):
                near = g.search(q, 8)[:COPIES]
                for k, (d, j) in enumerate(near):
                    if d <= (1 + SLACK) * near[0][0] + 1e-9:
                        lists.append(j)
                        rows.append(i)
                        angles.append(None if k else float(_angles(g.c[j] @ q)))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *(c.take(take) for c in batch.columns), pa.array(angles, pa.float64())], names=["list", "point", "v", "ids", "angle"])

    return run


def _route(graph):
    def run(batches):
        import pyarrow as pa

        g: CentroidGraph = graph.value
        for batch in batches:
            if not len(batch):
                continue
            lists, rows = [], []
            for i, q in enumerate(_unit(_matrix(batch.column(1)))):
                found = probes(g, q)
                lists += found
                rows += [i] * len(found)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column(0).take(take), batch.column(1).take(take)], names=["list", "query", "q"])

    return run


def _search(k: int):
    """The k + 1 nearest points of one block of a list, for each query routed to it."""

    def run(key, queries, points):
        import pyarrow as pa

        schema = pa.schema([("query", pa.int64()), ("point", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        if not len(queries) or not len(points):
            return schema.empty_table()
        v, names, ids = _matrix(points.column("v")), points.column("point").to_numpy(), points.column("ids").to_pylist()
        u = _unit(v)
        lead = np.array([i[0] for i in ids])
        q, out = _matrix(queries.column("q")), [[], [], [], []]
        for start in range(0, len(q), 256):
            rough = _unit(q[start : start + 256]) @ u.T
            for row, name, own in zip(rough, queries.column("query").to_pylist()[start : start + 256], q[start : start + 256]):
                least = np.partition(row, -(k + 1))[-(k + 1)] if len(row) > k + 1 else -2.0
                some = np.flatnonzero(row >= least - 1e-9)
                score = cosines(own, v[some])
                order = np.lexsort((lead[some], -score))[: k + 1]
                for i in order.tolist():
                    out[0].append(name)
                    out[1].append(int(names[some[i]]))
                    out[2].append(float(score[i]))
                    out[3].append(ids[some[i]])
        return pa.table([pa.array(x, t.type) for x, t in zip(out, schema)], schema=schema)

    return run


def _reach(graph, radii, units):
    """(shard, query, q, least) for each shard that holds a list which can have a point of score least or more. units: list and shard of each block."""

    def run(batches):
        import pyarrow as pa

        c, radius, (lists, shards) = graph.value.c, radii.value, units.value
        for batch in batches:
            if not len(batch):
                continue
            to, rows = [], []
            q, least = _unit(_matrix(batch.column(1))), batch.column(2).to_numpy()
            for start in range(0, len(q), 256):
                open_ = _angles(q[start : start + 256] @ c.T) - radius <= _angles(least[start : start + 256])[:, None] + ROOM
                for i, some in enumerate(open_):
                    found = np.unique(shards[some[lists]])
                    to.append(found)
                    rows.append(np.full(len(found), start + i))
            take = pa.array(np.concatenate(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to), pa.int32()), *(x.take(take) for x in batch.columns)], names=["shard", "query", "q", "least"])

    return run


def _search_shard(k: int, graph, radii):
    """The k + 1 nearest points of a shard, of those with a score of least or more, for each query that reaches it."""

    def run(key, queries, points):
        import pyarrow as pa

        schema = pa.schema([("query", pa.int64()), ("point", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        if not len(queries) or not len(points):
            return schema.empty_table()
        c, radius = graph.value.c, radii.value
        order = np.argsort(points.column("list").to_numpy(), kind="stable")
        points = points.take(pa.array(order))
        v, names, ids, lists = _matrix(points.column("v")), points.column("point").to_numpy(), points.column("ids").to_pylist(), points.column("list").to_numpy()
        u, lead = _unit(v), np.array([i[0] for i in ids])
        cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
        q, least, who = _matrix(queries.column("q")), queries.column("least").to_numpy(), queries.column("query").to_pylist()
        out = [[], [], [], []]
        for start in range(0, len(q), 256):
            own, floor = q[start : start + 256], least[start : start + 256]
            unit = _unit(own)
            reach = _angles(unit @ c[lists[cuts[:-1]]].T) - radius[lists[cuts[:-1]]] <= _angles(floor)[:, None] + ROOM
            some: list[list[np.ndarray]] = [[] for _ in own]
            for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                asks = np.flatnonzero(reach[:, n])
                if len(asks):
                    i, j = np.nonzero(unit[asks] @ u[a:b].T >= floor[asks, None] - NEAR)
                    for x in np.unique(i).tolist():
                        some[asks[x]].append(a + j[i == x])
            for row, found in enumerate(some):
                if found:
                    at = np.concatenate(found)
                    score = cosines(own[row], v[at])
                    for i in np.lexsort((lead[at], -score))[: k + 1].tolist():
                        out[0].append(who[start + row])
                        out[1].append(int(names[at[i]]))
                        out[2].append(float(score[i]))
                        out[3].append(ids[at[i]])
        return pa.table([pa.array(x, t.type) for x, t in zip(out, schema)], schema=schema)

    return run


def _best(found: DataFrame, most: int) -> DataFrame:
    """query, best: the first most (far, vec_id) of the points found. A point found in several lists counts once."""
    found = found.groupBy("query", "point").agg(F.first("score").alias("score"), F.first("ids").alias("ids"))
    found = found.select("query", "score", F.explode("ids").alias("vec_id"))
    return found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, most).alias("best"))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors (vec_id, embedding) for each row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(fine)
    schema = "query_id long, rank int, vec_id long, score double"
    # equal vectors are one point; a query needs k + 1 of its ids at most, its own included
    sizes = rows.groupBy(F.size("v").alias("m")).count().orderBy(F.desc("count"), "m").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == sizes[0]["m"])
    salted = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(32)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    points = salted.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    points = save(points.select(F.xxhash64("v").alias("point"), "v", "ids"))
    n = points.count()
    lists = int(min(MOST_LISTS, max(1, n // LIST)))
    sample = np.array([r["v"] for r in points.orderBy("point").limit(SAMPLE).select("v").collect()], np.float64)
    graph = spark.sparkContext.broadcast(CentroidGraph(fit(_unit(sample), lists)))

    index = save(points.select("point", "v", "ids").mapInArrow(_assign(graph), "list int, point long, v array<double>, ids array<long>, angle double"))
    sizes = index.groupBy("list").agg(F.count("*").alias("n"), F.count("angle").alias("own"), F.max("angle").alias("radius")).orderBy("list").collect()
    lengths = spark.createDataFrame([(r["list"], -(-r["n"] // BLOCK)) for r in sizes], "list int, blocks int")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.xxhash64("v").alias("query"), "vec_id", "v")
    asked = save(asked)
    queries = save(asked.groupBy("query").agg(F.first("v").alias("q")))
    routed = queries.mapInArrow(_route(graph), "list int, query long, q array<double>")
    routed = routed.join(F.broadcast(lengths), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query", "q")
    blocks = index.join(F.broadcast(lengths), "list").select("list", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int").alias("block"), "point", "v", "ids")
    result = "query long, point long, score double, ids array<long>"
    found = routed.groupBy("list", "block").cogroup(blocks.groupBy("list", "block")).applyInArrow(_search(k), result)
    # of the best k + 1 ids each query takes k but its own, so no score below the last of them matters
    least = _best(found, k + 1).select("query", F.when(F.size("best") > k, -F.col("best")[k]["far"]).alias("least"))
    bounded = save(queries.join(least, "query", "left").select("query", "q", F.coalesce("least", F.lit(-2.0)).alias("least")))

    own = [(r["list"], -(-r["own"] // BLOCK)) for r in sizes if r["own"]]
    first = np.concatenate([[0], np.cumsum([b for _, b in own])])
    shards = int(min(first[-1], max(FEWEST, n // SHARD)))
    parts = max(1, -(-bounded.count() // PART))
    radius = np.full(len(graph.value.c), -np.inf)
    radius[[j for j, _ in own]] = [r["radius"] for r in sizes if r["own"]]
    radii = spark.sparkContext.broadcast(radius)
    units = spark.sparkContext.broadcast((np.repeat([j for j, _ in own], [b for _, b in own]), np.arange(first[-1]) % shards))
    starts = spark.createDataFrame([(j, b, int(at)) for (j, b), at in zip(own, first)], "list int, blocks int, start int")
    dealt = index.where("angle is not null").join(F.broadcast(starts), "list")
    dealt = dealt.select(F.pmod(F.col("start") + F.pmod(F.xxhash64("point"), F.col("blocks")), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "list", "point", "v", "ids")
    reached = bounded.mapInArrow(_reach(graph, radii, units), "shard int, query long, q array<double>, least double").withColumn("part", F.pmod("query", F.lit(parts)).cast("int"))
    found = reached.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(_search_shard(k, graph, radii), result)
    best = _best(found, 4 * (k + 1))
    out = asked.select("query", F.col("vec_id").alias("query_id")).distinct().join(best, "query")
    out = out.withColumn("best", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return out.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.far")).alias("score"))
