"""Personal data: fixed patterns, and contextual extraction that bootstraps from what they find.

An instance is a kind and a shape of an identifier-like token ("card" digits of some length, an address with one dot
missing); a pattern is the word before and the word after, in lower case without punctuation. Seeds are the matches of the fixed patterns.
Spark scores the graph of patterns and instances in rounds: a pattern is as reliable as the mean reliability of the
instances it holds, damped where it holds few; an instance is as reliable as the best pattern that holds it. Instances that
reach TRUST through a pattern that reaches TRUST are reported as kind "found". Base spans stay, and a token that meets one adds none.

Offsets are code points, ends exclusive. Defined results: a null text counts as empty; repeated rows and null ids give a row each; an empty table gives no rows; a text of any length is read whole, in time that grows with it; other columns, whatever their names, are not read, and mask() passes them on.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, keyed, outlive, releasing, save, sha256_hex, spare_tables, with_keys

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
#: What makes a token one that may be an identifier: characters, and digits where it holds no @, at least. Shorter numbers are told apart by no shape.
SHORTEST, DIGITS = 6, 4
_TOKEN = re.compile(r"(?<!\S)[^\sA-Za-z0-9@+]*([A-Za-z0-9@+](?:[A-Za-z0-9@._+/:-]*[A-Za-z0-9])?)[^\sA-Za-z0-9@+]*(?!\S)")
_MARKED = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ROUNDS = 3
TRUST = 0.6
#: A pattern needs so many seeds, or as many documents, before it counts in full.
SUPPORT = 2.0
BROADCAST_ROWS = 100_000


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; found from each @, so that long texts take linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind and then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _key(s: str, most: int) -> str:
    """s, or where it is longer than most a digest of all of it, so that keys stay short and differ as the texts do."""
    return s if len(s) <= most else f"#{sha256_hex(s)}"


def shape(token: str) -> str:
    """Runs of digits and letters, with the length of the digits: 9 for a digit, a for letters."""
    return _key(re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", token)), 80)


_EDGE = re.compile(r"[\W_]+")
_CHUNK = re.compile(r"\S+")


def _plain(word: str) -> str:
    return _key(_EDGE.sub("", word.lower()), 80)


def contexts(text: str, spots: list[tuple[int, int]]) -> list[str]:
    """The pattern of each of spots (start, end): what stands before and after it up to white space or the next spot, or else the whole word before and after."""
    chunks = [m.span() for m in _CHUNK.finditer(text)]
    starts = [a for a, _ in chunks]
    order = sorted(range(len(spots)), key=spots.__getitem__)
    words: dict[int, str] = {}

    def word(k: int) -> str:
        if not 0 <= k < len(chunks):
            return ""
        if k not in words:
            words[k] = _plain(text[slice(*chunks[k])])
        return words[k]

    out, done = [""] * len(spots), 0
    for n, i in enumerate(order):
        a, b = spots[i]
        first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        following = spots[order[n + 1]][0] if n + 1 < len(order) else len(text)
        before = _plain(text[max(chunks[first][0], done) : a]) or word(first - 1)
        after = _plain(text[b : min(chunks[last][1], following)]) or word(last + 1)
        out[i], done = f"{before} _ {after}", max(done, b)
    return out


def candidates(text: str, base: list) -> list[tuple[str, int, int, str, str]]:
    """(kind or "", start, end, instance, pattern): seeds, and tokens that may be identifiers and meet no seed."""
    taken = sorted((a, b) for _, a, b in base)
    reach = [0, *accumulate((b for _, b in taken), max)]
    spots = [(k, a, b) for k, a, b in base]
    for m in _MARKED.finditer(text):
        t = _TOKEN.fullmatch(m[0])
        if not t or len(t[1]) < SHORTEST or sum(c.isdigit() for c in t[1]) < DIGITS and "@" not in t[1]:
            continue
        a, b = m.start() + t.start(1), m.start() + t.end(1)
        # of the seeds that start before its end, none ends after its start
        if reach[bisect_right(taken, (b, -1))] <= a:
            spots.append(("", a, b))
    if not spots:
        return []
    return [(kind, a, b, shape(text[a:b]), p) for (kind, a, b), p in zip(spots, contexts(text, [s[1:] for s in spots]))]


def _read(batches):
    spot = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("instance", pa.string()), ("pattern", pa.string())]))
    for batch in batches:
        for start in range(0, len(batch), 1000):
            part = batch.slice(start, 1000)
            bases, spots = [], []
            for text in part.column(1).to_pylist():
                base = base_spans(text or "")
                bases.append([{"kind": k, "a": a, "b": b} for k, a, b in base])
                spots.append([dict(zip(("kind", "a", "b", "instance", "pattern"), s)) for s in candidates(text or "", base)])
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(bases, kinds), pa.array(spots, spot)], names=["doc_id", "_d", "_r", "base", "spots"])


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def score_graph(edges: DataFrame) -> DataFrame:
    """(instance, pattern, trust) of edges (instance, pattern, n, seeds): n times together, seeds of them matches of fixed patterns."""
    now = save(edges.withColumn("trust", F.col("seeds") / F.col("n")))
    for _ in range(ROUNDS):
        patterns = now.groupBy("pattern").agg((F.sum(F.col("trust") * F.col("n")) / (F.sum("n") + SUPPORT - 1)).alias("p"))
        both = now.join(patterns, "pattern")
        instances = both.groupBy("instance").agg(F.max("p").alias("q"))
        now = save(both.join(instances, "instance").select("instance", "pattern", "n", "seeds", F.greatest(F.col("seeds") / F.col("n"), F.least("p", "q")).alias("trust")))
    return now.select("instance", "pattern", "trust")


def _new():
    return F.filter("spots", lambda s: s["kind"] == "")


def _bootstrap(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _d, _r, base, spots) of all rows, and (_d, _r, more) with the further spans of those that have any; both saved."""
    spot = "array<struct<kind: string, a: int, b: int, instance: string, pattern: string>>"
    rows = save(keyed(docs).mapInArrow(releasing(_read), f"doc_id long, _d long, _r long, base array<struct<kind: string, a: int, b: int>>, spots {spot}"))
    with spare_tables():
        edges = rows.select(F.explode("spots").alias("s")).groupBy("s.instance", "s.pattern").agg(F.count("*").alias("n"), F.count_if(F.col("s.kind") != "").alias("seeds"))
        good = save(score_graph(edges).where(F.col("trust") >= TRUST).select("instance", "pattern"))
        judged = rows.select("_d", "_r", F.explode(_new()).alias("s")).select("_d", "_r", "s.a", "s.b", "s.instance", "s.pattern").join(broadcast_if(good, BROADCAST_ROWS), ["instance", "pattern"], "left_semi")
        return rows, outlive(judged.groupBy("_d", "_r").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("more")))


def extract_pii(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows, more = _bootstrap(docs)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")
    digest = [F.col("doc_id"), *(_count(k) for k in KINDS), F.sha2(text("base"), 256).alias("base_sha256")]
    # only documents with tokens to judge take part in the join
    plain = rows.where(F.size(_new()) == 0).select(*digest, text("base").alias("spans"))
    found = F.transform(F.coalesce("more", F.array().cast("array<struct<a: int, b: int>>")), lambda s: F.struct(F.lit("found").alias("kind"), s["a"].alias("a"), s["b"].alias("b")))
    some = rows.where(F.size(_new()) > 0).join(broadcast_if(more, BROADCAST_ROWS), ["_d", "_r"], "left")
    return plain.union(some.select(*digest, text(F.concat("base", found)).alias("spans")))


def mask(docs: DataFrame) -> DataFrame:
    """docs with all its columns, each span of text replaced by its kind in brackets, and n_chars, if there, counted anew. Null texts stay null."""
    _, more = _bootstrap(docs)
    named = more.select(F.col("_d").alias("__tarn_d"), F.col("_r").alias("__tarn_r"), F.array_join(F.transform("more", lambda s: F.concat_ws(":", F.lit("found"), s["a"], s["b"])), ",").alias("__tarn_more"))

    def redacted(batches):
        for texts, extra in batches:
            yield pa.array([redact(t, base_spans(t), e or "") if t is not None else None for t, e in zip(texts.to_pylist(), extra.to_pylist())], pa.string())

    @F.arrow_udf("string")
    def masked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return releasing(redacted)(batches)

    rows = with_keys(docs).join(broadcast_if(named, BROADCAST_ROWS), ["__tarn_d", "__tarn_r"], "left")
    rows = rows.withColumn("text", masked(F.col("text").cast("string"), F.col("__tarn_more")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def redact(text: str, base: list, more: str = "") -> str:
    """text with each span replaced by its kind in brackets; where spans overlap, their union goes under the first one's kind. more: spans as kind:start:end, comma-joined."""
    cuts = sorted([(a, b, k) for k, a, b in base] + [(int(a), int(b), k) for k, a, b in (s.split(":") for s in more.split(",") if s)])
    out, at = [], 0
    for a, b, k in cuts:
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
