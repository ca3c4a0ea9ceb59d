"""Benchmark decontamination over a distributed positional inverted index, with DataFrame operations only.

The index holds postings (term, document, position) of the terms that the test items need. A phrase is found by
taking the postings of its rarest terms, shifting each by the term's offset in the phrase, and intersecting the
shifted lists; what is left is compared word by word with the document.

Defined results: a null or empty text has no words; a null item id still marks words as hit but is neither counted
nor listed; repeated items count once; repeated documents give a row each; an empty benchmark leaves all clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if, keyed, outlive, save, spare_tables, without

#: Between words, before A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Up to so many rows of a saved table are broadcast; beyond that both sides are shuffled.
BROADCAST_ROWS = 50_000


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _term(word: Column) -> Column:
    """The key under which a word is indexed. It may join a few words that differ in non-ASCII case; the comparison of words that follows tells them apart."""
    return F.lower(word)


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, _d, _r, pos) of all occurrences of terms (a saved table of one column, term) in keyed docs: the positional index."""
    at = docs.select("_d", "_r", F.posexplode(raw_words(F.col("text"))).alias("pos", "word")).select("_d", "_r", "pos", _term(F.col("word")).alias("term"))
    return at.join(broadcast_if(terms, 20 * BROADCAST_ROWS), "term", "left_semi").select("term", "_d", "_r", "pos")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, cf): how often each term stands in the corpus, 0 included."""
    found = docs.select(F.explode(raw_words(F.col("text"))).alias("word")).select(_term(F.col("word")).alias("term"))
    found = found.join(broadcast_if(terms, 20 * BROADCAST_ROWS), "term", "left_semi").groupBy("term").agg(F.count("*").alias("cf"))
    return terms.join(found, "term", "left").select("term", F.coalesce("cf", F.lit(0)).alias("cf"))


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ref, words, ids, n, win): distinct word sequences of items (item_id, text) with their ids, without empty ones."""
    words = F.transform(raw_words(F.col("text").cast("string")), ascii_lower)
    return (
        items.select("item_id", words.alias("words"))
        .where(F.size("words") > 0)
        .groupBy("words")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
        .select(F.xxhash64("words").alias("ref"), "words", "ids", F.size("words").alias("n"), F.least(F.size("words"), F.lit(window)).alias("win"))
    )


def rarest(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(ref, pairs, anchors): for each window the positions of its rarest and second rarest word in the item (twice the same in a window of one word), and all such positions with their terms."""
    at = items.select("ref", F.posexplode("words").alias("p", "word")).withColumn("term", _term(F.col("word")))
    rows = at.join(counts, "term").groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("p", "cf", "term"))).alias("a"))
    rows = rows.join(items.select("ref", "n", "win"), "ref")

    def lowest(s: Column) -> Column:
        ranked = F.array_sort(F.transform(F.slice(F.col("a"), s + 1, F.col("win")), lambda x: F.struct(x["cf"].alias("cf"), x["p"].alias("p"))))
        return F.struct(ranked[0]["p"].alias("first"), F.get(ranked, F.least(F.lit(1), F.col("win") - 1))["p"].alias("second"))

    rows = rows.withColumn("pairs", F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("win")), lowest)))
    used = F.array_distinct(F.flatten(F.transform("pairs", lambda x: F.array(x["first"], x["second"]))))
    return rows.select("ref", "pairs", F.transform(used, lambda p: F.struct(p.alias("p"), F.col("a")[p]["term"].alias("term"))).alias("anchors"))


def phrase_candidates(index: DataFrame, plan: DataFrame) -> DataFrame:
    """(_d, _r, ref, starts): where an item may lie in a document. The lists of both rarest terms of some window, less their offsets, must hold the same start."""
    anchors = plan.select("ref", F.explode("anchors").alias("x")).select("ref", "x.term", "x.p")
    hits = index.join(broadcast_if(anchors, BROADCAST_ROWS), "term").select("_d", "_r", "ref", (F.col("pos") - F.col("p")).alias("start"), "p")
    lists = hits.groupBy("_d", "_r", "ref", "start").agg(F.collect_set("p").alias("got"))
    both = lists.join(broadcast_if(plan.select("ref", "pairs"), BROADCAST_ROWS), "ref").where(F.exists("pairs", lambda x: F.array_contains("got", x["first"]) & F.array_contains("got", x["second"])))
    return both.groupBy("_d", "_r", "ref").agg(F.collect_list("start").alias("starts"))


def proximity_matches(docs: DataFrame, first: str, second: str, slop: int) -> DataFrame:
    """(doc_id, pos, other): positions of first (a word) with second within slop words, found by intersecting the two posting lists in blocks of slop positions. Both are compared as indexed, in lower case."""
    spark = docs.sparkSession
    base = keyed(docs)
    index = save(postings(base, save(spark.createDataFrame([(t,) for t in {first.lower(), second.lower()}], "term string"))))
    side = lambda t, name: index.where(F.col("term") == t.lower()).select("_d", "_r", F.col("pos").alias(name))
    a = side(first, "pos").withColumn("block", F.explode(F.array(*[F.floor(F.col("pos") / (slop + 1)) + k for k in (-1, 0, 1)])))
    b = side(second, "other").withColumn("block", F.floor(F.col("other") / (slop + 1)))
    near = a.join(b, ["_d", "_r", "block"]).where((F.abs(F.col("pos") - F.col("other")) <= slop) & (F.col("pos") != F.col("other")))
    return near.select(F.nullif("_d", F.lit(-(2**63))).alias("doc_id"), "pos", "other")


@spare_tables()
def hits(base: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_d, _r, n_hit, items) of the rows of keyed docs that hold a window of an item; a saved table."""
    tests = save(phrases(items, window))
    terms = save(tests.select(F.explode("words").alias("word")).select(_term(F.col("word")).alias("term")).distinct())
    plan = save(rarest(tests, save(term_counts(base, terms))))
    index = save(postings(base, save(plan.select(F.explode("anchors").alias("x")).select("x.term").distinct())))
    found = phrase_candidates(index, plan).join(broadcast_if(tests, BROADCAST_ROWS), "ref")
    found = save(found.groupBy("_d", "_r").agg(F.collect_list(F.struct("words", "ids", "n", "win", "starts")).alias("found")))

    own = F.transform(raw_words(F.col("text")), ascii_lower)
    rows = base.join(broadcast_if(found, BROADCAST_ROWS), ["_d", "_r"]).select("_d", "_r", "found", own.alias("own"))

    def same(x: Column, start: Column) -> Column:
        """First words of the windows of item x that stand in the document, if it starts at start."""
        here = lambda s: (s + start >= 0) & (F.slice(F.col("own"), F.greatest(s + start + 1, F.lit(1)), x["win"]) == F.slice(x["words"], s + 1, x["win"]))
        return F.transform(F.filter(F.sequence(F.lit(0), x["n"] - x["win"]), here), lambda s: F.struct((s + start).alias("at"), x["win"].alias("win")))

    where = F.transform("found", lambda x: F.struct(x["ids"].alias("ids"), F.flatten(F.transform(x["starts"], lambda d: same(x, d))).alias("at")))
    rows = rows.select("_d", "_r", F.filter(where, lambda x: F.size(x["at"]) > 0).alias("hits")).where(F.size("hits") > 0)
    places = F.flatten(F.transform("hits", lambda x: F.flatten(F.transform(x["at"], lambda y: F.sequence(y["at"], y["at"] + y["win"] - 1)))))
    rows = rows.select("_d", "_r", F.size(F.array_distinct(places)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["ids"])))).alias("items"))
    return outlive(rows.dropDuplicates(["_d", "_r"]))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all columns, that hold no window of an item."""
    return without(docs, hits(keyed(docs), items, window).select("_d", "_r"), BROADCAST_ROWS)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    base = keyed(docs)
    rows = hits(base, items, window)
    return (
        base.select("doc_id", "_d", "_r", F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
        .join(broadcast_if(rows, BROADCAST_ROWS), ["_d", "_r"], "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.when(F.col("items").isNotNull(), F.size("items")), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
