"""Toxicity by a support vector machine over a gapped-subsequence string kernel with Nyström landmarks.

The kernel compares two words by the subsequences of three characters that they share, within SPAN characters each;
every gap costs a factor DECAY. So a word with a character inserted or doubled stays near to itself. Landmarks are the words whose
presence tells the labels apart best, and frequent words beside them. A text is described by its greatest kernel value with
each landmark, over all its words; the description is whitened by the landmarks' own kernel matrix (Nyström), and a linear
machine with a logistic link scores it. Words of one or two letters hold no subsequence of three; letters beyond a-z share 37 codes.

The machine is fitted on at most SAMPLE labelled rows; every whole text is scored. Letters that stand apart in a row are read as one word, and so is each part of such a row.

Defined results: a null or empty text has no words and gets the score of a text without any landmark; if the labelled rows
lack either class, all scores are 0; labels that are null, or not 0 or 1, are left out; repeated rows and null ids give a row each; an empty table gives no rows; other columns, whatever their names, are not read, and keep_clean() passes them on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, save, spare_tables

SAMPLE = 20_000
TOXIC_LANDMARKS, OTHER_LANDMARKS = 96, 32
DECAY, SPAN, LONG = 0.75, 5, 40
#: Kernel values below this count as 0: words about as near as any two words are.
FLOOR = 0.5
_GAPS = [(i, j) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]
_STRIP = re.compile(r"[\W_]+")
#: Three letters or more that stand apart, with white space or punctuation between them.
_APART = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_](?![^\W_])){2,}")
#: Letters of a word that may be spelled with its letters apart, next to others, at most; a run of letters that is a word as a whole may be longer.
SPELLED = 12


def words_of(text, windows: bool = True) -> set[str]:
    """Distinct words in lower case without punctuation, in pieces of LONG characters where they are longer. Letters that stand apart are a word together, and with windows also each 3 to SPELLED of them in a row."""
    low = text.lower() if isinstance(text, str) else ""
    whole = set(low.split())
    for m in _APART.finditer(low):
        run = _STRIP.sub("", m[0])
        whole.add(run)
        if windows:
            whole.update(run[a : a + n] for n in range(3, min(SPELLED, len(run)) + 1) for a in range(len(run) - n + 1))
    out = set()
    for w in whole:
        if not w.isalpha():
            w = _STRIP.sub("", w)
        if len(w) > 2:
            if len(w) <= LONG:
                out.add(w)
            else:
                out.update(w[a : a + LONG] for a in range(0, len(w) - 2, LONG - SPAN))
    return out


def _codes(words: list[str]) -> np.ndarray:
    """A row per word of 6-bit codes, 0 beyond its end."""
    width = max(map(len, words))
    raw = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
    code = np.where((raw >= 97) & (raw <= 122), raw - 96, 27 + raw % 37)
    return np.where(raw == 0, 0, code).astype(np.int32)


def subsequences(codes: np.ndarray):
    """Yields (subsequence of each word or -1, weight) by first place and gaps."""
    for d, e in _GAPS:
        weight = DECAY ** (e + 1)
        for i in range(codes.shape[1] - e):
            a, b, c = codes[:, i], codes[:, i + d], codes[:, i + e]
            yield np.where(c > 0, a << 12 | b << 6 | c, -1), weight


class Landmarks:
    """Kernel values of words with fixed landmark words."""

    def __init__(self, words: list[str]):
        self.words = words
        rows = [{} for _ in words]
        for ids, weight in subsequences(_codes(words)):
            for row, x in zip(rows, ids.tolist()):
                if x >= 0:
                    row[x] = row.get(x, 0.0) + weight
        known = sorted(set().union(*rows))
        self.place = np.zeros(1 << 18, np.int32)
        self.place[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, len(words)), np.float32)
        for j, row in enumerate(rows):
            norm = sum(v * v for v in row.values()) ** 0.5
            for x, v in row.items():
                self.table[self.place[x], j] = v / norm
        self.own = self.values(words)

    def values(self, words: list[str]) -> np.ndarray:
        """A row of kernel values per word; rows are 0 where no landmark can reach FLOOR."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for start in range(0, len(order), 4096):
            at = order[start : start + 4096]
            codes = _codes([words[i] for i in at])
            # the norm counts each occurrence of a subsequence; a word's share of subsequences that any landmark has bounds its values
            norm, share = np.zeros(len(at)), np.zeros(len(at))
            hits = []
            for ids, weight in subsequences(codes):
                there = ids >= 0
                place = np.where(there, self.place[ids], 0)
                norm += there * weight**2
                share += (place > 0) * weight**2
                hits.append((place, weight))
            near = np.flatnonzero(share >= FLOOR**2 * norm * 0.999)
            if not len(near):
                continue
            total = np.zeros((len(near), len(self.words)), np.float32)
            for place, weight in hits:
                p = place[near]
                if p.any():
                    total += self.table[p] * np.float32(weight)
            total /= np.sqrt(np.maximum(norm[near], 1e-12))[:, None]
            total[total < FLOOR] = 0
            out[np.array(at)[near]] = np.minimum(total, 1)
        return out

    def describe(self, sets: list[set[str]]) -> np.ndarray:
        """Greatest kernel value with each landmark, for each set of words."""
        every = list(set().union(*sets)) if sets else []
        out = np.zeros((len(sets), len(self.words)), np.float32)
        if not every:
            return out
        values = []
        live: dict[str, int] = {}
        for start in range(0, len(every), 8192):
            part = every[start : start + 8192]
            v = self.values(part)
            rows = np.flatnonzero(v.any(axis=1))
            live.update((part[i], len(values) + k) for k, i in enumerate(rows.tolist()))
            values.extend(v[rows])
        if not live:
            return out
        values = np.array(values)
        for i, s in enumerate(sets):
            rows = [live[w] for w in s if w in live]
            if rows:
                out[i] = values[rows].max(axis=0)
        return out


class Model:
    def __init__(self, landmarks: Landmarks, x: np.ndarray, y: np.ndarray):
        self.landmarks = landmarks
        w, v = np.linalg.eigh(landmarks.own.astype(np.float64) @ np.eye(len(landmarks.words)) + 1e-6 * np.eye(len(landmarks.words)))
        self.white = v / np.sqrt(np.maximum(w, 0.05))
        z = x @ self.white
        self.weights, self.bias = _machine(z, y)
        self.a, self.b = _link(z @ self.weights + self.bias, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = x.astype(np.float64) @ self.white @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -500, 500)))


def _machine(z: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps."""
    z1 = np.hstack([z, np.ones((len(z), 1))])
    t = 2.0 * y - 1
    w = np.zeros(z1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        miss = np.maximum(0, 1 - t * (z1 @ w))
        on = miss > 0
        grad = ridge @ w - 2 * c * z1[on].T @ (t[on] * miss[on])
        step = np.linalg.solve(ridge + 2 * c * z1[on].T @ z1[on], grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _link(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's logistic link of margins to labels."""
    n1 = y.sum()
    n0 = len(y) - n1
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _word_counts(batches):
    from collections import Counter

    for batch in batches:
        seen = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[toxic].update(words_of(text, windows=False))
        words = sorted(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)], names=["word", "clean", "toxic"])


def _describe(landmarks):
    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.slice(start, 2000)
                x = landmarks.value.describe([words_of(t) for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), part.column(1)], names=["x", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on at most SAMPLE rows of docs (doc_id, text) with labels (doc_id, toxic)."""
    spark = docs.sparkSession
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    picked = save(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = save(texts.join(F.broadcast(picked), "doc_id").select("text", "toxic"))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    counts = save(rows.mapInArrow(releasing(_word_counts), "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= 3))
    expect = (F.col("clean") + F.col("toxic")) * totals[1] / (totals[0] + totals[1])
    worth = F.when(F.col("toxic") > 2 * expect, F.col("toxic") * F.log(F.col("toxic") / expect)).otherwise(0.0)
    telling = [r["word"] for r in counts.where(worth > 0).orderBy(F.desc(worth), "word").limit(TOXIC_LANDMARKS).collect()]
    plain = [r["word"] for r in counts.where(worth == 0).orderBy(F.desc("clean"), "word").limit(OTHER_LANDMARKS).collect()]
    if not telling:
        return None
    landmarks = Landmarks(telling + [w for w in plain if w not in telling])
    shared = spark.sparkContext.broadcast(landmarks)
    fitted = rows.mapInArrow(releasing(_describe(shared)), "x array<float>, toxic int").toArrow().combine_chunks()
    x = fitted.column("x").combine_chunks().flatten().to_numpy().reshape(len(fitted), -1)
    return Model(landmarks, x.astype(np.float64), fitted.column("toxic").to_numpy().astype(np.float64))


def _scorer(model):
    """A column function from texts to scores."""

    def scores(batches):
        m: Model | None = model.value
        for texts in batches:
            out = [np.zeros(0)]
            texts = texts.to_pylist()
            for start in range(0, len(texts), 2000):
                part = texts[start : start + 2000]
                out.append(m.score(m.landmarks.describe([words_of(t) for t in part])) if m else np.zeros(len(part)))
            yield pa.array(np.concatenate(out), pa.float64())

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return releasing(scores)(batches)

    return score


def _fit(docs: DataFrame, labels: DataFrame, folds: int):
    with spare_tables():
        model = train(docs, labels.where(~_held(F.col("doc_id"), folds)))
    return _scorer(docs.sparkSession.sparkContext.broadcast(model))


def _held(key, folds: int):
    return F.coalesce(F.crc32(key.cast("long").cast("string").cast("binary")) % folds == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted. Rows whose crc32 of the id as text is divisible by folds are held out of the training."""
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), _fit(docs, labels, folds)(F.col("text").cast("string")).alias("score"))
    return rows.select("doc_id", _held(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of docs, with all columns, whose score is below 0.5."""
    return docs.where(_fit(docs, labels, folds)(F.col("text").cast("string")) < 0.5)
