"""Secret scans: fixed patterns, and two character Markov models that tell random strings from ordinary identifiers.

Both models are of order 1, and rare pairs lean on the frequency of the character. They are trained from labelled samples: the values that the fixed
patterns find in the corpus (random), and plain words of it (ordinary), each up to SAMPLE strings that are
chosen by hash over all documents, with the lists below as a floor; numbers, dates, runs and sequences of characters are ordinary. A token of SHORTEST characters or more, as long as
the labelled values, is reported as kind "markov" if the log-likelihood ratio per character, less the noise of its length, says random. Base spans stay; a token that meets a base span adds none.

Offsets are code points, ends exclusive. Defined results: a null text counts as empty; repeated rows and null ids give a row each; an empty table gives no rows; texts of any length are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import random
import re
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, save, sha256_hex, spare_tables

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
#: One of these stands in every text that _ASSIGN matches.
_KEYS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_WORD = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_]{8,40}(?![A-Za-z0-9_])")
#: Characters of a token, and of a value that trains the random model, at least.
SHORTEST = 16
_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Labelled strings per class that train the models, at most.
SAMPLE = 5_000
#: Characters of a labelled value that train, at most; plain words train if they have 8 to 40. A token is judged whole, whatever its length.
PIECE = 200
#: Log-likelihood ratio per character above which a token is random.
MARGIN = 0.5
ORDINARY = """get_user_by_id connection_timeout_ms DataFrameWriter org/apache/spark/sql/functions max_partition_bytes read_from_file
is_valid_email_address SELECT_ALL_COLUMNS internationalization http_request_handler application/json-patch+json responsibilities
test_case_with_long_name EventListenerFactoryBean number_of_retries_left TransactionManagerImplementation __init_subclass__""".split()
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_CLASS = {c: i for i, c in enumerate(ALPHABET)}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start and then kind."""
    low, out = text.lower(), []
    if any(k in low for k in _KEYS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Markov:
    """Log-probabilities of a character after the one before it. Rare pairs lean on the character's own frequency, counted from one."""

    def __init__(self, samples: list[str], lean: float = 8.0):
        k = len(ALPHABET) + 1
        one, two = [1] * k, [[0] * k for _ in range(k)]
        for s in samples:
            a = k - 1
            for c in s:
                x = _CLASS.get(c, k - 1)
                one[x] += 1
                two[a][x] += 1
                a = x
        total = sum(one)
        self.log = [[math.log((n + lean * one[x] / total) / (sum(row) + lean)) for x, n in enumerate(row)] for row in two]

    def __call__(self, s: str) -> float:
        a, total = len(ALPHABET), 0.0
        for c in s:
            x = _CLASS.get(c, len(ALPHABET))
            total += self.log[a][x]
            a = x
        return total


class Ratio:
    """Log-likelihood ratio per character, random over ordinary."""

    def __init__(self, rand: list[str], plain: list[str]):
        made = random.Random(17)
        # random strings of the usual alphabets stand for kinds of secrets that the corpus holds none of
        for chars in (ALPHABET[:62], "0123456789abcdef", ALPHABET):
            rand = [*rand, *("".join(made.choices(chars, k=40)) for _ in range(400))]
        # numbers, dates, runs and sequences are ordinary
        numbers = ["".join(made.choices(string.digits, k=16)) for _ in range(400)]
        numbers += [sep.join(f"{made.randrange(10**k):0{k}}" for k in (4, 2, 2, 4)) for sep in "-/_" for _ in range(50)]
        runs = [c * 6 for c in ALPHABET] + [string.ascii_lowercase, string.ascii_uppercase, string.digits] * 4
        self.rand, self.plain = Markov(rand), Markov([*plain, *ORDINARY, *numbers, *runs])

    def __call__(self, s: str) -> float:
        return (self.rand(s) - self.plain(s)) / len(s)

    def random(self, s: str) -> bool:
        return self(s) > MARGIN + 2 / math.sqrt(len(s))


def _first(rows: set[tuple[int, str]]) -> list[tuple[int, str]]:
    """Of each label the SAMPLE rows that train() picks first, by Spark's xxhash64 of the string."""
    import xxhash

    def place(row):
        h = xxhash.xxh64_intdigest(row[1].encode("utf-8", "surrogatepass"), 42)
        return (h - 2**64 if h >= 2**63 else h, row[1])

    return [row for k in (0, 1) for row in sorted((r for r in rows if r[0] == k), key=place)[:SAMPLE]]


def _labelled(batches):
    """Labelled strings: values of base matches, and long plain words. Those that can't be among the first SAMPLE are left out, so any partitioning gives the same."""
    import pyarrow as pa

    rows = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            for kind, a, b in base_spans(text):
                value = _ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
                if len(value) >= SHORTEST:
                    rows.add((1, value[:PIECE]))
            rows.update((0, w) for w in _WORD.findall(text))
            if len(rows) > 8 * SAMPLE:
                rows = set(_first(rows))
    rows = _first(rows)
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["label", "s"])


def train(docs: DataFrame) -> Ratio:
    """Fits both models on at most SAMPLE labelled strings of each class from docs (text)."""
    with spare_tables():
        rows = save(docs.select(F.col("text").cast("string")).mapInArrow(releasing(_labelled), "label int, s string").distinct())
        pick = lambda k: [r["s"] for r in rows.where(F.col("label") == k).orderBy(F.xxhash64("s"), "s").limit(SAMPLE).collect()]
        return Ratio(pick(1), pick(0))


def all_spans(text: str, ratio: Ratio) -> tuple[list, list]:
    """Base spans, and base and further spans together."""
    base = base_spans(text)
    more = [("markov", m.start(), m.end()) for m in _TOKEN.finditer(text) if ratio.random(m[0]) and not any(a < m.end() and m.start() < b for _, a, b in base)]
    order = {k: i for i, k in enumerate((*KINDS, "markov"))}
    return base, sorted(base + more, key=lambda s: (s[1], order[s[0]], s[2]))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(model):
    def run(batches):
        import pyarrow as pa

        ratio = model.value
        for batch in batches:
            counts, digests, spans = {k: [] for k in KINDS}, [], []
            for text in batch.column(1).to_pylist():
                base, whole = all_spans(text or "", ratio)
                kinds = [s[0] for s in base]
                for k in KINDS:
                    counts[k].append(kinds.count(k))
                digests.append(sha256_hex(joined(base)))
                spans.append(joined(whole))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(_scan(model)), schema)
