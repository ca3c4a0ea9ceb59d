"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html, near_duplicates, nearest, packing, pii, secrets, token_counts, toxicity
from .common import read


def bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract_pii(read(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(chat.format_chat(turns.unionByName(extra)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), bpe_path())


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), bpe_path())


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_secrets, op3_toxicity, op4_jaccard_join, op5_pii, op6_chat, op7_token_counts, op8_html, op9_packing, op10_nearest)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT DISTINCT item_id, w, least(len(w), 10) AS win FROM (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, win, array_to_string(w[s:s + win - 1], ' ') AS t FROM i, LATERAL (SELECT unnest(range(1, len(w) - win + 2)) AS s)),
dw AS (SELECT k, s, win, array_to_string(w[s:s + win - 1], ' ') AS t FROM d, (SELECT DISTINCT win FROM i), LATERAL (SELECT unnest(range(1, len(w) - win + 2)) AS s)),
m AS (SELECT k, s, win, item_id FROM dw JOIN iw USING (win, t)),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM m, LATERAL (SELECT unnest(range(s, s + win)) AS p) GROUP BY k),
n AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS x FROM m WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN n USING (k)
"""

CLASSES_SQL = r"""
w AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM docs),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS t FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT r.x, g.b FROM r JOIN both_ways g ON r.y = g.a),
c AS (SELECT x AS doc_id, min(y) AS low FROM r GROUP BY x)
"""

JACCARD_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), {CLASSES_SQL}
SELECT docs.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, docs.doc_id) AS component_id
FROM docs LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(replace(replace(text, '~', '~0'), '<|', '<~1')) + CASE WHEN before IS NOT DISTINCT FROM role THEN 10 ELSE 12 + length(role) + 1 + 11 END)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {"op1_decontamination": DECONTAMINATION_SQL, "op4_jaccard_join": JACCARD_SQL, "op6_chat": CHAT_SQL}
