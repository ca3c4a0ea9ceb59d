"""A pipeline over the table documents: toxic texts go, near duplicates leave one of each class, contaminated texts go, personal data is masked, and the rest is packed.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents, n_chars being the code points of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import decontaminate, near_duplicates, packing, pii, toxicity
from tarn.llm.common import outlive, read, spare_tables
from tarn.llm.queries import bpe_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier calls toxic."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near duplicates the document with the smallest id."""
    return near_duplicates.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind in brackets."""
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens."""
    return packing.pack(docs, bpe_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]
#: Stages 1, 4 and 5 have no SQL form. Tests compare stages 2 and 3 with a plain version and 4 with the base patterns, the first with the operator's own scores; op9's tests compare packing with the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with spare_tables():
            docs = outlive(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
