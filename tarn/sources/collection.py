"""A collection: documents as a DataFrame, the name of the id, and its indexes."""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.planner import IndexDef


@dataclass(frozen=True)
class Collection:
    """df holds one row per document: columns that are the document, or with body the name of one VARIANT column. deleted names the column that marks tombstones, if there is one."""

    df: DataFrame
    id: str = "_id"
    body: str | None = None
    deleted: str | None = None
    nulls: str = "missing"
    indexes: tuple[IndexDef, ...] = field(default=())

    def with_index(self, index: IndexDef) -> tuple[Collection, str]:
        """The collection with an index, and "created", or "exists" if one of that definition is there."""
        if any(i.same(index) for i in self.indexes):
            return self, "exists"
        return replace(self, indexes=(*self.indexes, index)), "created"

    def without_index(self, name: str) -> Collection:
        return replace(self, indexes=tuple(i for i in self.indexes if i.name != name))

    def list_indexes(self) -> list[dict]:
        return [{"ddoc": None, "name": "_all_docs", "type": "special", "def": {"fields": [{"_id": "asc"}]}}, *(i.as_dict() for i in self.indexes)]

    def live(self) -> Column:
        return ~F.coalesce(F.col(self.deleted), F.lit(False)) if self.deleted else F.lit(True)

    def scan(self) -> DataFrame:
        """Live documents but design documents."""
        df = self.df.where(self.live()) if self.deleted else self.df
        return df.where(~F.col(self.id).startswith("_design/")) if dict(df.dtypes)[self.id] == "string" else df

    def design_docs(self) -> DataFrame:
        return self.df.where(self.live() & F.col(self.id).startswith("_design/"))

    def get(self, key: object) -> DataFrame:
        return self.df.where(F.col(self.id) == key)

    def id_range(self, start: object = None, end: object = None) -> DataFrame:
        df = self.df if start is None else self.df.where(F.col(self.id) >= start)
        return df if end is None else df.where(F.col(self.id) <= end)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder stands in for it only where all runs on one machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarn-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def read_ndjson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, local documents, rejects) of a file of JSON lines. Documents: _id, _rev, _deleted, revisions (start, ids), body VARIANT; the lines that are no JSON objects with a text _id are rejects (value)."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("body", F.try_parse_json("value"))
    lines = lines.withColumn("_id", F.try_variant_get("body", "$._id", "string"))
    good = F.coalesce(F.schema_of_variant("body").startswith("OBJECT") & F.schema_of_variant(F.try_variant_get("body", "$._id", "variant")).startswith("STRING"), F.lit(False))
    rows = lines.where(good).select(
        "_id",
        F.try_variant_get("body", "$._rev", "string").alias("_rev"),
        F.coalesce(F.try_variant_get("body", "$._deleted", "boolean"), F.lit(False)).alias("_deleted"),
        F.from_json(F.to_json(F.try_variant_get("body", "$._revisions", "variant")), "start long, ids array<string>").alias("revisions"),
        "body",
    )
    local = F.col("_id").startswith("_local/")
    return rows.where(~local), rows.where(local).select("_id", "_rev", "body"), lines.where(~good).select("value")


def write_ndjson(df: DataFrame, path: str, body: str | None = None) -> None:
    """One JSON line per document; null columns are left out."""
    df.select((F.to_json(body) if body else F.to_json(F.struct("*"))).alias("value")).write.text(path)


def generate(spark: SparkSession, n: int, prefix: str = "doc-", doc_kb: float = 1.0) -> DataFrame:
    """n synthetic documents: _id, n, group (n mod 100), data of about doc_kb KiB."""
    chunks = max(1, int(doc_kb * 1024 / 64))
    data = F.concat(*[F.sha2(F.concat_ws("-", F.col("id"), F.lit(k)), 256) for k in range(min(chunks, 64))])
    return spark.range(n).select(F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), 10, "0")).alias("_id"), F.col("id").alias("n"), (F.col("id") % 100).alias("group"), (data if chunks <= 64 else F.repeat(data, chunks // 64)).alias("data"))
