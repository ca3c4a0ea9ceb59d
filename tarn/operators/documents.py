"""Documents as readers see them: assembled from leaves, dumped as lines, with attachments; local documents; batches of writes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stamps import fresh_id
from ..sources.collection import shared_folder
from .revisions import bare, leaf_rev, parse_rev, rev_text, winners
from .writes import merge_revs, save

ATTACHMENTS = "map<string, struct<content_type: string, length: bigint, revpos: bigint, digest: string, data: binary>>"


def assemble(leaves: DataFrame, asked: DataFrame | None = None, revs: bool = False, conflicts: bool = False, attachments: bool | None = None) -> DataFrame:
    """Documents (_id, _rev, _deleted, body, and as asked _attachments, _revisions, _conflicts, _deleted_conflicts).

    Without asked, the winner of each id, tombstones too. asked (id, rev text or null) names leaves; a null rev is the live winner, and what isn't there has no row. _deleted is null on live documents and lists without entries are null, so that JSON leaves them out. _conflicts are the other live leaves and _deleted_conflicts the other deleted ones, greatest first. attachments: None leaves them out, False gives stubs, True their data too.
    """
    if asked is not None:
        asked = asked.select("id", parse_rev(F.col("rev")).alias("p"), "rev").distinct()
        leaves = leaves.join(asked.select("id").distinct(), "id", "left_semi")
    # bodies don't take part in the election: they are joined to the leaves that win
    chosen = winners(bare(leaves)).select("id", "pos", leaf_rev().alias("_leaf"), "deleted")
    if asked is not None:
        plain = chosen.where("not deleted").join(asked.where("rev is null"), "id", "left_semi")
        named = asked.where("p is not null").select("id", F.col("p.pos").alias("pos"), F.col("p.rev").alias("_leaf"))
        chosen = plain.select("id", "pos", "_leaf").union(named).distinct()
    rows = leaves.withColumn("_leaf", leaf_rev()).join(chosen.select("id", "pos", "_leaf"), ["id", "pos", "_leaf"], "left_semi")
    out = [F.col("id").alias("_id"), rev_text(F.col("pos"), F.col("_leaf")).alias("_rev"), F.when(F.col("deleted"), F.lit(True)).alias("_deleted"), F.col("body")]
    if attachments is not None and "attachments" in leaves.columns:
        shown = inline(F.col("attachments")) if attachments else stubs(F.col("attachments"))
        out.append(F.when(F.size("attachments") > 0, shown).alias("_attachments"))
    if revs:
        out.append(F.struct(F.col("pos").alias("start"), F.col("path").alias("ids")).alias("_revisions"))
    if conflicts:
        key = F.struct("deleted", "pos", leaf_rev().alias("rev"))
        rows = rows.join(leaves.groupBy("id").agg(F.sort_array(F.collect_list(key), asc=False).alias("_all")), "id")

        def others(deleted: bool) -> Column:
            other = F.filter("_all", lambda o: (o["deleted"] == deleted) & ~((o["pos"] == F.col("pos")) & (o["rev"] == F.col("_leaf"))))
            return F.when(F.size(other) > 0, F.transform(other, lambda o: rev_text(o["pos"], o["rev"])))

        out += [others(False).alias("_conflicts"), others(True).alias("_deleted_conflicts")]
    return rows.select(*out)


def dump(leaves: DataFrame, deleted: bool = False, revs: bool = False, conflicts: bool = False, attachments: bool | None = None) -> DataFrame:
    """One JSON text (value) per winner, without tombstones unless deleted: _id, _rev and _deleted, then the body's fields, then the rest. Bodies are structs, maps or VARIANT; null ones add nothing."""
    docs = assemble(leaves, None, revs, conflicts, attachments)
    docs = docs if deleted else docs.where("_deleted is null")
    tail = [c for c in docs.columns if c not in ("_id", "_rev", "_deleted", "body")]
    texts = [F.to_json(F.struct("_id", "_rev", "_deleted")), F.to_json("body"), *([F.to_json(F.struct(*tail))] if tail else [])]
    inner = [F.when(F.length(t) > 2, F.substring(t, F.lit(2), F.length(t) - 2)) for t in texts]
    return docs.select(F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}")).alias("value"))


# attachments: a column of leaves, a map from names to their entries


def attachment(content_type: Column, data: Column, revpos: Column) -> Column:
    """The entry of an attachment; its digest is the base64 of the md5 of its data."""
    digest = F.concat(F.lit("md5-"), F.base64(F.unhex(F.md5(data))))
    return F.struct(content_type.alias("content_type"), F.octet_length(data).cast("long").alias("length"), revpos.cast("long").alias("revpos"), digest.alias("digest"), data.alias("data"))


def stubs(entries: Column) -> Column:
    """Entries without data; who selects these doesn't read the data's column."""
    return F.transform_values(entries, lambda _, a: F.struct(a["content_type"].alias("content_type"), a["revpos"].alias("revpos"), a["digest"].alias("digest"), a["length"].alias("length"), F.lit(True).alias("stub")))


def inline(entries: Column) -> Column:
    """Entries with data as base64."""
    return F.transform_values(entries, lambda _, a: F.struct(a["content_type"].alias("content_type"), a["revpos"].alias("revpos"), a["digest"].alias("digest"), F.base64(a["data"]).alias("data")))


def get_attachments(leaves: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, name, content_type, length, digest, data, error) for each row of asked (id, name): attachments of live winners; what isn't there is not_found."""
    won = winners(bare(leaves.join(asked.select("id").distinct(), "id", "left_semi"))).where("not deleted").select("id", "pos", leaf_rev().alias("_leaf"))
    rows = leaves.withColumn("_leaf", leaf_rev()).join(won, ["id", "pos", "_leaf"], "left_semi").select("id", F.explode("attachments").alias("name", "a"))
    got = asked.select("id", "name").join(rows, ["id", "name"], "left")
    return got.select("id", "name", "a.content_type", "a.length", "a.digest", "a.data", F.when(F.col("a").isNull(), "not_found").alias("error"))


def put_attachments(leaves: DataFrame, rows: DataFrame, next_seq: int) -> tuple[DataFrame, DataFrame]:
    """(leaves after, outcomes as of save) of rows (id, rev text or null, name, content_type, data), one per id and name and one rev per id: a new revision per id with the body it had. Null data deletes the attachment; no rev on an unknown id makes a document without a body. leaves have id, pos, path, deleted, seq, body, attachments."""
    # body and attachments are saved as one
    kind = leaves.schema["body"].dataType.simpleString()
    pair = lambda body, entries: F.struct(body.alias("body"), F.coalesce(entries, F.create_map().cast(ATTACHMENTS)).alias("attachments"))
    packed = leaves.select("id", "pos", "path", "deleted", "seq", pair(F.col("body"), F.col("attachments")).alias("body"))
    asked = rows.withColumn("p", parse_rev(F.col("rev")))
    revpos = F.coalesce(F.col("p.pos"), F.lit(0)) + 1
    new = asked.groupBy("id", "rev", "p").agg(F.map_from_entries(F.collect_list(F.struct("name", attachment(F.col("content_type"), F.col("data"), revpos).alias("a")))).alias("new"))
    at = leaves.select("id", F.col("pos").alias("_pos"), leaf_rev().alias("_leaf"), F.col("body").alias("_body"), F.col("attachments").alias("_old"))
    both = new.alias("n").join(at.alias("l"), (F.col("n.id") == F.col("l.id")) & (F.col("p.pos") == F.col("_pos")) & (F.col("p.rev") == F.col("_leaf")), "left").drop(F.col("l.id"))
    kept = F.map_filter(F.coalesce("_old", F.create_map().cast(ATTACHMENTS)), lambda k, _: ~F.map_contains_key("new", k))
    put = F.map_filter("new", lambda _, a: a["data"].isNotNull())
    docs = both.select("id", "rev", F.lit(False).alias("deleted"), pair(F.col("_body").cast(kind), F.map_concat(kept, put.cast(ATTACHMENTS))).alias("body"))
    after, outcome = save(packed, docs, next_seq)
    return after.select("id", "pos", "path", "deleted", "seq", F.col("body.body").alias("body"), F.col("body.attachments").alias("attachments")), outcome


# local documents: (id, n, body), n counting the saves


def local_docs(local: DataFrame, start: str | None = None, end: str | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """(_id, _rev, body) of local documents with ids from start to end, in order of ids."""
    rows = local if start is None else local.where(F.col("id") >= start)
    rows = rows if end is None else rows.where(F.col("id") <= end)
    rows = rows.select(F.col("id").alias("_id"), F.concat(F.lit("0-"), F.col("n").cast("string")).alias("_rev"), "body").orderBy("_id")
    rows = rows.offset(skip) if skip else rows
    return rows if limit is None else rows.limit(limit)


def get_local(local: DataFrame, key: str) -> DataFrame:
    return local_docs(local.where(F.col("id") == key))


def _save_local(local: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(local after, outcomes) of docs (n, id, body), ids repeated or not: each row is a save, and the body of the last one stays."""
    known = local.select("id", F.col("n").alias("_had"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("n"))
    rows = docs.withColumn("_k", place).join(known, "id", "left").withColumn("_at", (F.coalesce("_had", F.lit(0)) + F.col("_k")).cast("long"))
    last = rows.groupBy("id").agg(F.max("_at").alias("n"), F.max_by(F.struct("body"), "n").alias("b")).select("id", "n", "b.body")
    told = rows.select("n", "id", F.lit(True).alias("ok"), F.concat(F.lit("0-"), F.col("_at").cast("string")).alias("rev"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("reason"))
    return local.join(docs.select("id").distinct(), "id", "left_anti").select("id", "n", "body").unionByName(last), told


def bulk_docs(leaves: DataFrame, local: DataFrame, docs: DataFrame, next_seq: int, new_edits: bool = True, validator: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves after, local documents after, results (n, id, ok, rev, error, reason)) of one request, docs being numbered by n without ties.

    new_edits: docs (n, id, rev text or null, deleted, body) are saved in order of n, so a later row of an id sees what an earlier one left; there are as many rounds as an id has rows, and leaves are checkpointed between them. A null id becomes a fresh one. Otherwise docs (n, id, pos, path, deleted, body) are merged as replicated, and results tell errors only. Ids that start with _local/ are local documents in both.
    """
    is_local = F.coalesce(F.col("id").startswith("_local/"), F.lit(False))
    if not new_edits:
        locals_after, _ = _save_local(local, docs.where(is_local).select("n", "id", "body"))
        after, errors = merge_revs(leaves, docs.where(~is_local).select("id", F.col("pos").cast("long").alias("pos"), "path", "deleted", F.col("n").cast("long").alias("seq"), "body"), next_seq)
        at = docs.where(~is_local).select("n", "id", rev_text(F.col("pos"), leaf_rev()).alias("rev"))
        told = at.join(errors, ["id", "rev"]).select("n", "id", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("rev"), "error", F.lit("Invalid rev format").alias("reason"))
        return after, locals_after, told.distinct()
    docs = docs.withColumn("id", F.coalesce("id", fresh_id(uuid.uuid4().hex, F.col("n"))))
    locals_after, results = _save_local(local, docs.where(is_local).select("n", "id", "body"))
    rows = docs.where(~is_local).withColumn("_round", F.row_number().over(Window.partitionBy("id").orderBy("n")))
    rounds = rows.agg(F.max("_round")).first()[0] or 0
    if rounds > 1:
        shared_folder(leaves.sparkSession)
    for k in range(1, rounds + 1):
        now = rows.where(F.col("_round") == k)
        leaves, outcome = save(leaves, now.select("id", "rev", "deleted", "body"), next_seq, validator)
        told = now.select("n", "id").join(outcome, "id").select("n", "id", "ok", "rev", "error", "reason")
        if rounds > 1:
            leaves, told = leaves.checkpoint(), told.checkpoint()
            next_seq = max(next_seq, (leaves.agg(F.max("seq")).first()[0] or 0) + 1)
        results = results.unionByName(told)
    return leaves, locals_after, results
