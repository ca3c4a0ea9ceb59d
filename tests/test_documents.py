"""Assembled documents, attachments, local documents, batches of writes, waiting feeds and dates."""

import base64
import email.utils
import hashlib
import json
import random
import time
from datetime import datetime, timezone

from pyspark.sql import functions as F

from tarn.functions.stamps import http_date, iso8601
from tarn.operators import documents as dc
from tarn.operators import revisions as rv
from tarn.streaming import changes as ch

LEAF = "id string, pos long, path array<string>, deleted boolean, seq long, body struct<a: int, b: string>"
ROWS = [
    ("x", 2, ["c", "a"], False, 3, (1, None)), ("x", 2, ["b", "a"], False, 2, (2, "two")), ("x", 3, ["z", "y", "a"], True, 4, (3, None)),
    ("y", 1, ["q"], True, 5, None), ("z", 1, ["r"], False, 6, (7, "k\"\n")),
]


def told(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_assembled_documents(spark):
    leaves = spark.createDataFrame(ROWS, LEAF)
    got = {r["_id"]: r.asDict(True) for r in dc.assemble(leaves, revs=True, conflicts=True).collect()}
    assert got["x"] == {"_id": "x", "_rev": "2-c", "_deleted": None, "body": {"a": 1, "b": None}, "_revisions": {"start": 2, "ids": ["c", "a"]}, "_conflicts": ["2-b"], "_deleted_conflicts": ["3-z"]}
    assert got["y"]["_deleted"] is True and got["y"]["body"] is None and got["z"]["_conflicts"] is None
    asked = spark.createDataFrame([("x", "3-z"), ("x", "2-b"), ("x", "2-b"), ("x", "1-a"), ("x", "junk"), ("y", None), ("z", None), ("no", None), (None, None)], "id string, rev string")
    named = dc.assemble(leaves, asked, conflicts=True)
    assert told(named, "_id", "_rev") == [("x", "2-b"), ("x", "3-z"), ("z", "1-r")]
    assert [r["_conflicts"] for r in named.where("_rev = '3-z'").collect()] == [["2-c", "2-b"]]
    assert dc.assemble(leaves.limit(0), revs=True, conflicts=True).collect() == []


def test_dumped_lines(spark):
    leaves = spark.createDataFrame(ROWS, LEAF)
    assert sorted(r["value"] for r in dc.dump(leaves).collect()) == ['{"_id":"x","_rev":"2-c","a":1}', '{"_id":"z","_rev":"1-r","a":7,"b":"k\\"\\n"}']
    every = {d["_id"]: d for d in (json.loads(r["value"]) for r in dc.dump(leaves, deleted=True, revs=True, conflicts=True).collect())}
    assert every["y"] == {"_id": "y", "_rev": "1-q", "_deleted": True, "_revisions": {"start": 1, "ids": ["q"]}}
    assert every["x"]["_deleted_conflicts"] == ["3-z"]
    variants = leaves.withColumn("body", F.parse_json(F.to_json("body")))
    assert sorted(r["value"] for r in dc.dump(variants).collect()) == sorted(r["value"] for r in dc.dump(leaves).collect())


def test_attachments(spark):
    leaves = spark.createDataFrame(ROWS, LEAF).withColumn("attachments", F.lit(None).cast(dc.ATTACHMENTS))
    rows = "id string, rev string, name string, content_type string, data binary"
    put = spark.createDataFrame([("x", "2-b", "one", "text/plain", b"1"), ("x", "2-b", "two", "text/html", b""), ("z", None, "one", "t", b"?"), ("z", "9-r", "one", "t", b"?"), ("new", None, "n", "t", b"\x00\xff")], rows)
    first, outcome = dc.put_attachments(leaves, put.where("id <> 'z' or rev is null"), 10)
    assert told(outcome, "id", "ok", "error") == [("new", True, None), ("x", True, None), ("z", False, "conflict")]
    assert told(dc.put_attachments(leaves, put.where("rev = '9-r'"), 10)[1], "ok", "error") == [(False, "conflict")]
    won = {r["_id"]: r.asDict(True) for r in dc.assemble(first, attachments=False).collect()}
    digest = "md5-" + base64.b64encode(hashlib.md5(b"1").digest()).decode()
    assert won["x"]["body"] == {"a": 2, "b": "two"} and won["x"]["_attachments"]["one"] == {"content_type": "text/plain", "revpos": 3, "digest": digest, "length": 1, "stub": True}
    assert won["z"]["_attachments"] is None and won["new"]["body"] is None
    assert json.loads(next(r["value"] for r in dc.dump(first, attachments=True).collect() if '"new"' in r["value"]))["_attachments"]["n"]["data"] == base64.b64encode(b"\x00\xff").decode()
    # a later revision keeps what it doesn't name, with the revpos it had
    again = spark.createDataFrame([("x", won["x"]["_rev"], "one", None, None), ("x", won["x"]["_rev"], "three", "t", b"3")], rows)
    second, _ = dc.put_attachments(first, again, 20)
    kept = next(r.asDict(True) for r in dc.assemble(second, attachments=False).collect() if r["_id"] == "x")
    assert {k: v["revpos"] for k, v in kept["_attachments"].items()} == {"two": 3, "three": 4}
    asked = spark.createDataFrame([("x", "three"), ("x", "one"), ("y", "one"), ("none", "one")], "id string, name string")
    assert told(dc.get_attachments(second, asked), "id", "name", "data", "error")[1:3] == [("x", "one", None, "not_found"), ("x", "three", b"3", None)]


def plain_batch(docs):
    """Documents with one branch each, saved one after the other: (results, live ids)."""
    state, results = {}, []
    for n, key, rev, deleted in docs:
        now = state.get(key)
        good = (rev is None and (now is None or now[1])) or (rev is not None and now is not None and rev == now[0])
        if good:
            state[key] = (f"new{n}", deleted)
        results.append((n, good))
    return results, sorted(k for k, (_, gone) in state.items() if not gone)


def test_batches_with_repeated_ids(spark):
    rng = random.Random(3)
    docs = [(n, rng.choice("abcd"), rng.choice([None, None, "1-nope"]), rng.random() < 0.5) for n in range(14)]
    none = spark.createDataFrame([], "id string, pos long, path array<string>, deleted boolean, seq long, body string")
    local = spark.createDataFrame([("_local/p", 4, "old"), ("_local/q", 1, "q")], "id string, n long, body string")
    more = [(100, "_local/p", None, False, "b1"), (101, "_local/p", None, False, "b2"), (102, None, None, False, "anon"), (103, "_bad", None, False, "x")]
    rows = spark.createDataFrame([(*d, str(d[0])) for d in docs] + more, "n long, id string, rev string, deleted boolean, body string")
    after, locals_after, results = dc.bulk_docs(none, local, rows, 1)
    got = {r["n"]: r for r in results.collect()}
    expected, live = plain_batch(docs)
    assert [(n, got[n]["ok"]) for n, _ in expected] == expected
    assert (got[100]["rev"], got[101]["rev"]) == ("0-5", "0-6") and got[102]["ok"] and len(got[102]["id"]) == 32 and got[103]["error"] == "bad_request"
    kept = [r["id"] for r in rv.winners(rv.bare(after)).where("not deleted").collect()]
    assert sorted(k for k in kept if len(k) == 1) == live and got[102]["id"] in kept
    seqs = [r["seq"] for r in after.collect()]
    assert len(set(seqs)) == len(seqs)
    assert told(dc.local_docs(locals_after), "_id", "_rev", "body") == [("_local/p", "0-6", "b2"), ("_local/q", "0-1", "q")]
    assert told(dc.get_local(locals_after, "_local/q"), "_rev") == [("0-1",)] and told(dc.local_docs(locals_after, "_local/p", skip=1, limit=1), "_id") == [("_local/q",)]


def test_replicated_batches_tell_errors_only(spark):
    leaves = spark.createDataFrame([("a", 1, ["x"], False, 1, "old")], "id string, pos long, path array<string>, deleted boolean, seq long, body string")
    local = spark.createDataFrame([], "id string, n long, body string")
    docs = spark.createDataFrame([(1, "a", 2, ["y", "x"], False, "new"), (2, "b", 1, ["p", "q"], False, "short"), (3, "_local/c", 1, ["l"], False, "l")], "n long, id string, pos long, path array<string>, deleted boolean, body string")
    after, locals_after, results = dc.bulk_docs(leaves, local, docs, 5, new_edits=False)
    assert told(after, "id", "pos", "body") == [("a", 2, "new")] and told(results, "n", "id", "ok", "error") == [(2, "b", False, "bad_request")]
    assert told(locals_after, "id", "n") == [("_local/c", 1)]


def test_purge_log(spark):
    gone = spark.createDataFrame([("a", "1-x"), ("b", "1-y")], "id string, rev string")
    log = rv.purge_log(gone, 7)
    assert [r["purge_seq"] for r in log.orderBy("purge_seq").collect()] == [8, 9]
    assert rv.purge_seq(log).first()[0] == 9 and rv.purge_seq(log.limit(0)).first()[0] == 0


def test_waiting_feeds(spark):
    kind = "id string, pos long, path array<string>, deleted boolean, seq long"
    tables = [spark.createDataFrame([(f"d{k}", 1, ["r"], k == 2, k + 1) for k in range(n)], kind) for n in (2, 2, 3, 5)]

    def reader():
        left = list(tables)
        return lambda: left.pop(0) if len(left) > 1 else left[0]

    at_once = ch.longpoll(lambda: tables[0], since=0, timeout=30)
    assert at_once.rows.count() == 2 and at_once.last_seq == 2
    got = ch.longpoll(reader(), timeout=30, poll=0.01)
    assert [r["id"] for r in got.rows.collect()] == ["d2"] and got.last_seq == 3
    begun = time.monotonic()
    quiet = ch.longpoll(lambda: tables[0], timeout=0.2, poll=0.05)
    assert quiet.rows.isEmpty() and quiet.last_seq == 2 and time.monotonic() - begun < 20
    assert [r["seq"] for r in ch.continuous(reader(), since=1, timeout=0.3, poll=0.01)] == [2, 3, 4, 5]
    assert [r["seq"] for r in ch.continuous(reader(), limit=3, timeout=30, poll=0.01)] == [1, 2, 3]
    beats = ch.continuous(lambda: tables[0], since="now", heartbeat=0.01, poll=0.01)
    assert [next(beats), next(beats)] == [None, None]
    assert [r["value"] for r in ch.changes_lines(tables[2], 1).collect()] == ['{"seq":2,"id":"d1","rev":"1-r"}', '{"seq":3,"id":"d2","rev":"1-r","deleted":true}']


def test_dates(spark):
    seconds = [0, -1, 951782400, 1704585599, 4102444800, -62135596800, None]
    rows = spark.createDataFrame([(s,) for s in seconds], "s long").select("s", iso8601(F.col("s")).alias("iso"), http_date(F.col("s")).alias("http")).collect()
    for s, iso, http in rows:
        if s is None:
            assert iso is None and http is None
        else:
            t = datetime.fromtimestamp(s, timezone.utc) if s > -10**10 else datetime(1, 1, 1, tzinfo=timezone.utc)
            assert iso == t.strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0") and http == email.utils.format_datetime(t, usegmt=True)
