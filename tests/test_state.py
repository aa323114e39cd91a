"""Streams that keep state: the memory, the outbox, dictionaries handed on."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from segmill.operators import memory
from segmill.sources import versioned
from segmill.streaming import events

ENTRY = "key string, source string, target string, seq long"


def files_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_memory_in_deltas(spark, tmp_path):
    """Equal to a merge of everything, after every batch; a batch writes little; folders stay few; batches that run again change nothing."""
    rng = random.Random(1)
    (tmp_path / "in").mkdir()
    rows = []
    for k in range(9):
        own = [(f"k{rng.randint(0, 400)}", "s", rng.choice(["s", f"t{k}", None]), 1000 * k + i) for i in range(2000 if k == 0 else 30)]
        rows += own
        pd.DataFrame(own, columns=["key", "source", "target", "seq"]).to_parquet(tmp_path / f"in/{k}.parquet")
        events.memory_stream(stream_of(spark, tmp_path / "in", ENTRY), str(tmp_path / "tm"), str(tmp_path / "ck")).awaitTermination(120)
        best = {}
        for key, source, target, seq in rows:
            if target is not None and target != source:
                best[key] = max(best.get(key, (-1,)), (seq, source, target))
        got = {r["key"]: (r["seq"], r["source"], r["target"]) for r in events.stored_memory(spark, str(tmp_path / "tm")).collect()}
        assert got == best
    version, entries = versioned.manifest(spark, str(tmp_path / "tm"))
    assert version == 8 and len(entries) <= 6
    before = [tuple(r) for r in events.stored_memory(spark, str(tmp_path / "tm")).orderBy("key").collect()]
    events.memory_stream(stream_of(spark, tmp_path / "in", ENTRY), str(tmp_path / "tm"), str(tmp_path / "other-ck")).awaitTermination(120)
    assert [tuple(r) for r in events.stored_memory(spark, str(tmp_path / "tm")).orderBy("key").collect()] == before
    assert versioned.manifest(spark, str(tmp_path / "tm")) == (version, entries)


def event(n, **more):
    return {"event_id": f"e{n}", "event_time": "2026-01-01T00:00:00Z", "patient": {"patient_id": "PT-2026-0001", "name": "A B", "email": "a@b.org", "phone": "+1 555 0100 200"}} | more


@pytest.mark.parametrize("killed", ["before the send", "after the send", "never"])
def test_every_event_is_sent_once(spark, tmp_path, monkeypatch, killed):
    """Killed at either side of the send, with a sink that fails for a while, repeated events, and events without an id."""
    (tmp_path / "in").mkdir()
    sink, down = str(tmp_path / "sink"), []

    def held():
        return spark.read.schema("key string, event_id string").json(sink) if os.path.isdir(sink) else spark.createDataFrame([], "key string, event_id string")

    def forward(rows):
        if down:
            raise ConnectionError
        rows.write.mode("append").json(sink)

    def run():
        query = events.forward_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), forward, received=lambda keys: keys.join(held().select("key"), "key", "left_semi"))
        try:
            query.awaitTermination(60)
        except StreamingQueryException:
            return False
        return True

    def put(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)))

    def dies(*_):
        raise OSError("killed")

    put("a.json", [event(1), event(2), event(2), event(3) | {"event_id": None}])
    if killed == "before the send":
        with monkeypatch.context() as m:
            m.setattr(events.V, "read", dies)
            assert not run() and held().count() == 0
    elif killed == "after the send":
        commit = events.V.commit
        with monkeypatch.context() as m:
            m.setattr(events.V, "commit", lambda s, p, version, entries: commit(s, p, version, entries) if version % 2 == 0 else dies())
            assert not run() and held().count() == 3
    assert run() and held().count() == 3
    down.append(1)
    put("b.json", [event(4), event(1)])
    assert run() and held().count() == 3
    down.clear()
    put("c.json", [event(5)])
    assert run()
    assert sorted(str(r["event_id"]) for r in held().collect()) == ["None", "e1", "e2", "e4", "e5"]
    out = spark.read.json(str(tmp_path / "out"))
    assert {(r["forward"], r["masked"]["event_id"]) for r in out.collect()} == {("forwarded", "e1"), ("forwarded", "e2"), ("forwarded", None), ("failed: ConnectionError", "e4"), ("forwarded", "e5")}
    assert "a@b.org" not in str(out.collect()) and versioned.manifest(spark, str(tmp_path / "out/_outbox"))[1] == []


ANSWER = "file string, batch long, terms array<struct<term:string,translation:string>>"


def test_dictionaries_are_handed_on(spark, tmp_path):
    """Answers in any order and dealt in any way, over a restart, give what a serial run gives: the first translation of a term stays."""
    rng = random.Random(7)
    answers = {(f"f{f}", b): [{"term": rng.choice("abcdefg"), "translation": rng.choice(["x", "y", "z", ""])} for _ in range(rng.randint(0, 3))] for f in range(4) for b in range(rng.randint(1, 9))}
    want = {}
    for f in {f for f, _ in answers}:
        known = {}
        for b in sorted(b for g, b in answers if g == f):
            for t in answers[f, b]:
                if t["term"] and t["translation"]:
                    known.setdefault(t["term"], t["translation"])
            want[f, b + 1] = dict(known)
    order = list(answers)
    rng.shuffle(order)
    order += order[:4]  # some come again
    (tmp_path / "in").mkdir()

    def run():
        stream = events.dictionaries(stream_of(spark, tmp_path / "in", ANSWER))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)

    third = len(order) // 3
    for k in range(3):
        part = order[k * third : (k + 1) * third if k < 2 else None]
        rows = spark.createDataFrame([(f, b, answers[f, b]) for f, b in part], ANSWER)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    got = [((r["file"], r["batch"]), r["known"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_upserts_of_batches_in_any_order(spark):
    rows = spark.createDataFrame([("k", "s", "b", 2), ("k", "s", "a", 1), ("l", "s", "c", 1)], ENTRY)
    halves = memory.upsert(memory.upsert(rows.limit(1), ["key"], "seq").unionByName(rows.where(F.col("seq") == 1)), ["key"], "seq")
    assert {r["key"]: r["target"] for r in halves.collect()} == {"k": "b", "l": "c"}
