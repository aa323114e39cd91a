"""Event streams: a synthetic source, masking on the way, and a memory that each batch extends."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from ..operators import memory as M
from ..operators.masking import masked_event
from ..sources import versioned as V

SCHEMA = "event_id string, event_time string, source_system string, patient struct<patient_id:string,name:string,email:string,phone:string>, encounter struct<department:string,device_id:string>, ecg_summary struct<heart_rate:int,rhythm:string,sample_window_seconds:int>"


def synthetic(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """Made-up events at a fixed rate."""
    n = F.col("value")
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(
        F.concat(F.lit("evt-"), n).alias("event_id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_time"), F.lit("sender").alias("source_system"),
        F.struct(F.format_string("PT-2026-%04d", n % 10000).alias("patient_id"), F.lit("Test Person").alias("name"), F.lit("person@example.org").alias("email"), F.lit("+1 555 0100 200").alias("phone")).alias("patient"),
        F.struct(F.lit("cardiology").alias("department"), F.concat(F.lit("dev-"), n % 5).alias("device_id")).alias("encounter"),
        F.struct((60 + n % 40).cast("int").alias("heart_rate"), F.lit("sinus").alias("rhythm"), F.lit(10).alias("sample_window_seconds")).alias("ecg_summary"),
    )


def mask_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """JSON events from a folder, masked, to JSON; what is there now, then the query ends. The unmasked event isn't kept."""
    events = spark.readStream.schema(SCHEMA).json(source)
    out = masked_event(events).select(F.current_timestamp().alias("processed_at"), F.struct(*(F.col(c) for c in events.columns)).alias("masked"))
    return out.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


OUTBOX = "key string, masked string"


def forward_stream(spark: SparkSession, source: str, target: str, checkpoint: str, forward: Callable[[DataFrame], None] | None = None, received: Callable[[DataFrame], DataFrame] | None = None, late: str = "1 hour") -> StreamingQuery:
    """mask_stream() with a forward step over an outbox: each event is taken once, sent once, and kept until it is sent.

    Events that come again within `late` of their time are dropped by their id, without one by all they hold. A batch's masked events are first written to the
    outbox under keys `batch/event`; then all that is in it, also what earlier batches failed to send, is handed to
    `forward` as (key, event columns), a write to any sink; then a manifest empties it. If the run dies in between, the events are still
    in the outbox: `received`, a function from a table of keys to those the sink holds, leaves out what had arrived; without it
    the sink has to tell repeated keys itself. target/batch=N holds the batch's events with what became of the sending: not
    configured, forwarded, or the error.
    """
    read = spark.readStream.schema(SCHEMA).json(source)
    timed = read.withColumns({"_at": F.coalesce(F.try_to_timestamp("event_time"), F.current_timestamp()), "_id": F.coalesce("event_id", F.sha2(F.to_json(F.struct("*")), 256))})
    events = timed.withWatermark("_at", late).dropDuplicatesWithinWatermark(["_id"]).drop("_at")
    outbox = f"{target}/_outbox"

    def send(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        rows = masked_event(batch).select(F.concat_ws("/", F.lit(n), "_id").alias("key"), F.to_json(F.struct(*(c for c in batch.columns if c != "_id"))).alias("masked"))
        # the batch is gone through once, always and whole, as the state of its stream asks; a batch that runs again writes the same
        new = V.add(rows, outbox, f"{n}", f"data/batch={n}")
        version, waiting = V.manifest(session, outbox)
        if version > 2 * n or not (waiting or new.rows):
            return
        if version < 2 * n:
            waiting = [*waiting, new]
            V.commit(session, outbox, 2 * n, waiting)
        status = "not configured"
        if forward is not None:
            due = V.read(session, outbox, OUTBOX, waiting)
            if received is not None:
                due = due.join(received(due.select("key")).select("key").distinct(), "key", "left_anti")
            try:
                if not due.isEmpty():
                    forward(due.select("key", F.from_json("masked", SCHEMA).alias("e")).select("key", "e.*"))
                status = "forwarded"
            except Exception as e:  # the outcome is part of the record; the events stay in the outbox
                status = f"failed: {type(e).__name__}"
        own = [e for e in waiting if e.name == f"{n}" and e.rows]
        if own:
            V.read(session, outbox, OUTBOX, own).select(F.current_timestamp().alias("processed_at"), F.lit(status).alias("forward"), F.from_json("masked", SCHEMA).alias("masked")).write.mode("overwrite").json(f"{target}/batch={n}")
        V.commit(session, outbox, 2 * n + 1, waiting if status.startswith("failed") else [])

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MEMORY = "key string, source string, target string, seq long"


def memory_stream(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """results(key, source, target, seq) added to the memory at path, batch by batch; read it with stored_memory().

    A batch writes its own entries, one a key, and now and then merges the last folders: a row is rewritten some log2(memory / batch)
    times in all. Results that only repeat their source are left out. A batch that runs again changes nothing.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        version, entries = V.manifest(spark, path)
        if version >= n:
            return
        fresh = batch.select("key", "source", "target", "seq").where("target <> source")
        entries = [*entries, V.add(M.upsert(fresh, ["key"], "seq").select("key", "source", "target", "seq"), path, f"{n}", f"data/batch={n}")]
        entries = V.merged_tail(path, entries, lambda rows: M.upsert(rows, ["key"], "seq").select("key", "source", "target", "seq"), MEMORY, spark)
        V.commit(spark, path, n, [e for e in entries if e.rows])

    return results.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_memory(spark: SparkSession, path: str) -> DataFrame:
    """The memory as the last batch left it: of each key the entry with the greatest seq."""
    return M.upsert(V.read(spark, path, MEMORY), ["key"], "seq").select("key", "source", "target", "seq")


ORDERED = StructType([StructField("file", StringType()), StructField("batch", LongType()), StructField("known", MapType(StringType(), StringType()))])
WAITING = StructType([StructField("next", LongType()), StructField("known", StringType()), StructField("waiting", StringType())])


def _handed_on(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The answers of one file: each batch's terms are added once all batches before it are, the first translation of a term stays."""
    at, known, waiting = state.get if state.exists else (0, "{}", "{}")
    known, waiting = json.loads(known), json.loads(waiting)
    for rows in batches:
        for n, terms in zip(rows["batch"].tolist(), rows["terms"].tolist(), strict=True):
            if n >= at:
                waiting.setdefault(str(n), [[t["term"], t["translation"]] for t in (terms if terms is not None else [])])
    out = []
    while str(at) in waiting:
        for term, translation in waiting.pop(str(at)):
            if term and translation:
                known.setdefault(term, translation)
        at += 1
        out.append((key[0], at, dict(known)))
    state.update((at, json.dumps(known), json.dumps(waiting)))
    yield pd.DataFrame(out, columns=["file", "batch", "known"])


def dictionaries(answers: DataFrame) -> DataFrame:
    """A stream of answers(file, batch from 0, terms array<struct<term, translation>>), in any order -> (file, batch, known): what the prompt of each
    batch from the second on has to know, the terms of all batches before it.

    The state of a file is its dictionary, the next batch, and the answers that came too early. A batch that comes again is ignored, and so is
    an answer that never comes: what is behind it waits. Nothing depends on how answers are dealt to micro-batches.
    """
    return answers.groupBy("file").applyInPandasWithState(_handed_on, ORDERED, WAITING, "append", GroupStateTimeout.NoTimeout)


def per_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events per minute and type of a stream with ts; the time is cast, since watermarks need one with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "event_type").agg(F.count("*").alias("n"))
