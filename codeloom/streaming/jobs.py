"""Ingest jobs: an append-only event log (job_id, seq, ts, event, value), read as a batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "cancelled", "failed")
STATUS = {"queued": "queued", "analysis_progress": "running", "summarization_progress": "running", "paused": "paused", "resumed": "running", "completed": "completed", "cancelled": "cancelled", "failed": "failed"}


def valid(events: DataFrame) -> DataFrame:
    """Events up to the first terminal one of each job; what comes later is ignored."""
    end = events.where(F.col("event").isin(*TERMINAL)).groupBy("job_id").agg(F.min("seq").alias("end_"))
    return events.join(end, "job_id", "left").where(F.col("end_").isNull() | (F.col("seq") <= F.col("end_"))).drop("end_")


def status_of(event):
    out = F.lit("queued")
    for k, v in STATUS.items():
        out = F.when(event == k, v).otherwise(out)
    return out


def latest_status(events: DataFrame) -> DataFrame:
    """(job_id, status, seq): the state after the last valid event."""
    last = valid(events).groupBy("job_id").agg(F.max(F.struct("seq", "event")).alias("m"))
    return last.select("job_id", status_of(F.col("m.event")).alias("status"), F.col("m.seq").alias("seq"))


def progress(events: DataFrame) -> DataFrame:
    """(job_id, n_analysis, n_summarization, phase): progress events seen so far."""
    v = valid(events).groupBy("job_id").agg(F.count_if(F.col("event") == "analysis_progress").alias("n_analysis"), F.count_if(F.col("event") == "summarization_progress").alias("n_summarization"))
    return v.withColumn("phase", F.when(F.col("n_summarization") > 0, "summarization").otherwise("analysis"))


def enqueue(events: DataFrame) -> DataFrame:
    """(job_id, seq, existing): requests; one that finds an active job of the same repository gets that job."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("run_", F.coalesce(F.count_if(F.col("event").isin(*TERMINAL)).over(w), F.lit(0)))
    first = Window.partitionBy("job_id", "run_").orderBy("seq")
    return e.where("event = 'queued'").select("job_id", "seq", (F.row_number().over(first) > 1).alias("existing"))


def rendered(events: DataFrame) -> DataFrame:
    text = F.when(F.col("event") == "queued", "queued").when(F.col("event").endswith("_progress"), F.concat(F.regexp_replace("event", "_progress", ""), F.lit(" "), F.format_number("value", 1))).otherwise(F.col("event"))
    return events.select("job_id", "seq", text.alias("text"))


def stream_status(events: DataFrame) -> DataFrame:
    """The latest status of a stream of events, kept in a state per job. Late and repeated events change nothing."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, status = state.get if state.exists else (-1, "queued")
        rows = pd.concat(list(frames)).sort_values("seq")
        for s, e in zip(rows["seq"], rows["event"]):
            if status in TERMINAL:
                break
            if s > seq:
                seq, status = int(s), STATUS.get(e, status)
        state.update((seq, status))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "seq": [seq]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, seq long", "seq long, status string", "update", "NoTimeout")


def to_summarize(nodes: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Nodes that have no summary for their present code."""
    return nodes if force else nodes.join(done.select("id", "code_hash").distinct(), ["id", "code_hash"], "left_anti")


def inherit(nodes: DataFrame, earlier: DataFrame) -> DataFrame:
    """Nodes of a new snapshot with the summaries of unchanged nodes of an earlier one."""
    old = earlier.select("id", "code_hash", F.col("technical_summary").alias("old_")).dropDuplicates(["id", "code_hash"])
    return nodes.join(old, ["id", "code_hash"], "left").withColumn("technical_summary", F.coalesce("technical_summary", "old_")).drop("old_")


# Extensions: windows over an event stream (event_id, ts, user_id, event_type, value), the same for batch and stream.


def _timed(events: DataFrame) -> DataFrame:
    """Streams need an instant as event time; batches keep the type they have."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    s = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
