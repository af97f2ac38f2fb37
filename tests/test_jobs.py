"""Job events: batch and stream give the same states."""

from pyspark.sql import functions as F

from codeloom.sources.fixtures import Graphs
from codeloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_terminal_events_end_a_job(spark):
    e = spark.createDataFrame([(1, i, x) for i, x in enumerate(["queued", "queued", "analysis_progress", "completed", "failed", "queued"])], "job_id long, seq long, event string")
    assert tuple(jobs.latest_status(e).first()) == (1, "completed", 3)
    assert [r["existing"] for r in jobs.enqueue(e).orderBy("seq").collect()] == [False, True, False]


def test_stream_equals_batch(spark, tmp_path):
    log = Graphs(spark, SF).jobs.select("job_id", F.col("seq").cast("long").alias("seq"), "event")
    log.repartition(3, "job_id").write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/log")
    q = jobs.stream_status(stream).writeStream.outputMode("update").format("memory").queryName("jobs_out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("jobs_out").groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, jobs.latest_status(log).collect()))


def test_windows_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(ev.schema).parquet(f"{SF}/events*.parquet")
    q = jobs.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumble").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tumble").agg(F.sum("n")).first()[0] == ev.count()
