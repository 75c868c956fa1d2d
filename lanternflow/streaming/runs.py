"""Runs of hits on a stream, by session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.streaming.debounce import run_to, timed, work_dir

RUNS = "clip_id string, start_s double, end_s double"


def runs_stream(hits: DataFrame, threshold: float, max_gap_s: float, delay_s: float = 2.0) -> DataFrame:
    """Each run of above-threshold hits of a clip, once the watermark has passed it, in append mode.

    A session lasts for ``max_gap_s`` after its last hit, and a microsecond
    more, as a hit at exactly the gap still belongs to the run.
    """
    above = timed(hits.where(F.col("confidence") >= threshold).select("clip_id", "ts_s"), "ts_s", delay_s)
    session = F.session_window("event_time", f"{int(max_gap_s * 1_000_000) + 1} microseconds")
    return above.groupBy("clip_id", session).agg(F.min("ts_s").alias("start_s"), F.max("ts_s").alias("end_s")).select("clip_id", "start_s", "end_s")


def replay_longest(hits: DataFrame, threshold: float, max_gap_s: float) -> DataFrame:
    """The longest run of each clip with hits, from the runs that the stream appended."""
    spark, top = hits.sparkSession, work_dir(hits.sparkSession)
    columns = ["clip_id", "ts_s", "confidence"]
    hits.select(*columns).write.parquet(f"{top}/in")
    stored = spark.read.parquet(f"{top}/in")
    # One hit long after each clip moves the watermark past all others; its own run stays open.
    stored.groupBy("clip_id").agg((F.max("ts_s") + 3600.0).alias("ts_s"), F.lit(2.0 + abs(threshold)).alias("confidence")).select(*columns).write.mode("append").parquet(f"{top}/end")
    run_to(runs_stream(spark.readStream.schema(stored.schema).parquet(f"{top}/in"), threshold, max_gap_s), top)
    spark.read.parquet(f"{top}/end").write.mode("append").parquet(f"{top}/in")
    run_to(runs_stream(spark.readStream.schema(stored.schema).parquet(f"{top}/in"), threshold, max_gap_s), top)
    runs = spark.read.schema(RUNS).parquet(f"{top}/out").groupBy("clip_id").agg(F.max(F.col("end_s") - F.col("start_s")).alias("longest"))
    clips = spark.read.parquet(f"{top}/end").select("clip_id")
    return clips.join(runs, "clip_id", "left").select("clip_id", F.coalesce("longest", F.lit(0.0)).alias("longest_run_s"))
