"""The debounce on a stream of samples, with the rules of the batch one.

Samples may come late by the watermark's delay.  Each key keeps its samples in
a list state; when the watermark passes the earliest, a timer sorts and folds
those that are due, in order, and the rest waits.  Silence never closes a
streak, so a key's fold lives as long as the key unless a time to live is given,
which departs from that rule.  Rows later than the watermark are dropped by
Spark and counted (``late_rows``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lanternflow import schema
from lanternflow.config import BANNER_LOOKBACK_S, EVENT_TYPE, MIN_SAMPLES
from lanternflow.operators.debounce import Thresholds

#: Added to clip time for event time: the first watermark is 0 and would drop samples at 0.
EPOCH_S = 86_400
SAMPLE_FIELDS = ["frame_idx", "ts_s", "vehicle_ord", "score", "track_ids"]
IDLE = {"start": None, "start_frame": None, "last": None, "peak": 0.0, "n": 0, "emitted": False, "free": -1.0}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(state: dict[str, Any], rows: Iterable[list], t: Thresholds) -> list[tuple]:
    """Take samples (ts, frame, ord, score, ids) in order; returns events, changes ``state``."""
    out = []
    for ts, frame, _, score, ids in rows:
        if score < t.confidence:
            if state["start"] is not None and ts - state["last"] > t.max_gap_s:
                state.update(start=None, n=0, emitted=False)
            continue
        if state["start"] is None:
            state.update(start=ts, start_frame=frame, peak=score, n=0)
        state.update(last=ts, peak=max(state["peak"], score), n=state["n"] + 1)
        if not state["emitted"] and state["n"] >= MIN_SAMPLES and ts - state["start"] >= t.min_duration_s and ts >= state["free"]:
            state.update(emitted=True, free=ts + t.cooldown_s)
            out.append((state["start"], ts, state["start_frame"], frame, state["peak"], ids))
    return out


class Debouncer(StatefulProcessor):
    """One key's samples (list state), its fold (value state), and a timer at the earliest sample."""

    COLUMNS = ("clip_id", "event_type", "start_timestamp_s", "end_timestamp_s", "start_frame_idx", "end_frame_idx", "peak_score", "track_ids")

    def __init__(self, t: Thresholds, ttl_s: float | None) -> None:
        self.t, self.ttl_s = t, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_s double, frame_idx bigint, vehicle_ord bigint, score double, track_ids array<bigint>")
        self.folded = handle.getValueState("folded", "start double, start_frame bigint, last double, peak double, n bigint, emitted boolean, free double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in _samples(pdf)]
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new) + EPOCH_S)
        yield pd.DataFrame(columns=self.COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000 - EPOCH_S
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:3])
        due = [r for r in rows if r[0] <= now]
        events: list[tuple] = []
        if due:
            state = dict(zip(IDLE, self.folded.get(), strict=True)) if self.folded.exists() else dict(IDLE)
            events = fold(state, due, self.t)
            self.folded.update(tuple(state.values()))
            rest = rows[len(due) :]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        rest = rows[len(due) :]
        if rest:
            self._wake(rest[0][0] + EPOCH_S)
        elif not due and self.ttl_s is not None:
            self.folded.clear()
        elif self.ttl_s is not None:
            self._wake(now + EPOCH_S + self.ttl_s)
        yield pd.DataFrame([(key[0], EVENT_TYPE, *e[:5], list(e[5])) for e in events], columns=self.COLUMNS)

    def close(self) -> None:
        pass

    def _wake(self, at_s: float) -> None:
        self.handle.registerTimer(int(at_s * 1000))


def _samples(pdf: pd.DataFrame) -> list[tuple]:
    return [(float(a), int(b), int(c), float(d), [int(x) for x in e]) for a, b, c, d, e in zip(pdf.ts_s, pdf.frame_idx, pdf.vehicle_ord, pdf.score, pdf.track_ids, strict=True)]


def timed(rows: DataFrame, column: str, delay_s: float) -> DataFrame:
    """Rows with an event time from clip seconds, and its watermark."""
    at = F.timestamp_micros(((F.col(column) + EPOCH_S) * 1_000_000).cast("long"))
    return rows.withColumn("event_time", at).withWatermark("event_time", f"{int(delay_s * 1000)} milliseconds")


def debounce_stream(samples: DataFrame, t: Thresholds = Thresholds(), delay_s: float = 2.0, ttl_s: float | None = None) -> DataFrame:
    """Events of a streaming DataFrame of samples, in append mode.  The session's state store must be ``STORE``."""
    return timed(samples, "ts_s", delay_s).groupBy("clip_id", "vehicle_track_id").transformWithStateInPandas(Debouncer(t, ttl_s), schema.EVENTS, "append", "eventTime")


def banner_stream(frames: DataFrame, events: DataFrame, lookback_s: float = BANNER_LOOKBACK_S, delay_s: float = 2.0) -> DataFrame:
    """Each frame with every event that ended within the lookback before it, on two streams, in append mode.

    A time-interval join with watermarks on both sides: an event's state goes
    once frames have passed it by the lookback, a frame's once events have.
    Time is cut to slots of the lookback (of a second without one) and an event
    is sent to all that it can reach, so the join is an equality on (clip, slot):
    an event meets the frames of its slots, not all that the clip has in state.
    Rows are (clip_id, frame_idx, line); a frame without an event has none.
    """
    slot = lambda c: F.floor(c / F.lit(lookback_s if lookback_s > 0 else 1.0))
    f = timed(frames.select("clip_id", "frame_idx", "ts_s"), "ts_s", delay_s).withColumnRenamed("event_time", "frame_time").withColumn("slot", slot(F.col("ts_s"))).alias("f")
    # A frame has one slot, so one more for an event makes no row twice; the millisecond covers what rounding moves.
    end = F.col("end_timestamp_s")
    reach = F.explode(F.sequence(slot(end), slot(end + F.lit(max(lookback_s, 0.0) + 0.001))))
    e = timed(events.select("clip_id", "event_type", "end_timestamp_s"), "end_timestamp_s", delay_s).withColumn("slot", reach).alias("e")
    back = F.expr(f"INTERVAL {int(lookback_s * 1_000_000)} MICROSECONDS")
    near = (F.col("e.event_time") <= F.col("frame_time")) & (F.col("e.event_time") >= F.col("frame_time") - back)
    # Event times are whole microseconds; the seconds decide at the borders.
    exact = (F.col("end_timestamp_s") <= F.col("ts_s")) & (F.col("end_timestamp_s") >= F.col("ts_s") - F.lit(lookback_s))
    joined = f.join(e, (F.col("f.clip_id") == F.col("e.clip_id")) & (F.col("f.slot") == F.col("e.slot")) & near & exact)
    return joined.select("f.clip_id", "frame_idx", F.concat(F.lit("RISK: "), "event_type").alias("line"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped as later than the watermark, over the progress that Spark keeps."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def closing_rows(samples: DataFrame, after_s: float = 3600.0) -> DataFrame:
    """One silent sample for each key long after its clip, which moves the watermark past all others."""
    last = samples.groupBy("clip_id", "vehicle_track_id").agg(F.max("ts_s").alias("ts_s"), F.max("frame_idx").alias("frame_idx"))
    return last.select("clip_id", "frame_idx", (F.col("ts_s") + after_s).alias("ts_s"), F.lit(0).cast("long").alias("vehicle_ord"), "vehicle_track_id", F.lit(0.0).alias("score"), F.array("vehicle_track_id").alias("track_ids"))


def work_dir(spark: SparkSession) -> str:
    """A new folder for a stream's files; a temporary one only where all run in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="lanternflow-")
    return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_to(stream: DataFrame, top: str, name: str = "out") -> StreamingQuery:
    """Run a stream over what is there, from its checkpoint, appending to ``<top>/<name>``."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        options = {"checkpointLocation": f"{top}/state-{name}", "path": f"{top}/{name}"}
        query = stream.writeStream.format("parquet").options(**options).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        spark.conf.set(key, before)


def replay(samples: DataFrame, t: Thresholds = Thresholds(), delay_s: float = 2.0, stops: int = 0) -> DataFrame:
    """Play stored samples through the stream and read the events it appended.

    With ``stops`` the stream ends that often on the way and resumes from its
    checkpoint; the samples then come in as many files, in order of time.
    """
    spark = samples.sparkSession
    top = work_dir(spark)
    columns = ["clip_id", "frame_idx", "ts_s", "vehicle_ord", "vehicle_track_id", "score", "track_ids"]
    samples.select(*columns).write.parquet(f"{top}/all")
    stored = spark.read.parquet(f"{top}/all")
    cuts = stored.agg(F.percentile("ts_s", [k / (stops + 1) for k in range(stops + 2)]).alias("q")).first()["q"] if stops else None
    for k in range(stops + 1):
        part = stored.where((F.col("ts_s") >= cuts[k]) & (F.col("ts_s") < cuts[k + 1])) if cuts and k < stops else stored.where(F.col("ts_s") >= cuts[k]) if cuts else stored
        (part.unionByName(closing_rows(stored)) if k == stops else part).write.mode("append").parquet(f"{top}/in")
        run_to(debounce_stream(spark.readStream.schema(stored.schema).parquet(f"{top}/in"), t, delay_s), top)
    return spark.read.schema(schema.EVENTS).parquet(f"{top}/out")


def replay_banner(frames: DataFrame, events: DataFrame, lookback_s: float = BANNER_LOOKBACK_S) -> DataFrame:
    """Play stored frames and events through the banner stream; one line for each frame and type."""
    spark = frames.sparkSession
    top = work_dir(spark)
    frames.select("clip_id", "frame_idx", "ts_s").write.parquet(f"{top}/frames")
    events.select("clip_id", "event_type", "end_timestamp_s").write.parquet(f"{top}/events")
    f, e = (spark.readStream.schema(spark.read.parquet(f"{top}/{n}").schema).parquet(f"{top}/{n}") for n in ("frames", "events"))
    run_to(banner_stream(f, e, lookback_s), top)
    return spark.read.schema("clip_id string, frame_idx long, line string").parquet(f"{top}/out").distinct()
