"""The debounce of samples to events, in batch.

A streak is closed only by a sample below the threshold more than ``max_gap_s``
after the last one above; silence never closes it.  A streak gives at most one
event, from its second above-sample on, once it has lasted ``min_duration_s``
and the key's cooldown (counted from its last event) is over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternflow.config import DEFAULT, EVENT_TYPE, MIN_SAMPLES, RunConfig


@dataclass(frozen=True)
class Thresholds:
    confidence: float = DEFAULT.weapon_confidence_threshold
    min_duration_s: float = DEFAULT.weapon_min_duration_s
    cooldown_s: float = DEFAULT.event_cooldown_s
    max_gap_s: float = DEFAULT.weapon_max_gap_s

    @staticmethod
    def of(config: RunConfig) -> Thresholds:
        return Thresholds(config.weapon_confidence_threshold, config.weapon_min_duration_s, config.event_cooldown_s, config.weapon_max_gap_s)


KEY = ["clip_id", "vehicle_track_id"]
ORDER = ["ts_s", "frame_idx", "vehicle_ord"]


def streaks(samples: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Above-samples with the number of their streak, its start, the peak so far and their place in it."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.col("score") < F.lit(t.confidence)
    above = samples.withColumn("last_below", F.max(F.when(below, F.col("ts_s"))).over(before)).where(~below)
    previous = F.lag("ts_s").over(w)
    breaks = previous.isNull() | F.coalesce(F.col("last_below") - previous > F.lit(t.max_gap_s), F.lit(False))
    numbered = above.withColumn("breaks", breaks.cast("int")).withColumn("streak", F.sum("breaks").over(so_far))
    inside = Window.partitionBy(*KEY, "streak").orderBy(*ORDER)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.select(
        *KEY, "frame_idx", "ts_s", "vehicle_ord", "score", "track_ids", "streak", F.row_number().over(inside).alias("n"),
        F.first("ts_s").over(running).alias("start_ts_s"), F.first("frame_idx").over(running).alias("start_frame_idx"), F.max("score").over(running).alias("peak"),
    )


def candidates(found: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Above-samples that may emit, were it not for the cooldown."""
    return found.where((F.col("n") >= MIN_SAMPLES) & (F.col("ts_s") - F.col("start_ts_s") >= F.lit(t.min_duration_s)))


def _chain(cooldown: float) -> Column:
    """The candidates that emit: one a streak, each at least the cooldown after the last.

    Only the last emitted one decides, so the list is folded once; candidates
    of a streak that has emitted are passed over.
    """
    row = "struct<ts_s:double,frame_idx:bigint,vehicle_ord:bigint,streak:bigint,start_ts_s:double,start_frame_idx:bigint,peak:double,track_ids:array<bigint>>"

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        emits = (F.size(acc) == 0) | ((x["streak"] > last["streak"]) & (x["ts_s"] >= last["ts_s"] + F.lit(cooldown)))
        return F.when(emits, F.concat(acc, F.array(x))).otherwise(acc)

    return F.aggregate("xs", F.array().cast(f"array<{row}>"), step)


def first_candidates(found: DataFrame, t: Thresholds) -> DataFrame:
    """Candidates without those that can never emit, in pieces of a key that do not depend on each other.

    Events before a streak end no later than the key's last candidate before
    it.  If the streak's first candidate comes a cooldown after that one, it
    emits whatever came before: the rest of the streak cannot, and a new piece
    of the key begins.
    """
    w = Window.partitionBy(*KEY, "streak").orderBy(*ORDER)
    own = Window.partitionBy(*KEY).orderBy(*ORDER)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = found.withColumn("prev", F.lag("ts_s").over(own)).withColumn("k", F.row_number().over(w))
    marked = marked.withColumn("first_ts", F.first("ts_s").over(so_far)).withColumn("before", F.first("prev").over(so_far))
    lone = F.coalesce(F.col("first_ts") >= F.col("before") + F.lit(t.cooldown_s), F.lit(True))
    begins = ((F.col("k") == 1) & lone).cast("int")
    marked = marked.withColumn("piece", F.sum(begins).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.where((F.col("k") == 1) | ~lone).drop("prev", "k", "first_ts", "before")


def debounce(samples: DataFrame, t: Thresholds = Thresholds(), event_type: str = EVENT_TYPE) -> DataFrame:
    """Events of each clip and vehicle.

    Windows find the streaks; only candidates reach the fold, and a key is cut
    wherever the cooldown is over, so the fold holds the candidates between two
    such gaps, not those of a key.
    ``max_gap_s`` must not be negative.
    """
    if t.max_gap_s < 0:
        raise ValueError("max_gap_s must not be negative")
    cand = first_candidates(candidates(streaks(samples, t), t), t)
    fields = ["ts_s", "frame_idx", F.col("vehicle_ord").cast("bigint").alias("vehicle_ord"), F.col("streak").cast("bigint").alias("streak"), "start_ts_s", "start_frame_idx", "peak", "track_ids"]
    xs = cand.groupBy(*KEY, "piece").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("xs"))
    out = xs.select(*KEY, F.inline(_chain(t.cooldown_s)))
    return out.select(
        "clip_id", F.lit(event_type).alias("event_type"), F.col("start_ts_s").alias("start_timestamp_s"), F.col("ts_s").alias("end_timestamp_s"),
        "start_frame_idx", F.col("frame_idx").alias("end_frame_idx"), F.col("peak").alias("peak_score"), "track_ids",
    )
