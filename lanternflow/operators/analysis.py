"""Reports over hits, samples and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.config import BANNER_LOOKBACK_S
from lanternflow.operators import spaced


def hit_summary(hits: DataFrame, frames: DataFrame, threshold: float) -> DataFrame:
    """Frames (with or without hits), hits, hits above the threshold, greatest confidence (null without hits)."""
    both = frames.select(F.lit(1).alias("frame"), F.lit(None).cast("double").alias("confidence")).unionByName(hits.select(F.lit(0).alias("frame"), F.col("confidence").cast("double")))
    return both.agg(
        F.count_if(F.col("frame") == 1).alias("n_frames"), F.count_if(F.col("frame") == 0).alias("n_hits"), F.count_if(F.col("confidence") >= threshold).alias("n_above"), F.max("confidence").alias("max_confidence"),
    )


#: Seconds of a slot, and slots (or blocks of them) that are combined at once.
RUN_SLOT_S, RUN_FAN = 60.0, 4096


def _joined_run(max_gap_s: float):
    """Combine the runs of two stretches of time: first and last hit, end of the first run, start of the last, greatest length."""

    def step(a: Column, x: Column) -> Column:
        joined = x["first"] - a["last"] <= F.lit(max_gap_s)
        return F.struct(
            a["first"].alias("first"), F.when(joined & (a["tail"] == a["first"]), x["head"]).otherwise(a["head"]).alias("head"),
            F.when(joined & (x["tail"] == x["first"]), a["tail"]).otherwise(x["tail"]).alias("tail"), x["last"].alias("last"),
            F.greatest(a["best"], x["best"], F.when(joined, x["head"] - a["tail"]).otherwise(F.lit(0.0))).alias("best"),
        )

    return lambda xs: F.when(F.size(xs) > 0, F.reduce(F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1))), F.try_element_at(xs, F.lit(1)), step))


def longest_run(hits: DataFrame, threshold: float, max_gap_s: float) -> DataFrame:
    """The longest run of above-threshold hits of all people of each clip; a gap beyond ``max_gap_s`` ends a run.

    Slots of a clip's time give their runs, and runs of neighbouring slots
    combine; a task holds the hits of a slot or the runs of ``RUN_FAN`` slots.
    """
    combine = _joined_run(max_gap_s)
    at = F.when(F.col("confidence") >= threshold, F.col("ts_s"))
    slots = hits.select("clip_id", F.floor(F.col("ts_s") / F.lit(RUN_SLOT_S)).alias("slot"), at.alias("at")).groupBy("clip_id", "slot").agg(F.array_sort(F.collect_set("at")).alias("xs"))
    one = lambda t: F.struct(*[t.alias(c) for c in ("first", "head", "tail", "last")], F.lit(0.0).alias("best"))
    runs = slots.select("clip_id", "slot", combine(F.transform("xs", one)).alias("run"))
    for keys in (["clip_id", "slot"], ["clip_id", "slot"], ["clip_id"]):
        pair = F.when(F.col("run").isNotNull(), F.struct(F.col("slot").alias("s"), "run"))
        wide = runs.select("clip_id", F.floor(F.col("slot") / RUN_FAN).alias("slot"), pair.alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"))
        runs = wide.select(*keys, combine(F.transform("xs", lambda x: x["run"])).alias("run"))
    return runs.select("clip_id", F.coalesce("run.best", F.lit(0.0)).alias("longest_run_s"))


def spaced_top(hits: DataFrame, k: int, min_gap_s: float, min_conf: float, group: str = "clip_id") -> DataFrame:
    """The most confident hits of each clip that are ``min_gap_s`` apart from all chosen before.

    k below 1 still chooses one.  Blocks of time are settled apart
    (``operators.spaced``); no task holds a clip.
    """
    found = hits.where(F.col("confidence") >= min_conf).select(group, (-F.col("confidence")).alias("neg"), "ts_s", F.col("ord").cast("long").alias("ord"), "frame_idx", "person_track_id")
    if min_gap_s > 0:
        found = spaced.spaced(found, group, min_gap_s)
    out = spaced.first_of_each(found, group, max(k, 1))
    return out.select(group, "frame_idx", "ts_s", "person_track_id", (-F.col("neg")).alias("confidence"))


def active_banner(frames: DataFrame, events: DataFrame, lookback_s: float = BANNER_LOOKBACK_S) -> DataFrame:
    """Types of the events that ended within the lookback of each frame, at its time or before, in order.

    Time is cut to slots of the lookback (of a second without one) and an event
    is sent to its own and the next slot, so the join is an equality on
    (clip, slot).
    """
    slot = lambda c: F.floor(c / F.lit(lookback_s if lookback_s > 0 else 1.0))
    e = events.select("clip_id", "event_type", "end_timestamp_s", F.explode(F.array(slot(F.col("end_timestamp_s")), slot(F.col("end_timestamp_s")) + 1)).alias("slot"))
    f = frames.select("clip_id", "frame_idx", "ts_s", slot(F.col("ts_s")).alias("slot"))
    hit = f.join(e, ["clip_id", "slot"]).where((F.col("end_timestamp_s") <= F.col("ts_s")) & (F.col("end_timestamp_s") >= F.col("ts_s") - F.lit(lookback_s)))
    types = hit.groupBy("clip_id", "frame_idx").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    lines = F.transform("types", lambda t: F.concat(F.lit("RISK: "), t))
    return types.select("clip_id", "frame_idx", F.array_join(lines, "\n").alias("banner"))


SIGNALS = ("dwell_time_s", "close_dwell_time_s", "struggle_score", "sprint_score", "weapon_score")


def signal_extremes(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """Extremes of given person-vehicle records, and how many frames have persons, vehicles, pairs.

    Zero-seeded maxima never fall below 0; distance and approach speed are null without records.
    """
    top = [F.greatest(F.lit(0.0), F.coalesce(F.max(c), F.lit(0.0))).alias(f"max_{c}") for c in SIGNALS]
    seen = ["has_person", "has_vehicle"]
    none = lambda cols: [F.lit(None).cast(t).alias(c) for c, t in cols]
    values = ["person_vehicle_distance_norm", "approach_speed_px_s", *SIGNALS]
    p = pairs.select("clip_id", "frame_idx", *[F.col(c).cast("double").alias(c) for c in values], *none((c, "boolean") for c in seen))
    f = frames.select(*none((("clip_id", "string"), ("frame_idx", "long"))), *none((c, "double") for c in values), *seen)
    return p.unionByName(f).agg(F.min("person_vehicle_distance_norm").alias("min_distance_norm"), F.max("approach_speed_px_s").alias("max_approach_speed_px_s"), *top, F.count_distinct("clip_id", "frame_idx").alias("frames_with_pair"),
        F.count("has_person").alias("frames_total"), F.count_if("has_person").alias("person_frames"), F.count_if("has_vehicle").alias("vehicle_frames"))


def progress(frames: DataFrame, every: int = 100) -> DataFrame:
    return frames.where(F.col("frame_idx") % every == 0)


def metrics_long(per_class: DataFrame) -> DataFrame:
    """Per-class metrics (class_name and metric columns) as (class_name, metric, value), with ``all`` the plain mean."""
    names = [c for c in per_class.columns if c != "class_name"]
    flat = per_class.unpivot("class_name", names, "metric", "value")
    mean = flat.groupBy("metric").agg(F.avg("value").alias("value")).select(F.lit("all").alias("class_name"), "metric", "value")
    return flat.union(mean)


def metrics_map(per_class: DataFrame) -> DataFrame:
    """One row: a map from class to its metrics, and the means."""
    names = [c for c in per_class.columns if c != "class_name"]
    means = [F.avg(c).alias(c) for c in names]
    return per_class.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", F.struct(*names).alias("metrics"))))).alias("per_class"), *means)


def attach_hits(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """Person-vehicle records with their person's hit confidence; null without a hit."""
    keys = ["clip_id", "frame_idx", "person_track_id"]
    return pairs.join(hits.select(*keys, F.col("confidence").alias("weapon_confidence")), keys, "left")


def presence(frames: DataFrame, objs: DataFrame) -> DataFrame:
    """For each frame, whether it has a person, a vehicle, and both."""
    seen = objs.groupBy("clip_id", "frame_idx").agg(F.bool_or(F.col("cls") == "person").alias("has_person"), F.bool_or(F.col("cls") == "vehicle").alias("has_vehicle"))
    out = frames.join(seen, ["clip_id", "frame_idx"], "left").fillna(False, ["has_person", "has_vehicle"])
    return out.withColumn("has_pair", F.col("has_person") & F.col("has_vehicle"))
