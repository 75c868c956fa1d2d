"""Hits to samples: one score for each tracked vehicle and frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.config import DEFAULT

KEYS = ["clip_id", "frame_idx"]


def gate_score(confidence: Column, threshold: float) -> Column:
    """The confidence, or 0 if it is missing or below the threshold."""
    return F.when(confidence >= F.lit(threshold), confidence).otherwise(F.lit(0.0))


def hits_by_vehicle(nearest: DataFrame, hits: DataFrame) -> DataFrame:
    """The greatest confidence and the people of each vehicle with a hit, in the order they were detected."""
    return group_hits(nearest.join(hits.select(*KEYS, "person_track_id", "confidence"), [*KEYS, "person_track_id"]))


def group_hits(joined: DataFrame) -> DataFrame:
    """As ``hits_by_vehicle``, for hits that already carry their vehicle and their person's ordinal."""
    people = F.transform(F.array_sort(F.collect_list(F.struct("person_ord", "person_track_id"))), lambda x: x["person_track_id"])
    return joined.groupBy(*KEYS, "vehicle_track_id").agg(F.max("confidence").alias("confidence"), people.alias("person_ids"))


def samples(vehicles: DataFrame, grouped: DataFrame, threshold: float = DEFAULT.weapon_confidence_threshold) -> DataFrame:
    """A row for every tracked vehicle of every frame, with or without a hit."""
    v = vehicles.select(*KEYS, "ts_s", F.col("det_ord").alias("vehicle_ord"), F.col("track_id").alias("vehicle_track_id"))
    ids = F.concat(F.array("vehicle_track_id"), F.coalesce("person_ids", F.array().cast("array<bigint>")))
    return v.join(grouped, [*KEYS, "vehicle_track_id"], "left").select(
        *KEYS, "ts_s", "vehicle_ord", "vehicle_track_id", gate_score(F.col("confidence"), threshold).alias("score"), ids.alias("track_ids")
    )
