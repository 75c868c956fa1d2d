"""Who is near which vehicle.  Everything joins on (clip, frame), so the work spreads over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.config import DEFAULT
from lanternflow.functions import geometry as G

KEYS = ["clip_id", "frame_idx"]


def _vehicles(vehicles: DataFrame) -> DataFrame:
    return vehicles.select(*KEYS, F.col("track_id").alias("vehicle_track_id"), F.col("det_ord").alias("vehicle_ord"), F.col("bbox").alias("vehicle_bbox"))


def _near(proximity: float) -> Column:
    return G.distance_norm(F.col("bbox"), F.col("vehicle_bbox"), G.diagonal(F.col("width"), F.col("height"))) <= F.lit(proximity)


def gated(persons: DataFrame, vehicles: DataFrame, proximity: float = DEFAULT.weapon_proximity_norm) -> DataFrame:
    """Persons with any vehicle within reach.  Needs width and height on persons."""
    return _semi(persons, vehicles, proximity, "left_semi")


def not_gated(persons: DataFrame, vehicles: DataFrame, proximity: float = DEFAULT.weapon_proximity_norm) -> DataFrame:
    return _semi(persons, vehicles, proximity, "left_anti")


def _semi(persons: DataFrame, vehicles: DataFrame, proximity: float, how: str) -> DataFrame:
    p, v = persons.alias("p"), _vehicles(vehicles).alias("v")
    on = (F.col("p.clip_id") == F.col("v.clip_id")) & (F.col("p.frame_idx") == F.col("v.frame_idx")) & _near(proximity)
    return p.join(v, on, how)


def nearest_gated(persons: DataFrame, vehicles: DataFrame, proximity: float = DEFAULT.weapon_proximity_norm, carry: tuple[str, ...] = ()) -> DataFrame:
    """The nearest vehicle within reach of each person; of equally near ones the first.

    The aggregate reuses the join's partitioning and combines before it.  A
    person is gated if and only if it is here, so ``carry`` (columns of
    persons) lets a plan take gate and nearest vehicle from one join.
    """
    pairs = persons.join(_vehicles(vehicles), KEYS).withColumn("dist_norm", G.distance_norm(F.col("bbox"), F.col("vehicle_bbox"), G.diagonal(F.col("width"), F.col("height"))))
    near = pairs.where(F.col("dist_norm") <= proximity)
    best = near.groupBy(*KEYS, F.col("track_id").alias("person_track_id"), F.col("det_ord").alias("person_ord")).agg(F.min(F.struct("dist_norm", "vehicle_ord", "vehicle_track_id", *carry)).alias("best"))
    return best.select(*KEYS, "person_track_id", "person_ord", "best.vehicle_track_id", "best.dist_norm", *[f"best.{c}" for c in carry])


def nearest_any(persons: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Distance to the nearest vehicle, however far; null where the frame has none."""
    pairs = persons.join(_vehicles(vehicles), KEYS, "left")
    d = G.distance_norm(F.col("bbox"), F.col("vehicle_bbox"), G.diagonal(F.col("width"), F.col("height")))
    return pairs.groupBy(*KEYS, F.col("track_id").alias("person_track_id")).agg(F.min(d).alias("dist_norm"))
