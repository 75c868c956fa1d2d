"""Whole frames as rows: the people, vehicles and best boxes of a frame side by side.

A frame holds few objects, so who is near whom is settled inside one row, in
array functions.  Objects and boxes are grouped by (clip, frame) once; gate,
nearest vehicle, hits and samples then need neither a join nor a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.config import DEFAULT, RunConfig
from lanternflow.functions import geometry as G
from lanternflow.operators import detect, score

KEYS = detect.FRAME_KEYS
_BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
_MATCHES = f"array<struct<person_ord:bigint,person_track_id:bigint,vehicle_track_id:bigint,dist_norm:double,confidence:double,bbox:{_BOX}>>"


def _match(p: Column, boxes: Column, vehicles: Column, config: RunConfig) -> Column:
    """A person with the nearest vehicle within reach, the first of equally near ones, and their best boxes."""
    diag = G.diagonal(p["width"], p["height"])
    far = F.transform(vehicles, lambda v: F.struct(G.distance_norm(p["bbox"], v["bbox"], diag).alias("dist_norm"), v["det_ord"].alias("vehicle_ord"), v["track_id"].alias("vehicle_track_id")))
    near = F.array_min(F.filter(far, lambda x: x["dist_norm"] <= F.lit(config.weapon_proximity_norm)))
    window = G.crop_window(p["bbox"], config.weapon_pad_ratio, p["width"], p["height"])
    own = F.filter(boxes, lambda b: b["person_track_id"] == p["track_id"])
    return F.struct(p["det_ord"].alias("person_ord"), p["track_id"].alias("person_track_id"), near.alias("near"), window.alias("window"), own.alias("boxes"))


def scenes(objects: DataFrame, raw: DataFrame, config: RunConfig = DEFAULT) -> DataFrame:
    """A row for each frame with objects: ``vehicles``, and ``matches``, the hits of gated people with their vehicle."""
    one = F.struct("det_ord", "track_id", "ts_s", "bbox", "width", "height")
    sides = {c: F.collect_list(F.when(F.col("cls") == k, one)).alias(c) for c, k in (("persons", "person"), ("vehicles", "vehicle"))}
    frames = objects.groupBy(*KEYS).agg(*sides.values())
    # Boxes are dealt by frame at once: the best of each person and the frame's list need no other shuffle.
    best = detect.best_threat(detect.threats(raw, config.weapon_conf).repartition(*KEYS))
    boxes = best.groupBy(*KEYS).agg(F.collect_list(F.struct("person_track_id", "confidence", "crop_bbox")).alias("boxes"))
    both = frames.join(boxes, KEYS, "left")
    return settled(both, config)


def assembled(objects: DataFrame, boxes: DataFrame, config: RunConfig = DEFAULT) -> DataFrame:
    """Rows of both kinds side by side, for one grouping by frame; tracked objects and possible threats only."""
    one = F.struct("det_ord", "track_id", "cls", "ts_s", "bbox", "width", "height").alias("object")
    box = F.struct("person_track_id", "box_ord", "confidence", "crop_bbox").alias("box")
    tracked = objects.where(F.col("track_id").isNotNull()).select(*KEYS, "ts_s", one)
    return tracked.unionByName(detect.threats(boxes, config.weapon_conf).select(*KEYS, "ts_s", box), allowMissingColumns=True)


def gathered(frames: DataFrame, config: RunConfig = DEFAULT, *rest: str) -> DataFrame:
    """Scenes of frames that hold their ``objects`` and ``boxes`` as lists, in any order: the first of a track's objects and the best of a person's boxes count."""
    first = F.filter("objects", lambda o: ~F.exists("objects", lambda p: (p["track_id"] == o["track_id"]) & (p["det_ord"] < o["det_ord"])))
    better = lambda c, b: (c["confidence"] > b["confidence"]) | ((c["confidence"] == b["confidence"]) & (c["box_ord"] < b["box_ord"]))
    best = F.filter("boxes", lambda b: ~F.exists("boxes", lambda c: (c["person_track_id"] == b["person_track_id"]) & better(c, b)))
    alone = frames.select(*KEYS, *rest, first.alias("objects"), best.alias("boxes"))
    of = lambda kind: F.filter("objects", lambda o: o["cls"] == kind)
    return settled(alone.select(*KEYS, *rest, of("person").alias("persons"), of("vehicle").alias("vehicles"), "boxes"), config, *rest)


def settled(both: DataFrame, config: RunConfig, *rest: str) -> DataFrame:
    """Who is near whom and who has a hit, inside each frame."""
    # Frames without boxes have no hits, and people without boxes none either.
    armed = F.filter("persons", lambda p: F.exists("boxes", lambda b: b["person_track_id"] == p["track_id"]))
    people = F.transform(armed, lambda p: _match(p, F.col("boxes"), F.col("vehicles"), config))
    gated = F.filter(people, lambda m: m["near"].isNotNull() & G.nonempty(m["window"]))
    flat = F.flatten(F.transform(gated, lambda m: F.transform(m["boxes"], lambda b: _hit(m, b))))
    return both.select(*KEYS, *rest, "vehicles", F.coalesce(flat, F.array().cast(_MATCHES)).alias("matches"))


def _hit(m: Column, b: Column) -> Column:
    return F.struct(
        m["person_ord"].alias("person_ord"), m["person_track_id"].alias("person_track_id"), m["near"]["vehicle_track_id"].alias("vehicle_track_id"), m["near"]["dist_norm"].alias("dist_norm"),
        b["confidence"].alias("confidence"), G.to_frame(b["crop_bbox"], m["window"]).alias("bbox"),
    )


def matched(scenes: DataFrame) -> DataFrame:
    """A row for each hit, with its person and nearest vehicle."""
    return scenes.select(*KEYS, F.inline("matches"))


def samples(scenes: DataFrame, threshold: float = DEFAULT.weapon_confidence_threshold, *rest: str) -> DataFrame:
    """A row for every tracked vehicle of every frame, with or without a hit."""

    def sample(v: Column) -> Column:
        own = F.filter("matches", lambda m: m["vehicle_track_id"] == v["track_id"])
        ids = F.transform(F.array_sort(F.transform(own, lambda m: F.struct(m["person_ord"].alias("o"), m["person_track_id"].alias("i")))), lambda x: x["i"])
        conf = F.array_max(F.transform(own, lambda m: m["confidence"]))
        return F.struct(v["ts_s"].alias("ts_s"), v["det_ord"].alias("vehicle_ord"), v["track_id"].alias("vehicle_track_id"), score.gate_score(conf, threshold).alias("score"), F.concat(F.array(v["track_id"]), ids).alias("track_ids"))

    return scenes.select(*KEYS, *rest, F.inline(F.transform("vehicles", sample)))
