"""What would be drawn, as rows: boxes, labels, crops and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.functions import geometry as G
from lanternflow.functions.text import fixed

# Colours of the classes and of a weapon box, blue-green-red.
PERSON_BGR, VEHICLE_BGR, WEAPON_BGR = (0, 220, 0), (0, 140, 255), (0, 0, 255)


def _colour(bgr: tuple[int, int, int]) -> Column:
    return F.lit(",".join(map(str, bgr)))


def _corners(box: Column) -> list[Column]:
    return [box[c].cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]


def track_boxes(objs: DataFrame) -> DataFrame:
    """A box and label for each object."""
    colour = F.when(F.col("cls") == "person", _colour(PERSON_BGR)).otherwise(_colour(VEHICLE_BGR))
    label = F.format_string("%s#%d %s", "cls", "track_id", fixed("confidence", 2))
    return objs.select("clip_id", "frame_idx", F.lit("track").alias("kind"), "track_id", *_corners(F.col("bbox")), colour.alias("colour"), label.alias("label"))


def weapon_boxes(hits: DataFrame) -> DataFrame:
    label = F.concat(F.lit("weapon "), fixed("confidence", 2))
    return hits.select("clip_id", "frame_idx", F.lit("weapon").alias("kind"), F.col("person_track_id").alias("track_id"), *_corners(F.col("bbox")), _colour(WEAPON_BGR).alias("colour"), label.alias("label"))


def text_anchor(y1: Column) -> Column:
    return F.greatest(F.lit(0), y1 - 8)


def banner_lines(banners: DataFrame) -> DataFrame:
    """Each banner line and its height in the frame."""
    lines = banners.select("clip_id", "frame_idx", F.posexplode(F.split("banner", "\n")).alias("i", "line"))
    return lines.select("clip_id", "frame_idx", "line", (24 + 22 * F.col("i")).alias("y"))


def snapshot_manifest(chosen: DataFrame, pad_ratio: float = 1.0) -> DataFrame:
    """File name and crop window of each chosen hit; needs bbox, width and height."""
    name = F.format_string("frame%05d_t%ss_conf%s", "frame_idx", fixed("ts_s", 2), fixed("confidence", 2))
    return chosen.withColumn("name", name).withColumn("window", G.crop_window(F.col("bbox"), pad_ratio, F.col("width"), F.col("height")))


def hit_boxes(hits: DataFrame, persons: DataFrame) -> DataFrame:
    """Hits with the box of their person, the first of several; null where it is gone."""
    keys = ["clip_id", "frame_idx"]
    first = persons.groupBy(*keys, F.col("track_id").alias("person_track_id")).agg(F.min_by("bbox", "det_ord").alias("person_bbox"))
    return hits.join(first, [*keys, "person_track_id"], "left")


def hit_lines(hits: DataFrame, threshold: float) -> DataFrame:
    """A line for each hit, marked if it reaches the threshold; needs ts_s."""
    above = F.col("confidence") >= F.lit(threshold)
    text = F.format_string("frame %d t=%ss person#%d weapon %s%s", "frame_idx", fixed("ts_s", 2), "person_track_id", fixed("confidence", 3), F.when(above, " *").otherwise(""))
    return hits.select("clip_id", "frame_idx", "ts_s", "person_track_id", "confidence", above.alias("above"), text.alias("line"))


def drawable(boxes: DataFrame) -> DataFrame:
    """Boxes that a frame's picture shows: all but those named person."""
    return boxes.where(F.lower(F.coalesce("class_name", F.lit(""))) != "person")


def export_names(boxes: DataFrame, place: str) -> DataFrame:
    """File name of each exported label box: its place, aspect ratio and image."""
    return boxes.withColumn("name", F.format_string("%03d_ar%s_%s", F.col(place), fixed("aspect", 1), "image_stem"))
