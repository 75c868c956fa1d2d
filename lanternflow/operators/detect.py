"""Detector rows to objects, and raw model boxes to hits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow import schema
from lanternflow.config import DEFAULT, DETECTOR_CLASSES, NON_THREAT_NAMES
from lanternflow.functions import geometry as G

FRAME_KEYS = ["clip_id", "frame_idx"]


def stride(frames: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th frame by index; steps below 1 count as 1."""
    return frames.where(F.col("frame_idx") % F.lit(max(1, step)) == 0)


def timestamps(frames: DataFrame) -> DataFrame:
    """Seconds from the index and the clip's rate; a rate of 0 or null is 30."""
    fps = F.coalesce(F.when(F.col("fps") > 0, F.col("fps")), F.lit(30.0))
    return frames.withColumn("ts_s", F.col("frame_idx") / fps)


def class_of(class_id: Column) -> Column:
    return F.when(class_id == 0, "person").otherwise("vehicle")


def objects(rows: DataFrame, conf: float = DEFAULT.conf, classes: Sequence[int] = DETECTOR_CLASSES) -> DataFrame:
    """Detector rows (class_id, confidence, track_id, ...) of the classes asked for, tracked and confident enough."""
    kept = rows.where(F.col("class_id").isin(*classes) & (F.col("confidence") >= conf) & F.col("track_id").isNotNull())
    return kept.withColumn("cls", class_of(F.col("class_id"))).drop("class_id")


def split_classes(objs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return objs.where("cls = 'person'"), objs.where("cls = 'vehicle'")


def crop_windows(persons: DataFrame, pad_ratio: float = DEFAULT.weapon_pad_ratio) -> DataFrame:
    """Each person's padded crop; empty crops are dropped.  Needs width and height."""
    return persons.withColumn("window", G.crop_window(F.col("bbox"), pad_ratio, F.col("width"), F.col("height"))).where(G.nonempty(F.col("window")))


def threats(raw: DataFrame, conf: float = DEFAULT.weapon_conf, non_threat: Iterable[str] | None = None) -> DataFrame:
    """Boxes confident enough whose name is not on the list; a nameless box is a threat, an empty list is the default one."""
    names = sorted({n.lower() for n in (non_threat or ())}) or list(NON_THREAT_NAMES)
    return raw.where((F.col("confidence") >= conf) & ~F.lower(F.coalesce("class_name", F.lit(""))).isin(names))


def best_threat(boxes: DataFrame) -> DataFrame:
    """The most confident box of each person and frame, the first of equal ones."""
    rest = [F.col(c) for c in boxes.columns if c not in (*FRAME_KEYS, "person_track_id", "confidence", "box_ord")]
    best = F.max(F.struct(F.col("confidence"), (-F.col("box_ord")).alias("neg"), F.struct("box_ord", *rest).alias("rest"))).alias("best")
    found = boxes.groupBy(*FRAME_KEYS, "person_track_id").agg(best)
    return found.select(*FRAME_KEYS, "person_track_id", F.col("best.confidence").alias("confidence"), "best.rest.*")


def named(boxes: DataFrame, classes: DataFrame, default: Column) -> DataFrame:
    """Names for class ids (class_idx, class_name); ids without one get ``default``."""
    return boxes.join(classes, boxes["class_id"] == classes["class_idx"], "left").drop("class_idx").withColumn("class_name", F.coalesce("class_name", default))


def ranked(boxes: DataFrame) -> DataFrame:
    """All boxes by confidence, downwards, with their rank in the frame's crop."""
    from pyspark.sql import Window

    w = Window.partitionBy(*FRAME_KEYS, "person_track_id").orderBy(F.desc("confidence"), "box_ord")
    return boxes.withColumn("rank", F.row_number().over(w))


def infer(crops: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Run a user's model over gated crops, in Arrow batches.

    ``make_model`` is called once for each partition and returns a function
    from a frame of crops to rows of raw boxes.  Gate before: rows that do not
    reach this never cost a model call.
    """

    def run(batches):
        model = make_model()
        for pdf in batches:
            if len(pdf):
                yield model(pdf)

    return crops.mapInPandas(run, schema.WEAPON_RAW)


def in_crops(best: DataFrame, crops: DataFrame) -> DataFrame:
    """Best threats with their crop's columns and the box in frame coordinates; crops need person_track_id and window."""
    return best.join(crops, [*FRAME_KEYS, "person_track_id"]).withColumn("bbox", G.to_frame(F.col("crop_bbox"), F.col("window")))


def hits(raw: DataFrame, crops: DataFrame, conf: float = DEFAULT.weapon_conf, non_threat: Iterable[str] | None = None) -> DataFrame:
    """Best threat of each gated person, in frame coordinates."""
    where = crops.select(*FRAME_KEYS, F.col("track_id").alias("person_track_id"), "window")
    return in_crops(best_threat(threats(raw, conf, non_threat)), where).select(*FRAME_KEYS, "person_track_id", "confidence", "bbox")
