"""From raw detections to events on a stream: frames assembled in state, then the debounce, in one query.

Detections and model boxes arrive in any order within the watermark's delay.
Rows of one frame are gathered in a streaming aggregation until the watermark
has passed the frame; then the frame leaves whole, and gate, nearest vehicle,
hits and samples are settled inside its row (``operators.scene``).  A second
stateful operator follows in the same query: as frames leave in the order of
the watermark, all samples of a key up to it come together, are put in order
and folded at once.  Its state is one small record for each key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow import schema
from lanternflow.config import DEFAULT, EVENT_TYPE, RunConfig
from lanternflow.operators import scene
from lanternflow.operators.debounce import Thresholds
from lanternflow.streaming.debounce import IDLE, Debouncer, _samples, fold, run_to, timed, work_dir

KEYS = scene.KEYS


class InOrder(Debouncer):
    """The debounce of samples that come in the order of the watermark: nothing waits, and no timer is needed."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = sorted((r for pdf in rows for r in _samples(pdf)), key=lambda r: r[:3])
        state = dict(zip(IDLE, self.folded.get(), strict=True)) if self.folded.exists() else dict(IDLE)
        events = fold(state, new, self.t)
        self.folded.update(tuple(state.values()))
        yield pd.DataFrame([(key[0], EVENT_TYPE, *e[:5], list(e[5])) for e in events], columns=self.COLUMNS)


def samples_stream(objects: DataFrame, boxes: DataFrame, config: RunConfig = DEFAULT, delay_s: float = 2.0) -> DataFrame:
    """A sample for each tracked vehicle of each frame, once the watermark has passed the frame.

    ``objects`` are detections with ``cls`` and ``boxes`` model boxes, both with
    the time of their frame in ``ts_s``: rows of one frame have one time.
    """
    rows = timed(scene.assembled(objects, boxes, config), "ts_s", delay_s)
    frames = rows.groupBy(*KEYS, "event_time").agg(F.collect_list("object").alias("objects"), F.collect_list("box").alias("boxes"))
    return scene.samples(scene.gathered(frames, config, "event_time"), config.weapon_confidence_threshold, "event_time")


def events_stream(objects: DataFrame, boxes: DataFrame, config: RunConfig = DEFAULT, delay_s: float = 2.0) -> DataFrame:
    """Events of streams of detections and boxes, in append mode.  The session's state store must be ``debounce.STORE``."""
    samples = samples_stream(objects, boxes, config, delay_s)
    return samples.groupBy("clip_id", "vehicle_track_id").transformWithStateInPandas(InOrder(Thresholds.of(config), None), schema.EVENTS, "append", "eventTime")


def closing_objects(objects: DataFrame, after_s: float = 3600.0) -> DataFrame:
    """One vehicle of no other frame for each clip, long after it: the watermark then passes all others.  Its own frame never leaves."""
    last = objects.groupBy("clip_id").agg(*[F.max(c).alias(c) for c in ("frame_idx", "ts_s", "det_ord", "track_id", "cls", "bbox", "width", "height")])
    return last.withColumns({"frame_idx": F.col("frame_idx") + 1, "ts_s": F.col("ts_s") + after_s, "cls": F.lit("vehicle")})


def replay(objects: DataFrame, boxes: DataFrame, config: RunConfig = DEFAULT, delay_s: float = 2.0, stops: int = 0) -> DataFrame:
    """Play stored detections and boxes through the stream and read the events it appended.

    With ``stops`` the stream ends that often on the way and resumes from its
    checkpoint.  Each row then arrives at a time of its own, up to nine tenths
    of the delay after its frame's, by a hash of the row: a frame's rows come
    apart, boxes before objects, and late frames after early ones.
    """
    spark = objects.sparkSession
    top = work_dir(spark)
    kinds = {
        "objects": objects.select(*KEYS, "ts_s", "det_ord", "track_id", "cls", "bbox", "width", "height"),
        "boxes": boxes.select(*KEYS, "ts_s", "person_track_id", "box_ord", "class_name", "confidence", "crop_bbox"),
    }
    schemas = {}
    for name, rows in kinds.items():
        late = F.pmod(F.xxhash64(*[c for c in rows.columns if "bbox" not in c]), F.lit(1000)) / F.lit(1000.0)
        rows.withColumn("arrives", F.col("ts_s") + late * F.lit(0.9 * delay_s)).write.parquet(f"{top}/all-{name}")
        schemas[name] = rows.schema
    stored = {name: spark.read.parquet(f"{top}/all-{name}") for name in kinds}
    cuts = [None] * (stops + 2)
    if stops:
        cuts[1:-1] = stored["objects"].agg(F.percentile("arrives", [k / (stops + 1) for k in range(1, stops + 1)])).first()[0] or cuts[1:-1]
    for k in range(stops + 1):
        for name, rows in stored.items():
            part = rows if cuts[k] is None else rows.where(F.col("arrives") >= cuts[k])
            part = part if cuts[k + 1] is None else part.where(F.col("arrives") < cuts[k + 1])
            part.drop("arrives").write.mode("append").parquet(f"{top}/in-{name}")
        if k == stops:
            closing_objects(kinds["objects"]).select(*schemas["objects"].names).write.mode("append").parquet(f"{top}/in-objects")
        o, b = (spark.readStream.schema(schemas[n]).parquet(f"{top}/in-{n}") for n in kinds)
        run_to(events_stream(o, b, config, delay_s), top)
    return spark.read.schema(schema.EVENTS).parquet(f"{top}/out")
