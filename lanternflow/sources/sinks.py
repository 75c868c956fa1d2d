"""Writers: event log as a JSON array and CSV, run metadata, merged labels."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.config import RunConfig
from lanternflow.functions.text import fixed
from lanternflow.operators.ranked import ranked

# The header of the event log.
EVENT_COLUMNS = ["event_type", "start_timestamp_s", "end_timestamp_s", "start_frame_idx", "end_frame_idx", "peak_score", "track_ids"]


def _log_order() -> list[Column]:
    return [F.col("start_timestamp_s"), F.col("end_timestamp_s"), F.col("track_ids")[0]]


def ordered(events: DataFrame) -> DataFrame:
    return events.orderBy(*_log_order())


def numbered(events: DataFrame) -> DataFrame:
    """Events with their place in the log of their clip, by ranges of (clip, time)."""
    keys = dict(zip(("_start", "_end", "_first"), _log_order(), strict=True))
    return ranked(events.withColumns(keys), ["clip_id"], [F.col(c) for c in keys]).drop(*keys)


def events_json(events: DataFrame) -> str:
    """The event log of a run as one JSON array, indented by 2; ``[]`` without events.

    For the log of one run, which is small by design; use ``write_events`` for a lake.
    """
    rows = [dict(zip(EVENT_COLUMNS, r, strict=True)) for r in ordered(events.select(*EVENT_COLUMNS)).toLocalIterator()]
    return json.dumps(rows, indent=2)


def events_csv(events: DataFrame) -> DataFrame:
    """Events as text columns for CSV; track ids joined by commas."""
    return ordered(events.select(*EVENT_COLUMNS)).withColumn("track_ids", F.array_join(F.transform("track_ids", lambda x: x.cast("string")), ","))


def write_csv(events: DataFrame, path: str) -> None:
    """CSV with header, CRLF, quotes where needed."""
    events_csv(events).coalesce(1).write.option("header", True).option("lineSep", "\r\n").mode("overwrite").csv(path)


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").partitionBy("clip_id").json(path)


def run_meta(config: RunConfig, model_digest: str | None, n_events: int) -> str:
    """A run's settings, the model's digest and the number of events, as JSON."""
    return json.dumps(asdict(config) | {"weapon_model_hash": model_digest, "num_events": n_events}, indent=2)


def event_log_lines(events: DataFrame) -> DataFrame:
    """A line for each event, by start time; ``none`` without events."""
    line = F.format_string("%s at %ss-%ss, peak %s", "event_type", fixed("start_timestamp_s", 2), fixed("end_timestamp_s", 2), fixed("peak_score", 2))
    keys = [c.alias(f"k{i}") for i, c in enumerate(_log_order())]
    lines = events.select(line.alias("line"), *keys)
    none = events.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("none").alias("line"), *[F.lit(None).cast(t).alias(f"k{i}") for i, t in enumerate(("double", "double", "long"))])
    return lines.unionByName(none).orderBy("k0", "k1", "k2").select("line")


def label_texts(lines: DataFrame, images: DataFrame) -> DataFrame:
    """One row for each image with its label text; images without a kept line have an empty one."""
    text = lines.groupBy("split", "image_stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("label"))
    more = [F.min(c).alias(c) for c in ("path", "ext") if c in images.columns]
    found = images.groupBy("split", "image_stem").agg(*more) if more else images.select("split", "image_stem").distinct()
    return found.join(text, ["split", "image_stem"], "left").withColumn("label", F.coalesce("label", F.lit("")))


def merged_manifest(root: str, names: Sequence[str], splits: Sequence[str]) -> str:
    """The manifest of a merged data set as YAML: where the images of each split lie, and the classes; ``test`` only if there is one."""
    import yaml

    have = {"path": root, "train": "train/images", "val": "valid/images"} | ({"test": "test/images"} if "test" in splits else {})
    return yaml.safe_dump(have | {"nc": len(names), "names": list(names)}, sort_keys=False)


def write_labels(lines: DataFrame, images: DataFrame, path: str, names: Sequence[str] = ()) -> str:
    """Merged labels by split: image references and label texts as a table, and a text file for each image.

    ``<path>/table/split=...`` holds a row for each image (with its ``path``,
    if known, instead of a copy of its bytes); ``<path>/labels/split=.../image_stem=...``
    holds its lines.  Returns the manifest, for the caller to store.
    """
    rows = label_texts(lines, images)
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{path}/table")
    kept = spark_read(rows, f"{path}/table")
    kept.select("split", "image_stem", F.col("label").alias("value")).repartition("split", "image_stem").write.mode("overwrite").partitionBy("split", "image_stem").text(f"{path}/labels")
    splits = [r["split"] for r in kept.select("split").distinct().collect()]
    return merged_manifest(path, names, splits)


def spark_read(like: DataFrame, path: str) -> DataFrame:
    return like.sparkSession.read.schema(like.schema).parquet(path)


def summary_json(extremes: DataFrame) -> str:
    """The one row of a clip's diagnosis as JSON, indented by 2."""
    return json.dumps(extremes.head(1)[0].asDict(), indent=2)
