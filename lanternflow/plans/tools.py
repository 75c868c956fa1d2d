"""The command-line tools as functions: tables in, DataFrames out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.config import DEFAULT, RunConfig
from lanternflow.functions import geometry as G
from lanternflow.operators import analysis, annotate, detect, gate, labels
from lanternflow.plans.flagship import Detections
from lanternflow.sources import files, sinks


def run(objects: DataFrame, raw: DataFrame, config: RunConfig = DEFAULT) -> DataFrame:
    """Flagged events of all clips."""
    return Detections(objects, raw, config).events


def run_document(events: DataFrame, config: RunConfig = DEFAULT, model_digest: str | None = None) -> tuple[str, str]:
    """The event log and the run's metadata, both as JSON text."""
    return sinks.events_json(events), sinks.run_meta(config, model_digest, events.count())


def inspect_hits(objects: DataFrame, raw: DataFrame, frames: DataFrame, config: RunConfig = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hit lines, the summary, and each clip's longest run; frames need ts_s."""
    hits = Detections(objects, raw, config).hits.join(frames.select("clip_id", "frame_idx", "ts_s"), ["clip_id", "frame_idx"])
    th = config.weapon_confidence_threshold
    return annotate.hit_lines(hits, th), analysis.hit_summary(hits, frames, th), analysis.longest_run(hits, th, config.weapon_max_gap_s)


def export_snapshots(objects: DataFrame, raw: DataFrame, count: int = 5, min_conf: float = 0.5, min_gap_s: float = 0.3, pad_ratio: float = 1.0, config: RunConfig = DEFAULT) -> DataFrame:
    """Names and crop windows of the chosen hits.  Hits are chosen first; frames need only be fetched for these."""
    d = Detections(objects, raw, config)
    sizes = objects.select("clip_id", "frame_idx", "ts_s", "width", "height").distinct()
    hits = d.hits.join(sizes, ["clip_id", "frame_idx"])
    ordered = hits.withColumn("ord", F.col("frame_idx") * F.lit(1 << 20) + F.col("person_track_id"))
    chosen = analysis.spaced_top(ordered, count, min_gap_s, min_conf).select("clip_id", "frame_idx", "person_track_id")
    return annotate.snapshot_manifest(annotate.hit_boxes(hits.join(chosen, ["clip_id", "frame_idx", "person_track_id"]), d.persons), pad_ratio)


def inspect_frame(objects: DataFrame, raw: DataFrame, frame_idx: int | None = None, seconds: float | None = None, fps: float = 30.0, conf: float = 0.1, config: RunConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """People of one frame with their distance to the nearest vehicle and whether they are gated; all boxes by confidence."""
    frame = files.frame_at(objects, frame_idx, seconds, fps)
    persons, vehicles = detect.split_classes(frame)
    people = gate.nearest_any(persons, vehicles).withColumn("gated", F.coalesce(F.col("dist_norm") <= config.weapon_proximity_norm, F.lit(False)))
    boxes = files.frame_at(raw, frame_idx, seconds, fps).where(F.col("confidence") >= conf)
    return people, annotate.drawable(detect.ranked(boxes))


def diagnose(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    return analysis.signal_extremes(pairs, frames)


def inspect_labels(lines: DataFrame, images: DataFrame, class_idx: int, by_group: bool = True, samples: int = 20, top: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statistics, a random sample and the most elongated boxes of one class, by group of images."""
    own = labels.labels_with_image(labels.parse(lines).where(F.col("class_idx") == class_idx), images)
    box = G.pixels(F.col("cx"), F.col("cy"), F.col("w_norm"), F.col("h_norm"), F.col("width"), F.col("height"))
    boxes = labels.boxes(own.withColumn("bbox", box), by_group)
    return labels.box_stats(boxes), annotate.export_names(labels.sample(boxes, samples), "draw"), annotate.export_names(labels.most_elongated(boxes, top), "rank")


def merge_datasets(lines: Mapping[str, DataFrame], names: Mapping[str, Sequence[str]], config: Mapping) -> DataFrame:
    """Merge label files as a configuration says (see ``files.merge_config``); strict about classes."""
    targets = config["target_classes"]
    parts = []
    for source in config["sources"]:
        name = source["name"]
        caps = {targets.index(k): v for k, v in (source.get("max_area_norm") or {}).items()}
        parts.append((name, lines[name], labels.class_remap(names[name], source["class_map"], targets), caps))
    return labels.merge(parts)


def train_metrics(per_class: DataFrame) -> DataFrame:
    """One row of metrics: overall means and a map by class.  Training itself is outside."""
    return analysis.metrics_map(per_class)
