"""Readers: clips, frames, label folders, manifests, configs, digests."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lanternflow import schema


def digest(content: Column) -> Column:
    """The first 16 hex digits of the SHA-256; null stays null."""
    return F.substring(F.sha2(content, 256), 1, 16)


def file_digest(spark: SparkSession, path: str) -> str | None:
    """Digest of one file by Spark's reader; None if it is missing."""
    try:
        rows = spark.read.format("binaryFile").load(path).select(digest(F.col("content")).alias("d")).head(1)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return rows[0]["d"] if rows else None


def frame_at(rows: DataFrame, frame_idx: int | None = None, seconds: float | None = None, fps: float = 30.0) -> DataFrame:
    """Rows of one frame, by index or by time (to the nearest frame, halves to even); the index wins."""
    if frame_idx is None and seconds is None:
        raise ValueError("give a frame index or seconds")
    n = frame_idx if frame_idx is not None else round(seconds * fps)
    return rows.where(F.col("frame_idx") == F.lit(n))


def label_folder(spark: SparkSession, root: str, source: str, splits: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """Label lines of ``root/<split>/labels/*.txt``, numbered; splits that are absent are skipped."""
    glob = f"{root.rstrip('/')}/{{{','.join(splits)}}}/labels"
    rows = spark.read.option("pathGlobFilter", "*.txt").text(glob, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    part = F.regexp_extract("path", r"/([^/]+)/labels/([^/]+)\.txt$", 1)
    stem = F.regexp_extract("path", r"/([^/]+)/labels/([^/]+)\.txt$", 2)
    lines = rows.select(F.lit(source).alias("source"), part.alias("split"), stem.alias("image_stem"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "")


def image_folder(spark: SparkSession, root: str, source: str, splits: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """Image files of ``root/<split>/images``: names only, no bytes are read."""
    glob = f"{root.rstrip('/')}/{{{','.join(splits)}}}/images"
    rows = spark.read.format("binaryFile").load(glob).select("path")
    pattern = r"/([^/]+)/images/(.+?)(\.[^./]+)?$"
    return rows.select(F.lit(source).alias("source"), *[F.regexp_extract("path", pattern, i).alias(n) for i, n in ((1, "split"), (2, "image_stem"), (3, "ext"))])


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height) of the images that can be decoded; others are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))


def clips(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Clip metadata: clip_id, path, width, height, fps (0 or null: 30), frame_count."""
    t = spark.createDataFrame(list(rows), schema.CLIPS)
    return t.withColumn("fps", F.coalesce(F.when(F.col("fps") > 0, F.col("fps")), F.lit(30.0)))


def clip_frames(clips: DataFrame, stride: int = 1, per_row: int = 10_000) -> DataFrame:
    """The sampled frames of every clip of a table: clip_id, frame_idx, ts_s.

    ``clips`` has clip_id, frame_count and fps (0 or null: 30).  A long clip is
    cut to spans of ``per_row`` frames that are dealt out before they become
    rows, so no task holds a clip.  A clip without frames, or whose count is
    null, gives none; equal rows give their frames each.
    """
    step = max(1, stride)
    fps = F.coalesce(F.when(F.col("fps") > 0, F.col("fps").cast("double")), F.lit(30.0))
    cut = F.expr(f"explode(sequence(0L, (frame_count - 1) div {per_row}L))")
    spans = clips.where("frame_count > 0").select("clip_id", F.col("frame_count").cast("long").alias("frame_count"), fps.alias("fps")).select("*", cut.alias("span"))
    first = F.expr(f"(span * {per_row}L + {step - 1}L) div {step}L * {step}L")
    dealt = spans.repartition("clip_id", "span").select("*", first.alias("first"), F.expr(f"least(frame_count, (span + 1L) * {per_row}L) - 1L").alias("last"))
    found = dealt.where("first <= last").select("clip_id", "fps", F.expr(f"explode(sequence(first, last, {step}L))").alias("frame_idx"))
    return found.select("clip_id", "frame_idx", (F.col("frame_idx") / F.col("fps")).alias("ts_s"))


def manifest_names(text: str) -> list[str]:
    """Class names of a YAML manifest; a mapping is ordered by its keys as numbers."""
    import yaml

    names = yaml.safe_load(text)["names"]
    return [names[k] for k in sorted(names, key=int)] if isinstance(names, Mapping) else list(names)


def merge_config(text: str) -> dict:
    """A merge configuration: target_classes, output, sources[name, data_yaml, class_map, max_area_norm?]."""
    found = json.loads(text)
    missing = {"target_classes", "output", "sources"} - found.keys()
    if missing:
        raise ValueError(f"the configuration lacks {', '.join(sorted(missing))}")
    return found


class ClipSource(DataSource):
    """``spark.read.format("clip")`` and ``spark.readStream.format("clip")``: the sampled frames of a clip described by options.

    Options: clip_id, frame_count, fps (0 or missing: 30), width, height,
    stride (at least 1), frames_per_task, and for a stream frames_per_batch and
    live.  Only indices and times are made; a model's source subclasses
    ``ClipReader`` and yields rows of its own schema from ``read``.  The stride
    is taken by the reader, so skipped frames cost nothing.

    A stream gives the frames in order, ``frames_per_batch`` at a time, and
    resumes behind the last frame of its checkpoint.  With ``live`` it has no
    last frame: as many are there as have passed at the clip's rate since the
    stream first began (``frame_count`` is not needed then).
    """

    @classmethod
    def name(cls) -> str:
        return "clip"

    def schema(self) -> str:
        return f"{schema.FRAMES}, width int, height int, fps double"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ClipReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return ClipStreamReader(self.options)


class Span(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class _Clip:
    """A clip's options and its frames by index."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.live = str(options.get("live", "false")).lower() == "true"
        if "frame_count" not in options and not self.live:
            raise FileNotFoundError(f"clip {options.get('clip_id', '')!r} cannot be opened: frame_count is unknown")
        self.clip = options.get("clip_id", "clip0")
        self.count, self.width, self.height = int(options.get("frame_count", 0)), int(options.get("width", 0)), int(options.get("height", 0))
        self.fps = float(options.get("fps", 0)) or 30.0
        self.stride = max(1, int(options.get("stride", 1)))
        self.per_task = max(1, int(options.get("frames_per_task", 10_000)))
        self.per_batch = max(1, int(options.get("frames_per_batch", 10_000)))

    def spans(self, start: int, stop: int) -> Sequence[InputPartition]:
        return [Span(i, min(i + self.per_task, stop)) for i in range(start, stop, self.per_task)]

    def read(self, partition: Span) -> Iterator[tuple]:
        first = -(-partition.start // self.stride) * self.stride
        for i in range(first, partition.stop, self.stride):
            yield (self.clip, i, i / self.fps, self.width, self.height, self.fps)


class ClipReader(_Clip, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        if self.live:
            raise ValueError("a live clip can only be read as a stream")
        return self.spans(0, self.count)


class ClipStreamReader(_Clip, DataSourceStreamReader):
    """Offsets are the next frame and, for a live clip, when it began."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0, "began": time.time() if self.live else 0.0}

    def latestOffset(self, start: dict | None = None, limit: object = None) -> dict:  # noqa: N802
        now = start or getattr(self, "_given", None) or self.initialOffset()
        there = int((time.time() - now["began"]) * self.fps) if self.live else self.count
        self._given = {"next": min(max(there, now["next"]), now["next"] + self.per_batch), "began": now["began"]}
        return self._given

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self._given = end
        return self.spans(start["next"], end["next"])

    def commit(self, end: dict) -> None:
        pass
