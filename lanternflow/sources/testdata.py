"""The driver's tables as the engine's: events -> frames, objects, model boxes; orders -> label files, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.functions import geometry as G

CLIP, WIDTH, HEIGHT, FPS, PER_FRAME = "clip0", 816, 448, 15.0, 12


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    # A column, as in real data; a constant would be folded out of the keys and hide how rows are dealt.
    clip = F.when(F.col("event_id").isNotNull(), F.lit(CLIP))
    return e.withColumn("frame_idx", F.expr(f"event_id div {PER_FRAME}")).withColumn("clip_id", clip)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each frame, without timestamps."""
    f = events(spark, sf_dir).select("clip_id", "frame_idx").distinct()
    return f.withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT), "fps": F.lit(FPS)})


def detector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw detector output: one row for each event that is no model box, its class id and confidence."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("purchase", "view", "click", "signup"))
    vehicle = F.col("event_type") == "purchase"
    cx, cy = (F.col("event_id") * 97 + F.col("user_id") * 31) % WIDTH, (F.col("event_id") * 57 + F.col("user_id") * 13) % HEIGHT
    w, h = (20 + F.col("event_id") % 60) / F.lit(2.0), (40 + F.col("event_id") % 90) / F.lit(2.0)
    return e.select(
        "clip_id", "frame_idx", (F.col("frame_idx") / F.lit(FPS)).alias("ts_s"), F.col("event_id").alias("det_ord"),
        F.when(vehicle, F.col("user_id") % 3).otherwise(1000 + F.col("user_id")).alias("track_id"),
        F.when(vehicle, 2).otherwise(0).alias("class_id"), F.least(F.col("value") / F.lit(100.0), F.lit(0.99)).alias("confidence"),
        G.bbox(cx - w, cy - h, cx + w, cy + h).alias("bbox"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked objects: of rows with one track in one frame the first; no confidence floor.

    Dealt by (clip, frame), which serves all that groups or joins by frame.
    """
    from lanternflow.operators.detect import class_of

    rows = detector_rows(spark, sf_dir).repartition("clip_id", "frame_idx")
    keys = ["clip_id", "frame_idx", "track_id"]
    rest = [c for c in rows.columns if c not in (*keys, "det_ord")]
    first = rows.groupBy(*keys).agg(F.min(F.struct("det_ord", *rest)).alias("x")).select(*keys, "x.*")
    return first.withColumn("cls", class_of(F.col("class_id"))).drop("class_id")


def weapon_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model boxes: every error event for every person of its frame."""
    e = events(spark, sf_dir).where("event_type = 'error'")
    kind = F.expr("(event_id div 5) % 5")
    name = F.when(kind == 0, "Person").when(kind == 1, "weapon").when(kind == 2, "Phone").when(kind == 3, "pistol")
    x, y = (F.col("event_id") % 50).cast("double"), (F.col("event_id") % 40).cast("double")
    boxes = e.select("clip_id", "frame_idx", F.col("event_id").alias("box_ord"), name.alias("class_name"), F.least(F.col("value") / F.lit(60.0), F.lit(0.99)).alias("confidence"), G.bbox(x, y, x + 10, y + 8).alias("crop_bbox"))
    people = objects(spark, sf_dir).where("cls = 'person'").select("clip_id", "frame_idx", F.col("track_id").alias("person_track_id"))
    return people.join(boxes, ["clip_id", "frame_idx"])


SOURCES = {"F": "cctv_v3", "P": "gun_cctv", "O": "pistols"}


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files from orders: source, split, image_stem, line_no, line."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    source = F.when(F.col("o_orderstatus") == "F", SOURCES["F"]).when(F.col("o_orderstatus") == "P", SOURCES["P"]).otherwise(SOURCES["O"])
    k = F.col("o_orderkey") % 10
    thousandth = lambda c: F.concat(F.lit("0."), F.lpad(c.cast("string"), 3, "0"))
    w, h = (F.col("o_orderkey") * 7) % 500 + 1, (F.col("o_custkey") * 11 + F.col("o_orderkey")) % 500 + 1
    line = F.concat_ws(" ", (F.col("o_custkey") % 3).cast("string"), thousandth(F.col("o_orderkey") % 1000), thousandth(F.col("o_custkey") % 1000), thousandth(w), thousandth(h))
    return o.select(
        source.alias("source"), F.when(k <= 7, "train").when(k == 8, "valid").otherwise("test").alias("split"),
        F.concat(F.lit("img"), F.expr("o_orderkey div 3").cast("string")).alias("image_stem"), (F.col("o_orderkey") % 3).cast("int").alias("line_no"), line.alias("line"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files beside the labels: most stems have one, some two of different kinds, some none; some have no label."""
    s = label_lines(spark, sf_dir).select("source", "split", "image_stem").distinct().withColumn("n", F.substring("image_stem", 4, 20).cast("long"))
    size = {"width": (640 + F.col("n") % 64).cast("int"), "height": F.lit(480)}
    kinds = F.filter(F.array(F.when(F.col("n") % 3 == 0, ".jpg").when(F.col("n") % 3 == 1, ".jpeg").otherwise(".png"), F.when(F.col("n") % 7 == 0, ".png")), lambda x: x.isNotNull())
    found = s.where("n % 5 <> 0").select("source", "split", "image_stem", "n", F.explode(F.array_distinct(kinds)).alias("ext"))
    extra = s.where("n % 11 = 0").select("source", "split", F.concat("image_stem", F.lit("x")).alias("image_stem"), "n", F.lit(".jpg").alias("ext"))
    return found.union(extra).withColumns(size).drop("n")
