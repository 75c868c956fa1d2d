"""Label curation, readers and sinks."""

import csv
import json

import pytest
import yaml
from pyspark.sql import functions as F

from lanternflow import schema
from lanternflow.config import RunConfig
from lanternflow.operators import labels
from lanternflow.sources import files, label_tree, sinks


def lines(spark, rows):
    return spark.createDataFrame([("s", "train", f"a_{i}", 0, r) for i, r in enumerate(rows)], schema.LABEL_LINES)


def test_parse_normalises_and_refuses(spark):
    got = labels.parse(lines(spark, ["  1  0.5 0.5\t0.2 0.1  x y ", "   ", "2 0 0 1 1"])).collect()
    assert [(r.class_idx, r.w_norm, r.parts[-1]) for r in got] == [(1, 0.2, "y"), (2, 1.0, "1")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        labels.parse(lines(spark, ["1.0 0 0 1 1"])).collect()


def test_class_map_is_strict():
    assert labels.class_remap(["p", "w"], {"p": None, "w": "gun"}, ["gun"]) == {0: None, 1: 0}
    with pytest.raises(ValueError, match="not in the map"):
        labels.class_remap(["p", "w"], {"w": "gun"}, ["gun"])
    with pytest.raises(ValueError, match="not a target"):
        labels.class_remap(["w"], {"w": "knife"}, ["gun"])


def test_remap_and_cap(spark):
    rows = labels.remap(labels.parse(lines(spark, ["0 0 0 0.1 0.1", "1 0 0 0.25 0.25", "1 0 0 0.25 0.5 k", "2 0 0 1 1"])), {0: None, 1: 0, 2: 1})
    kept = labels.area_cap(rows, {0: 0.0625}).withColumn("out", labels.remapped_line())
    assert sorted(r.out for r in kept.collect()) == ["0 0 0 0.25 0.25", "1 0 0 1 1"]
    assert labels.area_cap(rows, None).count() == 3
    with pytest.raises(Exception, match="class index without a name"):
        labels.remap(labels.parse(lines(spark, ["9 0 0 1 1"])), {0: 0}).collect()


def test_groups_and_stats(spark):
    p = labels.parse(lines(spark, ["1 0 0 0.2 0.1", "1 0 0 0.4 0.1", "1 0 0 0.1 0", "1 0 0 0.3 0.3"]))
    s = labels.box_stats(labels.boxes(p)).first()
    assert s.source_group == "a" and s.n == 4 and abs(s.median_width - 0.25) < 1e-12 and s.max_aspect == 0.1 / 1e-9
    names = spark.createDataFrame([("x",), ("_y",), ("a_b_c",)], "n string")
    assert [r[0] for r in names.select(labels.group_of(names.n)).collect()] == ["all", "", "a"]
    assert labels.sample(labels.boxes(p), 3).count() == 3 and labels.most_elongated(labels.boxes(p), 2).count() == 2


def test_image_kinds(spark):
    imgs = spark.createDataFrame([("s", "train", "a_0", e, 1, 1) for e in (".png", ".jpeg")] + [("s", "train", "a_1", ".JPG", 1, 1)], "source string, split string, image_stem string, ext string, width int, height int")
    assert [r.ext for r in labels.labels_with_image(lines(spark, ["1", "2"]), imgs).collect()] == [".jpeg"]
    assert labels.image_labels(imgs, lines(spark, ["1"])).count() == 3


def test_label_folder(spark, tmp_path):
    for split, name, text in (("train", "a_1", "1 0 0 1 1\n\n2 0 0 1 1\n"), ("test", "b", "")):
        (tmp_path / split / "labels").mkdir(parents=True)
        (tmp_path / split / "images").mkdir()
        (tmp_path / split / "labels" / f"{name}.txt").write_text(text)
        (tmp_path / split / "images" / f"{name}.jpg").write_bytes(b"x")
    got = files.label_folder(spark, str(tmp_path), "s").collect()
    assert [(r.split, r.image_stem, r.line_no, r.line) for r in got] == [("train", "a_1", 0, "1 0 0 1 1"), ("train", "a_1", 2, "2 0 0 1 1")]
    assert sorted((r.split, r.image_stem, r.ext) for r in files.image_folder(spark, str(tmp_path), "s").collect()) == [("test", "b", ".jpg"), ("train", "a_1", ".jpg")]
    assert files.file_digest(spark, f"{tmp_path}/train/images/a_1.jpg") == "2d711642b726b044"
    assert files.file_digest(spark, f"{tmp_path}/none") is None


def test_manifest_and_config():
    assert files.manifest_names("names: {10: c, 2: b, 0: a}") == ["a", "b", "c"] == files.manifest_names("names: [a, b, c]")
    with pytest.raises(ValueError, match="lacks"):
        files.merge_config("{}")
    assert files.merge_config(json.dumps({"target_classes": [], "output": "o", "sources": []}))["output"] == "o"


def test_clip_source(spark):
    spark.dataSource.register(files.ClipSource)
    read = spark.read.format("clip").options(clip_id="k", frame_count=10, stride=3, frames_per_task=4, fps=0)
    assert [(r.frame_idx, round(r.ts_s, 3)) for r in read.load().orderBy("frame_idx").collect()] == [(0, 0.0), (3, 0.1), (6, 0.2), (9, 0.3)]
    with pytest.raises(Exception, match="cannot be opened"):
        spark.read.format("clip").load().count()


def test_frame_at(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "frame_idx long")
    assert files.frame_at(rows, seconds=2.5, fps=1.0).first().frame_idx == 2
    assert files.frame_at(rows, 3, 0.0).first().frame_idx == 3
    with pytest.raises(ValueError, match="frame index"):
        files.frame_at(rows)


def test_event_sinks(spark, tmp_path):
    none = spark.createDataFrame([], schema.EVENTS)
    assert sinks.events_json(none) == "[]" and [r.line for r in sinks.event_log_lines(none).collect()] == ["none"]
    events = spark.createDataFrame([("c", "weapon", 1.0, 2.0, 1, 2, 0.75, [3, 4]), ("c", "weapon", 0.5, 1.5, 0, 1, 0.5, [9])], schema.EVENTS)
    assert [e["track_ids"] for e in json.loads(sinks.events_json(events))] == [[9], [3, 4]]
    sinks.write_csv(events, f"{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("part*.csv")).read_bytes().decode()
    assert text.startswith("event_type,start_timestamp_s,") and text.endswith('"3,4"\r\n')
    assert len(list(csv.reader(text.splitlines()))) == 3
    meta = json.loads(sinks.run_meta(RunConfig(video_path="v"), None, 2))
    assert len(meta) == 15 and meta["num_events"] == 2 and "write_video" not in meta


def test_label_sink(spark, tmp_path):
    imgs = spark.createDataFrame([("train", "x"), ("test", "y")], "split string, image_stem string")
    rows = spark.createDataFrame([("train", "x", 1, "b"), ("train", "x", 0, "a")], "split string, image_stem string, line_no int, line string")
    for _ in range(2):
        manifest = yaml.safe_load(sinks.write_labels(rows, imgs.withColumn("path", F.concat("split", F.lit("/images/"), "image_stem")), f"{tmp_path}/out", ["gun", "blade"]))
        assert {(r.image_stem, r.label, r.path) for r in spark.read.parquet(f"{tmp_path}/out/table").collect()} == {("x", "a\nb", "train/images/x"), ("y", "", "test/images/y")}
        texts = {r.image_stem: r.value for r in spark.read.text(f"{tmp_path}/out/labels", wholetext=True).collect()}
        assert texts["x"].rstrip("\n") == "a\nb"
        assert manifest["names"] == ["gun", "blade"] and manifest["nc"] == 2 and manifest["test"] == "test/images"
    assert "test" not in yaml.safe_load(sinks.merged_manifest("r", ["gun"], ["train", "valid"]))


def test_event_log_is_in_order(spark):
    events = spark.createDataFrame([("c", "weapon", float(9 - i), 10.0, 1, 2, 0.75, [i]) for i in range(9)], schema.EVENTS).repartition(5)
    lines = [r.line for r in sinks.event_log_lines(events).collect()]
    assert lines == [f"weapon at {i}.00s-10.00s, peak 0.75" for i in range(1, 10)]
    assert [r.place for r in sinks.numbered(events).orderBy("start_timestamp_s").collect()] == list(range(1, 10))


def test_summary_json(spark):
    assert json.loads(sinks.summary_json(spark.range(1).selectExpr("3 AS frames_total", "CAST(NULL AS DOUBLE) AS min_distance_norm"))) == {"frames_total": 3, "min_distance_norm": None}


def test_clip_source_as_a_stream(spark, tmp_path):
    """Batch and stream give the same frames; the stream resumes behind the last frame it has given."""
    spark.dataSource.register(files.ClipSource)
    options = {"clip_id": "c", "frame_count": "25", "fps": "10", "stride": "2", "frames_per_task": "4"}
    batch = spark.read.format("clip").options(**options).load()
    assert [(r.frame_idx, r.ts_s) for r in batch.orderBy("frame_idx").collect()] == [(i, i / 10) for i in range(0, 25, 2)]
    for _ in range(3):
        stream = spark.readStream.format("clip").options(**options, frames_per_batch="10").load()
        stream.writeStream.format("parquet").options(checkpointLocation=f"{tmp_path}/state", path=f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.frame_idx for r in got) == list(range(0, 25, 2))


def test_clip_metadata(spark):
    rows = files.clips(spark, [("a", "p", 640, 480, 0.0, 10), ("b", "q", 640, 480, 25.0, 10), ("c", "r", 640, 480, None, 10)]).collect()
    assert [r.fps for r in rows] == [30.0, 25.0, 30.0]


def test_frames_of_a_table_of_clips(spark):
    rows = [("a", 10, 5.0), ("b", 7, 0.0), ("c", 0, 1.0), ("d", None, 1.0), ("e", 1, None)]
    clips = spark.createDataFrame(rows, "clip_id string, frame_count long, fps double")
    for stride in (1, 3, 4, 20):
        want = sorted((c, i, i / (fps or 30.0)) for c, n, fps in rows for i in range(0, n or 0, stride))
        for per_row in (1, 2, 5, 100):
            assert sorted(map(tuple, files.clip_frames(clips, stride, per_row).collect())) == want


def test_label_tree(spark, tmp_path):
    imgs = spark.createDataFrame([("train", "x"), ("test", "y"), ("train", "z")], "split string, image_stem string")
    rows = spark.createDataFrame([("train", "x", 1, "b"), ("train", "x", 0, "a"), ("train", "z", 0, "c")], "split string, image_stem string, line_no int, line string").repartition(3)
    for _ in range(2):  # written again, it is the same
        label_tree.write_tree(rows, imgs, f"file://{tmp_path}/out", ["gun", "blade"])
        found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
        manifest = yaml.safe_load(found.pop("data.yaml"))
        assert found == {"train/labels/x.txt": "a\nb\n", "train/labels/z.txt": "c\n", "test/labels/y.txt": ""}
        assert manifest["names"] == ["gun", "blade"] and manifest["test"] == "test/images"


def test_a_failed_label_tree_does_not_count(spark, tmp_path):
    spark.dataSource.register(label_tree.LabelTree)

    def fail(batches):
        for b in batches:
            yield b
            raise ValueError("lost")

    rows = spark.range(20).selectExpr("'train' AS split", "concat('s', id) AS image_stem", "'l' AS label").coalesce(1)
    with pytest.raises(Exception, match="lost"):
        rows.mapInArrow(fail, rows.schema).write.format("label_tree").mode("append").save(f"file://{tmp_path}/out")
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    rows.write.format("label_tree").mode("append").save(f"file://{tmp_path}/out")
    assert len(list((tmp_path / "out/train/labels").glob("*.txt"))) == 20 and (tmp_path / "out/data.yaml").exists()
