"""The tools as functions, over the adapter's tables."""

from pathlib import Path

import pytest

from lanternflow.operators.detect import timestamps
from lanternflow.plans import tools
from lanternflow.sources import files
from lanternflow.sources import testdata as T

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def test_detection_tools(spark):
    objects, raw, frames = T.objects(spark, DATA), T.weapon_raw(spark, DATA), timestamps(T.frames(spark, DATA))
    assert (objects.where("cls = 'person'").count(), objects.where("cls = 'vehicle'").count(), raw.count()) == (481, 146, 1079)
    events = tools.run(objects, raw)
    log, meta = tools.run_document(events)
    assert log.count("event_type") == 3 and '"num_events": 3' in meta
    lines, summary, longest = tools.inspect_hits(objects, raw, frames)
    s = summary.first()
    assert s.n_frames == 84 and s.n_hits == lines.count() and lines.where("above").count() == s.n_above and longest.count() == 1
    shots = tools.export_snapshots(objects, raw, count=4)
    assert 1 <= shots.count() <= 4 and all(r.name.startswith("frame") for r in shots.collect())
    people, boxes = tools.inspect_frame(objects, raw, frame_idx=10)
    assert people.count() == objects.where("frame_idx = 10 AND cls = 'person'").count()
    assert boxes.where("class_name = 'Person'").count() == 0


def test_label_tools(spark):
    lines, images = T.label_lines(spark, DATA), T.images(spark, DATA)
    stats, drawn, top = tools.inspect_labels(lines, images, 1)
    assert stats.count() == 1 and drawn.count() == 20 and top.orderBy("rank").first().name.startswith("001_ar")
    config = files.merge_config('{"target_classes": ["gun"], "output": "o", "sources": [{"name": "pistols", "data_yaml": "x", "class_map": {"person": null, "weapon": "gun", "knife": "gun"}, "max_area_norm": {"gun": 0.02}}]}')
    merged = tools.merge_datasets({"pistols": lines.where("source = 'pistols'")}, {"pistols": ["person", "weapon", "knife"]}, config)
    assert 0 < merged.count() < lines.count() and {r.line[:2] for r in merged.collect()} == {"0 "}


def test_fixed_rounds_as_python_prints(spark):
    import random

    from pyspark.sql import functions as F

    from lanternflow.functions.text import fixed

    rng = random.Random(1)
    xs = [round(rng.random() * 10 ** rng.randint(0, 5), 3) for _ in range(2000)] + [k / 8 for k in range(80)] + [0.745, 0.755, 1.005, 0.29, 2.675, 0.0, 1e5]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[fixed(F.col("x"), d).alias(f"d{d}") for d in (1, 2, 3)]).collect()
    assert [(r.d1, r.d2, r.d3) for r in rows] == [(f"{x:.1f}", f"{x:.2f}", f"{x:.3f}") for x in xs]
