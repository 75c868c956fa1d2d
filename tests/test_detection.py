"""Gate, denylist, best box, nearest vehicle, samples, crops."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanternflow import schema
from lanternflow.functions import geometry as G
from lanternflow.operators import detect, gate, score

PERSON, VEHICLE, FAR = (100.0, 100.0, 200.0, 300.0), (50.0, 50.0, 400.0, 400.0), (700.0, 400.0, 780.0, 470.0)


def objs(spark, rows, w=816, h=480):
    data = [("c", f, f / 15.0, o, t, k, 0.9, b, w, h) for f, o, t, k, b in rows]
    return spark.createDataFrame(data, schema.OBJECTS + ", width int, height int")


def raw(spark, rows, frame=0):
    return spark.createDataFrame([("c", frame, p, i, n, c, b) for p, i, n, c, b in rows], schema.WEAPON_RAW)


def chain(spark, rows, boxes, proximity=0.5, **size):
    o = objs(spark, rows, **size)
    p, v = detect.split_classes(o)
    crops = detect.crop_windows(gate.gated(p, v, proximity))
    return detect.hits(raw(spark, boxes), crops)


PAIR = [(0, 0, 10, "person", PERSON), (0, 1, 2, "vehicle", VEHICLE)]


def test_denylist_beats_confidence(spark):
    got = chain(spark, PAIR, [(10, 0, "person", 0.95, (10.0, 10.0, 20.0, 20.0)), (10, 1, "weapon", 0.6, (12.0, 12.0, 18.0, 18.0))]).collect()
    assert [(r.person_track_id, r.confidence) for r in got] == [(10, 0.6)]
    assert tuple(got[0].bbox) == (72.0, 32.0, 78.0, 38.0)  # the crop starts at (60, 20)


def test_person_box_alone_is_no_hit(spark):
    assert chain(spark, PAIR, [(10, 0, "Person", 0.9, (0.0, 0.0, 1.0, 1.0))]).count() == 0


def test_unknown_name_counts_as_threat_and_empty_list_is_default(spark):
    r = raw(spark, [(1, 0, None, 0.9, PERSON), (1, 1, "HAND", 0.9, PERSON), (1, 2, "gun", 0.4, PERSON), (1, 3, "gun", 0.39, PERSON)])
    assert sorted(x.box_ord for x in detect.threats(r, non_threat=[]).collect()) == [0, 2]
    assert sorted(x.box_ord for x in detect.threats(r, non_threat=["GUN"]).collect()) == [0, 1]


def test_first_of_equal_boxes_wins(spark):
    r = raw(spark, [(1, 5, "a", 0.7, PERSON), (1, 3, "b", 0.7, PERSON), (1, 9, "c", 0.6, PERSON)])
    assert [(x.box_ord, x.class_name) for x in detect.best_threat(r).collect()] == [(3, "b")]
    assert [x.box_ord for x in detect.ranked(r).orderBy("rank").collect()] == [3, 5, 9]


def test_far_person_is_not_gated_and_never_reaches_the_model(spark):
    rows = [*PAIR, (0, 2, 11, "person", FAR)]
    p, v = detect.split_classes(objs(spark, rows))
    assert [r.track_id for r in gate.gated(p, v, 0.2).collect()] == [10]
    assert [r.track_id for r in gate.not_gated(p, v, 0.2).collect()] == [11]
    seen = spark.sparkContext.accumulator(0)

    def make():
        def model(pdf):
            seen.add(len(pdf))
            assert list(pdf.track_id) == [10]
            return pd.DataFrame([("c", 0, 10, 0, "weapon", 0.9, {"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0})], columns=["clip_id", "frame_idx", "person_track_id", "box_ord", "class_name", "confidence", "crop_bbox"])

        return model

    assert detect.infer(detect.crop_windows(gate.gated(p, v, 0.2)), make).count() == 1
    assert seen.value == 1


def test_no_vehicle_or_no_frame_size_gates_nobody(spark):
    p, v = detect.split_classes(objs(spark, PAIR[:1]))
    assert gate.gated(p, v).count() == 0 and gate.nearest_any(p, v).collect()[0].dist_norm is None
    p, v = detect.split_classes(objs(spark, PAIR, w=0, h=0))
    assert gate.gated(p, v, 1.0).count() == 0 and gate.nearest_gated(p, v, 1.0).count() == 0


def test_equally_near_vehicles_give_the_first(spark):
    rows = [(0, 0, 1, "person", PERSON), (0, 2, 8, "vehicle", VEHICLE), (0, 1, 9, "vehicle", VEHICLE)]
    p, v = detect.split_classes(objs(spark, rows))
    assert [r.vehicle_track_id for r in gate.nearest_gated(p, v, 0.9).collect()] == [9]


def test_samples_keep_silent_vehicles_and_list_low_contributors(spark):
    rows = [(0, 3, 7, "person", PERSON), (0, 1, 8, "person", PERSON), (0, 0, 2, "vehicle", VEHICLE), (0, 5, 3, "vehicle", FAR)]
    p, v = detect.split_classes(objs(spark, rows))
    hits = spark.createDataFrame([("c", 0, 7, 0.9, PERSON), ("c", 0, 8, 0.42, PERSON)], schema.HITS)
    s = score.samples(v, score.hits_by_vehicle(gate.nearest_gated(p, v, 0.5), hits), 0.5)
    assert {r.vehicle_track_id: (r.score, r.track_ids) for r in s.collect()} == {2: (0.9, [2, 8, 7]), 3: (0.0, [3])}


@pytest.mark.parametrize(("conf", "want"), [(None, 0.0), (0.49, 0.0), (0.5, 0.5), (0.8, 0.8)])
def test_score_gate(spark, conf, want):
    assert spark.range(1).select(score.gate_score(F.lit(conf).cast("double"), 0.5).alias("s")).first().s == want


def test_crop_window_truncates_clamps_and_may_be_empty(spark):
    row = lambda b: spark.range(1).select(G.crop_window(G.bbox(*b), 0.4, F.lit(100), F.lit(50)).alias("w")).select("w.*", G.nonempty(F.col("w")).alias("ok")).first()
    assert tuple(row((10.0, 10.0, 20.9, 20.9))) == (5, 5, 25, 25, True)
    assert tuple(row((-3.0, 40.0, 10.0, 90.0))) == (0, 20, 15, 50, True)
    assert row((-90.0, 0.0, -60.0, 10.0)).ok is False


def test_detector_rows(spark):
    rows = [(0, 0.35, 1), (2, 0.9, 2), (1, 0.9, 3), (7, 0.34, 4), (5, 0.5, None)]
    got = detect.objects(spark.createDataFrame(rows, "class_id int, confidence double, track_id long")).collect()
    assert [(r.track_id, r.cls) for r in got] == [(1, "person"), (2, "vehicle")]


def test_stride_and_rate(spark):
    f = spark.createDataFrame([(i, fps) for i, fps in enumerate([0.0, 10.0, 10.0, None])], "frame_idx long, fps double")
    assert [r.frame_idx for r in detect.stride(f, 0).collect()] == [0, 1, 2, 3]
    assert [r.frame_idx for r in detect.stride(f, 2).collect()] == [0, 2]
    assert [round(r.ts_s, 4) for r in detect.timestamps(f).collect()] == [0.0, 0.1, 0.2, 0.1]
