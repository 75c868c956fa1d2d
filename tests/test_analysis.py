"""Runs, spaced top-k, banner, extremes, metrics."""

import random

from lanternflow import schema
from lanternflow.operators import analysis

HITS = "clip_id string, frame_idx long, ts_s double, person_track_id long, confidence double, ord long"


def hits(spark, rows):
    return spark.createDataFrame([("c", i, float(t), 1, float(c), i) for i, (t, c) in enumerate(rows)], HITS)


def test_longest_run(spark):
    run = lambda rows: analysis.longest_run(hits(spark, rows), 0.5, 0.25).collect()
    assert run([(0, 0.9), (0.25, 0.9), (0.25, 0.6), (0.75, 0.9), (1.0, 0.2)])[0].longest_run_s == 0.25
    assert run([(3, 0.9)])[0].longest_run_s == 0.0
    assert run([(3, 0.1)])[0].longest_run_s == 0.0


def test_spaced_top_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(400) / 8, rng.randrange(20) / 20) for _ in range(300)]
    for k, gap in ((5, 0.5), (40, 1.0), (0, 1.0)):
        chosen = []
        for i in sorted(range(300), key=lambda i: (-rows[i][1], rows[i][0], i)):
            if rows[i][1] >= 0.5 and all(abs(rows[i][0] - rows[j][0]) >= gap for j in chosen) and len(chosen) < max(k, 1):
                chosen.append(i)
        got = analysis.spaced_top(hits(spark, rows), k, gap, 0.5).collect()
        assert sorted(r.frame_idx for r in got) == sorted(chosen)


def test_hit_summary_without_hits(spark):
    r = analysis.hit_summary(hits(spark, []), spark.range(7), 0.5).first()
    assert (r.n_frames, r.n_hits, r.n_above, r.max_confidence) == (7, 0, 0, None)


def test_banner_covers_the_lookback(spark):
    frames = spark.createDataFrame([("c", i, i * 0.5) for i in range(20)], schema.FRAMES)
    events = spark.createDataFrame([("c", "weapon", 0.0, 2.0, 0, 4, 0.9, [1]), ("c", "alarm", 0.0, 2.5, 0, 5, 0.9, [1])], schema.EVENTS)
    got = {r.frame_idx: r.banner for r in analysis.active_banner(frames, events).collect()}
    assert got == {i: "\n".join(f"RISK: {k}" for k, at in (("alarm", 2.5), ("weapon", 2.0)) if at <= i * 0.5 <= at + 3) for i in range(4, 12)}


def test_extremes_of_nothing(spark):
    pairs = spark.createDataFrame([], "clip_id string, frame_idx long, person_vehicle_distance_norm double, approach_speed_px_s double, " + ", ".join(f"{c} double" for c in analysis.SIGNALS))
    frames = spark.createDataFrame([("c", 0, True, False)], "clip_id string, frame_idx long, has_person boolean, has_vehicle boolean")
    r = analysis.signal_extremes(pairs, frames).first()
    assert r.min_distance_norm is None and r.max_approach_speed_px_s is None and r.max_weapon_score == 0.0
    assert (r.frames_total, r.person_frames, r.vehicle_frames, r.frames_with_pair) == (1, 1, 0, 0)


def test_metrics(spark):
    per = spark.createDataFrame([("a", 0.5, 1.0), ("b", 0.7, 0.0)], "class_name string, p double, r double")
    assert {(x.class_name, x.metric): round(x.value, 6) for x in analysis.metrics_long(per).collect()} == {("a", "p"): 0.5, ("a", "r"): 1.0, ("b", "p"): 0.7, ("b", "r"): 0.0, ("all", "p"): 0.6, ("all", "r"): 0.5}
    assert analysis.metrics_map(per).first().per_class["b"].p == 0.7
