"""Places, medians, runs and spaced choices without a task that holds a group, against plain versions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lanternflow.operators import analysis, spaced
from lanternflow.operators.ranked import medians, ranked
from lanternflow.streaming.runs import replay_longest

HITS = "clip_id string, ts_s double, confidence double, ord long, frame_idx long, person_track_id long"


def hit_rows(seed=1, n=400):
    rng, rows = random.Random(seed), []
    for clip in ("a", "b"):
        ts = 0.0
        for i in range(n if clip == "a" else 30):
            ts += rng.choice([0.0, 0.05, 0.1, 0.1, 0.15, 0.4])
            rows.append((clip, ts, rng.choice([0.3, 0.6, 0.7, 0.8, 0.9]), i % 7, i, i % 5))
    return [*rows, ("c", 1.0, 0.1, 0, 0, 0)]


def test_places_of_a_skewed_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a"] * 20 + ["b", None]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, _n long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranked(df, ["g"], [F.col("v"), F.col("_n")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("a", "b", None):
        own = sorted((v, n) for x, v, n in rows if x == g)
        assert [(r.v, r._n) for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == own
        assert sorted(r.place for r in got if r.g == g) == list(range(1, len(own) + 1))
    assert ranked(df.limit(0), ["g"], [F.col("v")]).collect() == []


def test_medians(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([1.0, 1.0, 2.5, rng.random()]), None if i == 0 else rng.random()) for g, n in (("a", 501), ("b", 40), (None, 7), ("d", 1)) for i in range(n)]
    got = {r.g: (r.median_x, r.median_y) for r in medians(spark.createDataFrame(rows, "g string, x double, y double").repartition(4), ["g"], ["x", "y"]).collect()}
    for g in ("a", "b", None, "d"):
        xs, ys = [x for k, x, _ in rows if k == g], [y for k, _, y in rows if k == g and y is not None]
        assert got[g] == (statistics.median(xs), statistics.median(ys) if ys else None)


def plain_longest(rows, threshold, gap):
    out = {}
    for clip in {r[0] for r in rows}:
        ts = sorted({r[1] for r in rows if r[0] == clip and r[2] >= threshold})
        best = begin = 0
        for i, t in enumerate(ts):
            begin = i if i == 0 or t - ts[i - 1] > gap else begin
            best = max(best, t - ts[begin])
        out[clip] = float(best)
    return out


@pytest.mark.parametrize(("slot", "fan"), [(0.1, 3), (1.0, 5), (60.0, 4096)])
def test_longest_run(spark, monkeypatch, slot, fan):
    monkeypatch.setattr(analysis, "RUN_SLOT_S", slot)
    monkeypatch.setattr(analysis, "RUN_FAN", fan)
    rows = hit_rows()
    got = analysis.longest_run(spark.createDataFrame(rows, HITS), 0.5, 0.15).collect()
    assert {r.clip_id: r.longest_run_s for r in got} == plain_longest(rows, 0.5, 0.15)


def test_longest_run_of_a_stream(spark):
    # Times in eighths, which microseconds hold exactly; a gap of exactly the limit goes on.
    rows = [(c, round(t * 8) / 8, x, *rest) for c, t, x, *rest in hit_rows()]
    got = replay_longest(spark.createDataFrame(rows, HITS), 0.5, 0.125).collect()
    assert {r.clip_id: r.longest_run_s for r in got} == plain_longest(rows, 0.5, 0.125)


@pytest.mark.parametrize(("block", "k", "gap"), [(1, 1000, 0.3), (2, 15, 0.3), (64, 1000, 0.25), (64, 0, 0.3), (64, 5, 0.0)])
def test_spaced_choice_equals_the_greedy_loop(spark, monkeypatch, block, k, gap):
    monkeypatch.setattr(spaced, "BLOCK", block)
    monkeypatch.setattr(spaced, "PARTS", 3)
    rows = hit_rows()
    want = []
    for clip in ("a", "b", "c"):
        chosen = []
        for r in sorted((r for r in rows if r[0] == clip and r[2] >= 0.5), key=lambda r: (-r[2], r[1], *r[3:])):
            if len(chosen) < max(k, 1) and all(abs(r[1] - c[1]) >= gap for c in chosen):
                chosen.append(r)
        want += [(clip, r[4], r[1], r[5], r[2]) for r in chosen]
    got = analysis.spaced_top(spark.createDataFrame(rows, HITS).repartition(3), k, gap, 0.5)
    assert sorted(map(tuple, got.collect())) == sorted(want)
