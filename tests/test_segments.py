"""The debounce cut inside keys, and the stream from raw detections, against the row-by-row rules."""

import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from lanternflow.operators import scene, segments
from lanternflow.operators.debounce import Thresholds
from lanternflow.plans.flagship import Detections
from lanternflow.streaming import flagship
from lanternflow.streaming.debounce import IDLE, fold

SCHEMA = "clip_id string, frame_idx long, ts_s double, vehicle_ord long, vehicle_track_id long, score double, track_ids array<long>"


def key_rows(rng, n, span):
    """Samples with bursts above and below, silences, ties in time."""
    ts, rows, high = 0.0, [], False
    for i in range(n):
        if rng.random() < 0.2:
            high = not high
        ts += rng.choice([0.0, 0.05, 0.1, 0.1, 0.2, span])
        rows.append((ts, i, 0, rng.choice([0.6, 0.8, 0.9]) if high else 0.2, [i]))
    return rows


THRESHOLDS = [Thresholds(0.5, 0.15, 2.0, 0.15), Thresholds(0.5, 0.5, 0.0, 0.3), Thresholds(0.5, 0.0, 40.0, 0.0), Thresholds(0.0, 0.5, 1.0, 0.1)]


@pytest.mark.parametrize("t", THRESHOLDS)
def test_parts_and_chains_combine(t, monkeypatch):
    """Any cut of a key, combined in any grouping, gives what the whole fold gives."""
    rng = random.Random(7)
    for trial in range(60):
        rows = key_rows(rng, 60, rng.choice([0.3, 3.0]))
        want = fold(dict(IDLE), rows, t)
        cuts = sorted({0, 60, *(rng.randrange(60) for _ in range(rng.choice([0, 3, 59])))})
        while any(rows[c][0] == rows[c - 1][0] for c in cuts[1:-1]):  # a slot holds equal times
            cuts = [c for k, c in enumerate(cuts) if k in (0, len(cuts) - 1) or rows[c][0] != rows[c - 1][0]]
        pieces = [rows[a:b] for a, b in pairwise(cuts)]
        parts = [segments.Part.of(iter(p), t) for p in pieces]
        for k in range(len(pieces)):
            # the state before piece k, from parts combined to the left, to the right, and one by one
            left, one = segments.Part(), segments.Streak()
            for p in parts[:k]:
                left = left.then(p, t.max_gap_s)
                p.carry(one, t.max_gap_s)
            right = segments.Part()
            for p in reversed(parts[:k]):
                right = p.then(right, t.max_gap_s)
            whole = segments.Streak()
            for ts, frame, _, score, _ in (r for p in pieces[:k] for r in p):
                whole.add(ts, frame, score) if score >= t.confidence else whole.quiet(ts, t.max_gap_s)
            for got in (left, right):
                s = segments.Streak()
                got.carry(s, t.max_gap_s)
                assert (s.n, *((s.start, s.last, s.peak) if s.n else ())) == (whole.n, *((whole.start, whole.last, whole.peak) if whole.n else ())), trial
            assert one.n == whole.n
        found, s = [], segments.Streak()
        for p in pieces:
            found.append([])
            for ts, frame, _, score, _ in p:
                if score < t.confidence:
                    s.quiet(ts, t.max_gap_s)
                    continue
                s.add(ts, frame, score)
                if s.n >= 2 and ts - s.start >= t.min_duration_s:
                    found[-1].append((ts, s.start))
        begins = [p[0][0] for p in pieces]
        chains = [segments.Chain.of(f, t).kept(b, t.cooldown_s) for f, b in zip(found, begins, strict=True)]
        free, last, got = -segments.math.inf, -segments.math.inf, []
        for k, f in enumerate(found):
            state = (-segments.math.inf, -segments.math.inf)
            block = segments.Chain([])
            for c, b in zip(reversed(chains[:k]), reversed(begins[:k]), strict=True):
                block = c.then(block).kept(b, t.cooldown_s)
            assert block.carry(*state) == (free, last)
            for ts, streak in f:
                if ts >= free and streak != last:
                    free, last = ts + t.cooldown_s, streak
                    got.append((streak, ts))
        assert got == [(e[0], e[1]) for e in want]


def test_a_function_keeps_a_cooldown_only():
    t = Thresholds(0.5, 0.0, 5.0, 0.1)
    found = [(k / 10, float(k // 3)) for k in range(10_000)]
    assert len(segments.Chain.of(found, t).kept(0.0, t.cooldown_s).ts) <= 52


@pytest.mark.parametrize(("slot", "fan"), [(0.01, 4), (0.7, 3), (10.0, 4096)])
def test_keys_cut_at_any_length(spark, monkeypatch, slot, fan):
    """Slots of about 1, 7 and 100 samples, blocks of a few slots and of all."""
    monkeypatch.setattr(segments, "FAN", fan)
    rng, t = random.Random(3), Thresholds(0.5, 0.15, 2.0, 0.15)
    keys = {(c, v): key_rows(rng, 150, 0.5) for c in "ab" for v in (1, 2)}
    rows = [(c, f, ts, o, v, s, ids) for (c, v), r in keys.items() for ts, f, o, s, ids in r]
    rng.shuffle(rows)
    got = segments.debounce(spark.createDataFrame(rows, SCHEMA).repartition(5), t, slot).collect()
    want = sorted((c, e[0], e[1], e[2], e[3], e[4], e[5]) for (c, _), r in keys.items() for e in fold(dict(IDLE), r, t))
    assert sorted((r.clip_id, r.start_timestamp_s, r.end_timestamp_s, r.start_frame_idx, r.end_frame_idx, r.peak_score, r.track_ids) for r in got) == want
    assert len(want) > 20


def test_no_samples(spark):
    assert segments.debounce(spark.createDataFrame([], SCHEMA)).collect() == []


BBOX = "struct<x1:double,y1:double,x2:double,y2:double>"
OBJECTS = f"clip_id string, frame_idx long, ts_s double, det_ord long, track_id long, cls string, bbox {BBOX}, width int, height int"
BOXES = f"clip_id string, frame_idx long, ts_s double, person_track_id long, box_ord long, class_name string, confidence double, crop_bbox {BBOX}"


def detections(spark, n=120):
    rng = random.Random(11)
    objects, boxes, k = [], [], 0
    for clip in ("a", "b"):
        for f in range(n):
            ts = f / 10
            for v in (1, 2):
                objects.append((clip, f, ts, k := k + 1, v, "vehicle", (50.0, 50.0, 400.0, 400.0), 816, 480))
            objects.append((clip, f, ts, k := k + 1, None, "person", (1.0, 1.0, 50.0, 50.0), 816, 480))
            for p in (10, 11):
                objects.append((clip, f, ts, k := k + 1, p, "person", (100.0 + rng.randrange(300), 100.0, 300.0, 300.0), 816, 480))
                objects.append((clip, f, ts, k := k + 1, p, "person", (700.0, 400.0, 780.0, 470.0), 816, 480))  # the first of a track counts
                for b in range(rng.randrange(3)):
                    name = rng.choice(["weapon", "Person", None])
                    boxes.append((clip, f, ts, p, b, name, rng.choice([0.3, 0.45, 0.8 if (f // 15) % 2 else 0.45]), (1.0, 1.0, 9.0, 9.0)))
    return spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(boxes, BOXES)


def test_stream_from_detections_equals_the_batch(spark):
    objects, boxes = detections(spark)
    first = objects.where("track_id IS NOT NULL").groupBy("clip_id", "frame_idx", "track_id").agg(F.min(F.struct("det_ord", "ts_s", "cls", "bbox", "width", "height")).alias("x")).select("clip_id", "frame_idx", "track_id", "x.*")
    batch = Detections(first, boxes)
    frames = scene.assembled(objects, boxes).groupBy(*scene.KEYS).agg(F.collect_list("object").alias("objects"), F.collect_list("box").alias("boxes"))
    columns = ["clip_id", "frame_idx", "vehicle_track_id", "score", "track_ids"]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(scene.samples(scene.gathered(frames)).select(columns)) == rows(batch.samples.select(columns))
    want = rows(batch.events)
    assert len(want) >= 4
    assert rows(flagship.replay(objects, boxes, stops=2)) == want
