"""The debounce against its rules, an independent fold, and its streaming form."""

import random

import pytest

from lanternflow.operators.analysis import active_banner
from lanternflow.operators.annotate import banner_lines
from lanternflow.operators.debounce import Thresholds, candidates, debounce, first_candidates, streaks
from lanternflow.schema import EVENTS
from lanternflow.streaming.debounce import IDLE, banner_stream, closing_rows, debounce_stream, fold, late_rows, replay, replay_banner, run_to

T = Thresholds(0.5, 0.5, 5.0, 0.15)
SCHEMA = "clip_id string, frame_idx long, ts_s double, vehicle_ord long, vehicle_track_id long, score double, track_ids array<long>"


def table(spark, samples, vehicle=1):
    return spark.createDataFrame([("c", i, float(t), i, vehicle, float(s), [vehicle, *ids]) for i, (t, s, *ids) in enumerate(samples)], SCHEMA)


def run(spark, samples, t=T):
    out = debounce(table(spark, samples), t).orderBy("end_timestamp_s").collect()
    return [(r.start_timestamp_s, r.end_timestamp_s, r.peak_score, r.track_ids) for r in out]


CASES = {
    "duration met": ([(0.0, 0.8), (0.2, 0.8), (0.6, 0.8)], T, [(0.0, 0.6)]),
    "never above": ([(t, 0.3) for t in (0.0, 0.2, 0.6, 1.0)], T, []),
    "brief dip": ([(0.0, 0.8), (0.1, 0.3), (0.2, 0.8), (0.6, 0.8)], T, [(0.0, 0.6)]),
    "long gap": ([(0.0, 0.8), (0.3, 0.3), (0.4, 0.8), (0.7, 0.8)], T, []),
    "person churn": ([(0.0, 0.8, 31), (0.2, 0.8, 35), (0.6, 0.8, 37)], T, [(0.0, 0.6)]),
    "silence is no gap": ([(0.0, 0.8), (100.0, 0.8)], T, [(0.0, 100.0)]),
    "two samples needed": ([(0.0, 0.8)], Thresholds(0.5, 0.0, 5.0, 0.15), []),
    "second sample fires": ([(0.0, 0.8), (0.0, 0.8)], Thresholds(0.5, 0.0, 5.0, 0.15), [(0.0, 0.0)]),
    "one per streak": ([(k * 0.5, 0.8) for k in range(41)], T, [(0.0, 0.5)]),
    "cooldown delays": ([(0.0, 0.8), (0.5, 0.8), (1.0, 0.1), (2.5, 0.8), (3.5, 0.8), (5.5, 0.8), (6.0, 0.8)], T, [(0.0, 0.5), (2.5, 5.5)]),
    "streak over before cooldown": ([(0.0, 0.8), (0.5, 0.8), (1.0, 0.1), (2.0, 0.8), (3.0, 0.8), (4.0, 0.1), (7.0, 0.8), (8.0, 0.8)], T, [(0.0, 0.5), (7.0, 8.0)]),
    "gap equal to the limit": ([(0.0, 0.8), (0.125, 0.1), (0.5, 0.8)], Thresholds(0.5, 0.5, 5.0, 0.125), [(0.0, 0.5)]),
    "threshold zero fires on silence": ([(0.0, 0.0), (0.6, 0.0)], Thresholds(0.0, 0.5, 5.0, 0.15), [(0.0, 0.6)]),
}


@pytest.mark.parametrize("name", CASES)
def test_rules(spark, name):
    samples, t, want = CASES[name]
    assert [x[:2] for x in run(spark, samples, t)] == want


def test_peak_and_ids_of_the_emitting_sample(spark):
    assert run(spark, [(0.0, 0.6, 5), (0.2, 0.9, 6), (0.5, 0.7, 7, 8)]) == [(0.0, 0.5, 0.9, [1, 7, 8])]


def plain(rows, t):
    """The rules row by row: one vehicle, rows in order."""
    out, opened, last, n, peak, done, free = [], None, None, 0, 0.0, False, -1.0
    for ts, s in rows:
        if s < t.confidence:
            if opened is not None and ts - last > t.max_gap_s:
                opened, done = None, False
        else:
            if opened is None:
                opened, n, peak = ts, 0, s
            last, n, peak = ts, n + 1, max(peak, s)
            if not done and n >= 2 and ts - opened >= t.min_duration_s and ts >= free:
                done, free = True, ts + t.cooldown_s
                out.append((opened, ts, peak))
    return out


def test_batch_equals_an_independent_fold(spark):
    rng = random.Random(5)
    for t in (Thresholds(0.5, 0.2, 1.0, 0.3), Thresholds(0.5, 0.0, 0.0, 0.0), Thresholds(0.5, 0.4, 3.0, 0.25)):
        rows, want = [], {}
        for v in range(6):
            times = sorted(rng.choice([k * 0.125 for k in range(400)]) for _ in range(300))
            own = [(x, rng.random()) for x in times]
            want[v] = plain(own, t)
            rows += [("c", i, x, i, v, s, [v]) for i, (x, s) in enumerate(own)]
        got = debounce(spark.createDataFrame(rows, SCHEMA), t).collect()
        for v in range(6):
            assert sorted((r.start_timestamp_s, r.end_timestamp_s, r.peak_score) for r in got if r.track_ids == [v]) == want[v]
            state = dict(IDLE)
            assert [(e[0], e[1], e[4]) for e in fold(state, [(x, i, i, s, [v]) for _, i, x, _, vv, s, _ in rows if vv == v], t)] == want[v]


def test_negative_gap_is_refused(spark):
    with pytest.raises(ValueError, match="negative"):
        debounce(table(spark, []), Thresholds(max_gap_s=-1.0))


def test_empty_table(spark):
    assert debounce(table(spark, [])).count() == 0


@pytest.mark.parametrize("stops", [0, 2])
def test_stream_equals_batch(spark, stops):
    rng = random.Random(9)
    rows = [("c", i, i / 15.0, i, v, rng.random(), [v]) for v in range(3) for i in range(200)]
    samples = spark.createDataFrame(rows, SCHEMA)
    t = Thresholds(0.5, 0.15, 1.0, 0.15)
    assert key(replay(samples, t, stops=stops)) == key(debounce(samples, t))


def key(df):
    return sorted(tuple(r[:7]) for r in df.drop("track_ids").collect())


def test_stream_with_disorder_and_late_rows(spark, tmp_path):
    """Rows out of order within the delay change nothing; a row later than the watermark is dropped and counted."""
    rng = random.Random(11)
    rows = [("c", i, i / 15.0, i, v, rng.random(), [v]) for v in range(2) for i in range(180)]
    t = Thresholds(0.5, 0.15, 1.0, 0.15)
    samples = spark.createDataFrame(rows, SCHEMA)
    rows.sort(key=lambda r: r[2] + rng.random())
    rows.append(("c", 0, 0.01, 0, 0, 0.9, [0]))
    late = 0
    for k in range(3):
        spark.createDataFrame(rows[k * 120 : k * 120 + 120 + (k == 2)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k == 2:
            closing_rows(samples).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        late += late_rows(run_to(debounce_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), t), str(tmp_path)))
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(debounce(samples, t)) and late == 1


def test_banner_stream_equals_batch(spark):
    frames = spark.createDataFrame([("c", i, i / 15.0) for i in range(300)] + [("d", i, i / 15.0) for i in range(30)], "clip_id string, frame_idx long, ts_s double")
    events = spark.createDataFrame([("c", "weapon", 0.0, 2.0, 0, 30, 0.9, [1]), ("c", "weapon", 9.0, 10.0, 0, 150, 0.9, [1]), ("d", "weapon", 0.0, 1.0, 0, 15, 0.9, [2])], EVENTS)
    want = {(r.clip_id, r.frame_idx, r.line) for r in banner_lines(active_banner(frames, events)).collect()}
    assert {tuple(r) for r in replay_banner(frames, events).collect()} == want and len(want) > 90


@pytest.mark.parametrize("lookback", [3.0, 0.1, 0.0])
def test_banner_stream_joins_by_slots(spark, capsys, lookback):
    """An event meets frames of its slots only, not all frames of its clip; none is lost at the lookback's borders."""
    shown, ended = [i / 10.0 for i in range(1200)], [(t, i / 10.0) for i in range(0, 1200, 7) for t in ("weapon", "dwell")]
    frames = spark.createDataFrame([("c", i, x) for i, x in enumerate(shown)], "clip_id string, frame_idx long, ts_s double")
    events = spark.createDataFrame([("c", t, 0.0, x, 0, 0, 0.9, [1]) for t, x in ended], EVENTS)
    banner_stream(frames, events, lookback).explain()
    joins = [x for x in capsys.readouterr().out.splitlines() if "Join" in x]
    assert len(joins) == 1 and joins[0].count("slot") >= 2
    want = {("c", i, f"RISK: {t}") for i, x in enumerate(shown) for t, end in ended if x - lookback <= end <= x}
    assert {tuple(r) for r in replay_banner(frames, events, lookback).collect()} == want and len(want) > 300


def test_long_key_is_cut_into_pieces(spark):
    """A key that never rests is folded between the gaps, with the events of the whole fold."""
    rng = random.Random(6)
    t = Thresholds(0.5, 0.1, 0.6, 0.1)
    own = [(i / 8.0, 0.0 if rng.random() < 0.3 else 0.9) for i in range(3000)]
    samples = spark.createDataFrame([("c", i, x, i, 1, s, [1]) for i, (x, s) in enumerate(own)], SCHEMA)
    pieces = first_candidates(candidates(streaks(samples, t), t), t).groupBy("piece").count()
    assert pieces.count() > 50
    assert sorted((r.start_timestamp_s, r.end_timestamp_s, r.peak_score) for r in debounce(samples, t).collect()) == plain(own, t)
