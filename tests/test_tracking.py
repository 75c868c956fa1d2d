"""The tracker hook: ids do not depend on batches, partitions or pieces; late rows are counted for good."""

import random

import pyarrow as pa
import pytest

from lanternflow.operators.tracking import LOCAL, ByValue, tracked
from lanternflow.streaming.debounce import late_rows, run_to, timed
from lanternflow.streaming.late import LateRows, late_totals

SCHEMA = "clip_id string, frame_idx long, det_ord long, kind string, track_id long"


def nearest():
    """A tracker that carries state: each row takes the id of the last row of its kind, or at times a new one."""
    last = {}

    def step(frame_idx, rows):
        out = []
        for k, d in zip(rows.column("kind").to_pylist(), rows.column("det_ord").to_pylist(), strict=True):
            if k not in last or (frame_idx + d) % 7 == 0:
                last[k] = last.get(None, 0)
                last[None] = last[k] + 1
            out.append(last[k])
        return out

    return step


def local(function):
    """The function as workers can have it: they cannot import the tests."""
    import types

    return types.FunctionType(function.__code__, {"zip": zip}, function.__name__)


def rows_of(seed=3, clips=("c", "d", None), frames=120, skip=0.2):
    rng = random.Random(seed)
    out = []
    for c in clips:
        for f in range(frames):
            if rng.random() < skip:
                continue
            out += [(c, f, d, rng.choice("abc"), 99) for d in range(rng.randrange(1, 5))]
    rng.shuffle(out)
    return out


def plainly(rows, make):
    """Clip by clip, frame by frame."""
    want = {}
    for clip in {r[0] for r in rows}:
        tracker = make()
        own = sorted((r for r in rows if r[0] == clip), key=lambda r: r[1:3])
        for f in sorted({r[1] for r in own}):
            now = [r for r in own if r[1] == f]
            batch = pa.RecordBatch.from_pydict({"det_ord": [r[2] for r in now], "kind": [r[3] for r in now]})
            want.update({(clip, f, r[2]): i for r, i in zip(now, tracker(f, batch), strict=True)})
    return want


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_ids_do_not_depend_on_batches(spark, size):
    rows, make = rows_of(), local(nearest)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        got = {(r.clip_id, r.frame_idx, r.det_ord): r.track_id for r in tracked(spark.createDataFrame(rows, SCHEMA).repartition(5), make).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == plainly(rows, nearest)


@pytest.mark.parametrize("most", [1, 3])
def test_pieces_give_the_same_tracks(spark, most):
    rows = rows_of(seed=8, skip=0.6, frames=300)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plainly(rows, lambda: ByValue("kind", most))
    whole = {(r.clip_id, r.frame_idx, r.det_ord): r.track_id for r in tracked(df, lambda: ByValue("kind", most)).collect()}
    assert whole == want
    cut = {(r.clip_id, r.frame_idx, r.det_ord): r.track_id for r in tracked(df, lambda: ByValue("kind", most), forgets_after=most).collect()}
    assert len({i // LOCAL for i in cut.values()}) > 3
    # The ids differ, the tracks do not.
    pairs = {(k[0], want[k], cut[k]) for k in want}
    assert len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs}) and cut.keys() == want.keys()


def test_null_frames_and_values_and_empty_tables(spark):
    rows = [("c", None, 0, "a", 1), ("c", 2, 0, None, 1), ("c", 2, 1, "a", 1), (None, 2, 0, "a", 1)]
    for forgets in (None, 2):
        got = sorted((str(r.clip_id), str(r.frame_idx), r.det_ord, r.track_id) for r in tracked(spark.createDataFrame(rows, SCHEMA), lambda: ByValue("kind", 1), forgets).collect())
        at = 0 if forgets is None else 2 * LOCAL
        assert got == [("None", "2", 0, at), ("c", "2", 0, None), ("c", "2", 1, at), ("c", "None", 0, None)]
        assert tracked(spark.createDataFrame([], SCHEMA), lambda: ByValue("kind", 1), forgets).count() == 0


def test_a_tracker_must_answer_every_row(spark):
    with pytest.raises(Exception, match="gave 0 ids"):
        tracked(spark.createDataFrame(rows_of(frames=3), SCHEMA), lambda: lambda frame_idx, rows: []).count()


def test_late_rows_outlive_trimmed_progress_and_restarts(spark, tmp_path):
    """Every micro-batch from the third on drops rows (Spark tells late rows by the watermark of the batch before); it keeps the progress of two."""
    schema = "k long, ts_s double"
    key = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(key)
    spark.conf.set(key, 2)
    late = LateRows(spark, f"{tmp_path}/late")
    spark.streams.addListener(late)
    want, kept = 0, 0
    try:
        for part in range(2):
            for n in range(6):
                i = part * 6 + n
                own = [(i * 10, 10.0 * (i + 1))] + [(i * 10 + 1 + j, 0.5) for j in range(i if i else 0)]
                want += len(own) - 1 if i > 1 else 0
                spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:02d}")
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            query = run_to(timed(source, "ts_s", 1.0).dropDuplicatesWithinWatermark(["k"]), str(tmp_path))
            late.wait(query)
            kept += late_rows(query)
    finally:
        spark.streams.removeListener(late)
        spark.conf.set(key, before)
    found = late_totals(spark, f"{tmp_path}/late").collect()
    assert len(found) == 1 and found[0].late_rows == want and kept < want
