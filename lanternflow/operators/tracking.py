"""A user's tracker over detections: frame by frame in order, as a stream of batches.

Rows are dealt by clip and sorted there by frame; a worker reads them batch by
batch, gives the tracker one whole frame at a time and holds nothing else but
the tracker's own state.  A tracker's state is sequential, so a clip is one
task; where a tracker says how long it remembers, clips are cut at pauses longer
than that, and the pieces are tracked apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Takes a frame's index and its rows, and gives an id (or None) for each row.
Tracker = Callable[[int, pa.RecordBatch], Sequence[int | None]]
#: Ids of a piece stay below this; the piece's first frame is above.
LOCAL = 1 << 20
#: Slots in a block: pieces are found in blocks, and one row for each block is carried on.
BLOCK = 4096
#: Rows sent on at once, about.
ROWS = 2000
KEY = ("clip_id", "_piece", "frame_idx")


def pieces(rows: DataFrame, forgets_after: int) -> DataFrame:
    """(clip_id, slot, piece): the slots of ``forgets_after`` frames that hold rows, and the first frame of their piece.

    A piece is a run of slots without an empty one between, so rows of two
    pieces are more than ``forgets_after`` frames apart.
    """
    slot = F.floor(F.col("frame_idx") / F.lit(forgets_after)).cast("long")
    used = rows.where("frame_idx IS NOT NULL").select("clip_id", slot.alias("slot")).distinct()
    mark = lambda at, here: F.struct(at.alias("slot"), F.lit(here).alias("here"))
    marks = used.select("clip_id", F.explode(F.array(mark(F.col("slot"), True), mark(F.col("slot") + 1, False))).alias("m"))
    held = marks.groupBy("clip_id", "m.slot").agg(F.bool_or("m.here").alias("here"), F.bool_or(~F.col("m.here")).alias("follows")).where("here")
    held = held.select("clip_id", "slot", F.floor(F.col("slot") / F.lit(BLOCK)).alias("block"), F.when(~F.col("follows"), F.col("slot")).alias("first"))
    inside = Window.partitionBy("clip_id", "block").orderBy("slot")
    before = Window.partitionBy("clip_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.groupBy("clip_id", "block").agg(F.max("first").alias("last")).withColumn("carried", F.last("last", ignorenulls=True).over(before))
    own = held.withColumn("own", F.last("first", ignorenulls=True).over(inside)).alias("h")
    c = carried.alias("c")
    both = own.join(c, F.col("h.clip_id").eqNullSafe(F.col("c.clip_id")) & (F.col("h.block") == F.col("c.block")))
    return both.select("h.clip_id", "slot", (F.coalesce("own", "carried") * F.lit(forgets_after)).alias("piece"))


def _worker(make_tracker: Callable[[], Tracker]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracker: Tracker | None = None
        of: tuple | None = None
        now: tuple | None = None
        held: list[pa.RecordBatch] = []
        out: list[pa.RecordBatch] = []

        def settle() -> None:
            nonlocal tracker, of
            frame = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            ids: list[int | None] = [None] * frame.num_rows
            if now[2] is not None:
                if tracker is None or now[:2] != of:
                    tracker, of = make_tracker(), now[:2]
                local = list(tracker(now[2], frame.drop_columns(["_piece"])))
                if len(local) != frame.num_rows:
                    raise ValueError(f"the tracker gave {len(local)} ids for {frame.num_rows} rows")
                if any(x is not None and not 0 <= x < LOCAL for x in local):
                    raise ValueError(f"ids of a tracker lie between 0 and {LOCAL - 1}")
                ids = [None if x is None else now[1] * LOCAL + int(x) for x in local]
            rest = frame.drop_columns(["_piece"])
            out.append(pa.RecordBatch.from_arrays([*rest.columns, pa.array(ids, pa.int64())], names=[*rest.schema.names, "track_id"]))

        def sent() -> pa.RecordBatch:
            both = pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            out.clear()
            return both

        for b in batches:
            if not b.num_rows:
                continue
            codes = np.stack([pc.dictionary_encode(b.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in KEY])
            cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for i, j in pairwise(cuts):
                key = tuple(b.column(c)[i].as_py() for c in KEY)
                if held and key != now:
                    settle()
                    if sum(x.num_rows for x in out) >= ROWS:
                        yield sent()
                now = key
                held.append(b.slice(i, j - i))
        if held:
            settle()
        if out:
            yield sent()

    return run


def tracked(detections: DataFrame, make_tracker: Callable[[], Tracker], forgets_after: int | None = None) -> DataFrame:
    """``detections`` (clip_id, frame_idx, det_ord and more) with the tracker's ``track_id``, in place of any they had.

    ``make_tracker`` is called for each clip, or piece of one, and its tracker
    once for each frame that has rows, in order, with the rows by ``det_ord``.
    Ids do not depend on batches or partitions.  With ``forgets_after``, the
    number of frames after which the tracker knows nothing any more, clips are
    cut at longer pauses; a piece's ids then begin at its first slot's frame times
    ``LOCAL``.  Without, a clip's ids are the tracker's own.

    A null clip is a clip; rows without a frame have no id and do not reach the
    tracker; a row the tracker gives None has none (``detect.objects`` drops it).
    A frame's rows are held together.  An empty table gives an empty table.
    """
    rows = detections.drop("track_id")
    if forgets_after is None:
        cut = rows.withColumn("_piece", F.lit(0).cast("long"))
    else:
        if forgets_after < 1:
            raise ValueError("a tracker remembers one frame at least")
        found = pieces(rows, forgets_after).select(F.col("clip_id").alias("_clip"), F.col("slot").alias("_slot"), F.col("piece").alias("_piece"))
        slot = F.floor(F.col("frame_idx") / F.lit(forgets_after)).cast("long")
        cut = rows.join(found, rows["clip_id"].eqNullSafe(F.col("_clip")) & (slot == F.col("_slot")), "left").drop("_clip", "_slot")
    dealt = cut.repartition("clip_id", "_piece").sortWithinPartitions("clip_id", "_piece", "frame_idx", "det_ord")
    return dealt.mapInArrow(_worker(make_tracker), T.StructType([*rows.schema.fields, T.StructField("track_id", T.LongType())]))


class ByValue:
    """The plainest tracker: rows of one value of a column are one track until it is missing for more than ``most`` frames."""

    def __init__(self, column: str, most: int) -> None:
        self.column, self.most = column, most
        self.seen: dict = {}
        self.n = 0

    def __call__(self, frame_idx: int, rows: pa.RecordBatch) -> list[int | None]:
        self.seen = {v: x for v, x in self.seen.items() if frame_idx - x[1] <= self.most}
        ids: list[int | None] = []
        for v in rows.column(rows.schema.get_field_index(self.column)).to_pylist():
            if v is None:
                ids.append(None)
                continue
            if v not in self.seen:
                self.seen[v] = (self.n, frame_idx)
                self.n += 1
            self.seen[v] = (self.seen[v][0], frame_idx)
            ids.append(self.seen[v][0])
        return ids
