"""The spaced top-k by local rounds: no array and no task holds a clip.

Greedy choice takes the best hit, passes over all within the gap, and goes on.
Whether a hit is taken depends only on better hits within the gap of it, so
stretches of time can be settled apart: in a round, each block of ``BLOCK``
gaps sees its hits and those one gap around it, and settles every hit whose
better neighbours are settled.  What depends on an unsettled hit over the border
waits for the next round, whose blocks are shifted by half.  A round settles at
least the best hit left; as a rule two or three settle all.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Gaps of a block; parts of a clip whose best k are taken before those of the clip.
BLOCK, PARTS = 64, 64
ORDER = ["neg", "ts_s", "ord", "frame_idx", "person_track_id"]


def settle(rows: Iterator[tuple[float, bool, bool]], gap: float) -> Iterator[str]:
    """``taken``, ``gone`` or ``open`` for hits (ts, own, taken before) from the best to the worst; hits that are not the block's own stay open unless a better one is taken."""
    taken: list[float] = []
    waiting: list[float] = []

    def near(found: list[float], ts: float) -> bool:
        i = bisect_left(found, ts)
        return any(abs(ts - found[j]) < gap for j in (i - 1, i) if 0 <= j < len(found))

    for ts, own, before in rows:
        if before:
            insort(taken, ts)
            yield "taken"
        elif near(taken, ts):
            yield "gone"
        elif near(waiting, ts) or not own:
            insort(waiting, ts)
            yield "open"
        else:
            insort(taken, ts)
            yield "taken"


def _round(hits: DataFrame, group: str, gap: float, shift: float) -> DataFrame:
    width = gap * BLOCK
    at = F.col("ts_s") + F.lit(shift)
    own = F.floor(at / F.lit(width))
    # A little more than the gap, as borders are rounded.
    reach = F.lit(gap * 1.001)
    blocks = F.sequence(F.floor((at - reach) / F.lit(width)), F.floor((at + reach) / F.lit(width)))
    dealt = hits.withColumn("own_block", own).withColumn("block", F.explode(blocks)).repartition(group, "block").sortWithinPartitions(group, "block", *ORDER)
    columns = [group, *ORDER, "taken"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for r in pdf.itertuples(index=False, name=None))
        for (_, block), near in groupby(rows, key=lambda r: (r[0], r[-1])):
            here = list(near)
            out = [(*r[:-3], s == "taken") for r, s in zip(here, settle(((r[2], r[-2] == block, r[-3]) for r in here), gap), strict=True) if r[-2] == block and s != "gone"]
            if out:
                yield pd.DataFrame(out, columns=columns)

    schema = hits.select(*columns).schema
    return dealt.select(*columns, "own_block", "block").mapInPandas(run, schema)


def spaced(hits: DataFrame, group: str, gap: float) -> DataFrame:
    """All hits (``group`` and ``ORDER``) that the greedy choice takes."""
    from lanternflow.streaming.debounce import work_dir

    spark, top, shift, k = hits.sparkSession, work_dir(hits.sparkSession), 0.0, 0
    now = hits.select(group, *ORDER, F.lit(False).alias("taken"))
    while True:
        k += 1
        _round(now, group, gap, shift).write.parquet(f"{top}/round-{k}")
        now = spark.read.parquet(f"{top}/round-{k}")
        if now.where("NOT taken").isEmpty():
            return now.drop("taken")
        shift = gap * BLOCK / 2 - shift


def first_of_each(hits: DataFrame, group: str, k: int) -> DataFrame:
    """The k first of each group by ``ORDER``: first those of its parts, so that a window holds no more than ``PARTS`` * k rows of a group."""
    part = F.pmod(F.xxhash64(*ORDER), F.lit(PARTS))
    kept = hits.withColumn("part", part)
    for keys in ([group, "part"], [group]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER))
        kept = kept.withColumn("place", place).where(F.col("place") <= k)
    return kept.drop("part", "place")
