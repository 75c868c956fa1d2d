"""Connected components of a link table, without collecting links.

Alternates the large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"): every round is two aggregations and
joins, and the links end as stars around the smallest member of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.llm import core

#: Links that one task takes without a shuffle (a few MB).
SMALL = 200_000


def _large_star(links: DataFrame, small: bool) -> DataFrame:
    """Each node's larger neighbours move to the smallest of the node and its neighbours.  Gives a > b."""
    both = _fewer(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), small)
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame, small: bool) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of these.  Takes and gives a > b."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _fewer(moved.union(low.select("a", F.col("low").alias("b"))), small).where("a <> b").distinct()


def _fewer(df: DataFrame, small: bool) -> DataFrame:
    return df.coalesce(1) if small else df


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(a, b): each linked node but the smallest of its component, and that smallest one.

    ``links`` has two long columns a and b; their order and repeats do not
    matter and links of a node with itself are ignored.  A table of at most
    ``SMALL`` links is one partition, which spares each round its shuffles.
    """
    now = core.stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    for _ in range(most_rounds):
        small = state[0] <= SMALL
        old, now = now, core.stored(_small_star(_large_star(now, small), small), "links")
        core.free(old)
        last, state = state, _state(now)
        if state == last:
            return now
    raise RuntimeError("components did not settle")


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)
