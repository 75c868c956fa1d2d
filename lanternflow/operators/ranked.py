"""Places of rows within their group, by range partitioning: no task and no window holds a group.

Rows are dealt to ranges of (group, order) and sorted there; how many rows of a
group lie in the ranges before is known from one count for each range, so a
row's place is its place in its range plus that.  A group may span as many
ranges as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, among those of equal ``keys`` by ``order``.

    The sorted rows are written once to the shared folder, so both the counts
    and the places are of one and the same order, and a lost executor costs a
    read.  Ties are ordered by the range they fall into.  Null keys are a group.
    """
    from lanternflow.streaming.debounce import work_dir

    spark = rows.sparkSession
    path = f"{work_dir(spark)}/ranked"
    sorted_rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    sorted_rows.withColumn("_ranked_row", F.monotonically_increasing_id()).write.parquet(path)
    # The upper bits of a row's number are its range.
    held = spark.read.parquet(path).withColumn("_ranked_range", F.shiftright("_ranked_row", 33))
    before = Window.partitionBy(*keys).orderBy("_ranked_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(*keys, "_ranked_range").agg(F.count("*").alias("_ranked_n"), F.min("_ranked_row").alias("_ranked_first"))
    offsets = counts.withColumn("_ranked_before", F.coalesce(F.sum("_ranked_n").over(before), F.lit(0)))
    here = offsets.select(*[F.col(c).alias(f"_ranked_key{i}") for i, c in enumerate(keys)], F.col("_ranked_range").alias("_ranked_at"), "_ranked_first", "_ranked_before")
    same = F.col("_ranked_range") == F.col("_ranked_at")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_ranked_key{i}"))
    placed = held.join(here, same).withColumn(name, F.col("_ranked_row") - F.col("_ranked_first") + F.col("_ranked_before") + 1)
    return placed.select(*rows.columns, name)


def medians(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Exact medians of several columns of each group, as ``median_<column>``; nulls are passed over."""
    long = rows.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "_name", "_value").where("_value IS NOT NULL")
    groups = [*keys, "_name"]
    size = long.groupBy(*groups).agg(F.count("*").alias("_size")).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(groups)], "_size")
    same = F.lit(True)
    for i, c in enumerate(groups):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    half = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    middle = ranked(long, groups, [F.col("_value")], "_place").join(size, same).where((F.col("_place") == half[0]) | (F.col("_place") == half[1]))
    return middle.groupBy(*keys).agg(*[F.avg(F.when(F.col("_name") == v, F.col("_value"))).alias(f"median_{v}") for v in values])
