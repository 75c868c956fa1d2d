"""Rows that streams drop as later than the watermark, counted for good.

Spark keeps the progress of the last micro-batches only.  A listener sees all
of them; what it counts goes to a small table beside the stream's checkpoint,
one row for each micro-batch that dropped any, so that totals outlive the
process.  A micro-batch that is run again after a failure is counted once.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "query_id string, batch_id long, late_rows long"


class LateRows(StreamingQueryListener):
    """Writes the late rows of every query of the session to a table at ``path``, as it runs.

    Add it with ``spark.streams.addListener`` before the query starts; ``wait``
    returns when all of a query's progress has come.  ``path`` is in a folder that
    outlives the process, for instance beside the checkpoint.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.over: set[str] = set()
        self.changed = threading.Condition()
        self.spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        n = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        if n > 0:
            self.spark.createDataFrame([(str(p.id), int(p.batchId), int(n))], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.over.add(str(event.runId))
            self.changed.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Wait for the last progress of a query that has ended."""
        with self.changed:
            if not self.changed.wait_for(lambda: str(query.runId) in self.over, seconds):
                raise TimeoutError("the end of the query was not announced")


def late_totals(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, late_rows): what each query has dropped, over all its runs.  A query keeps its id with its checkpoint."""
    batches = spark.read.schema(SCHEMA).parquet(path).groupBy("query_id", "batch_id").agg(F.max("late_rows").alias("n"))
    return batches.groupBy("query_id").agg(F.sum("n").alias("late_rows"))


def replay_late(rows: DataFrame, keys: list[str], delay_s: float = 2.0) -> DataFrame:
    """Play stored rows (``ts_s`` and keys) twice through a stream that keeps each once, with a restart between; count the late ones.

    The second time, what lies before the watermark is late.  One row: late_rows.
    """
    from lanternflow.streaming.debounce import run_to, timed, work_dir

    spark = rows.sparkSession
    top = work_dir(spark)
    late = LateRows(spark, f"{top}/late")
    spark.streams.addListener(late)
    try:
        for _ in range(2):
            rows.select(*keys, "ts_s").write.mode("append").parquet(f"{top}/in")
            stream = timed(spark.readStream.schema(rows.select(*keys, "ts_s").schema).parquet(f"{top}/in"), "ts_s", delay_s)
            late.wait(run_to(stream.dropDuplicatesWithinWatermark(keys), top))
    finally:
        spark.streams.removeListener(late)
    return late_totals(spark, f"{top}/late").agg(F.coalesce(F.sum("late_rows"), F.lit(0)).alias("late_rows"))
