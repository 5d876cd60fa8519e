"""A5 as running statistics: shadow-mode counts kept up to date while mail is scored.

The counts per (bin, truth) are the state of a streaming aggregate, so they are as many rows however much mail has gone
through. Each batch writes the whole of them as a version ``batch_id=<n>``; a batch that is replayed starts from the
checkpointed state and overwrites its own version. Any threshold report is read from the newest whole version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.measure import bin_counts, sweep_counts

#: What Spark leaves in a folder when every task's rows are in.
DONE = "_SUCCESS"
#: Whole versions that are kept; a reader of the one before may still be at work.
KEPT = 2


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, out_path: str) -> list[int]:
    """Numbers of the versions that were written whole, rising. There are at most a few."""
    fs, at = _folder(spark, out_path)
    if not fs.exists(at):
        return []
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{out_path}/batch_id=*/{DONE}"))
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done or [])


def counts_sink(out_path: str):
    """foreachBatch writer of whole counts: the batch's version is overwritten, versions before the last two go.

    Versions after it belong to a run whose checkpoint was given up; they go as well, so the newest is always this one.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # a shuffle of a few rows: coalesced, the aggregate of all partitions would be one task's
        batch.repartition(1).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(
            f"{out_path}/batch_id={batch_id}")
        found = versions(spark, out_path)
        before = [v for v in found if v < batch_id]
        for v in before[:len(before) - KEPT + 1] + [v for v in found if v > batch_id]:
            fs, at = _folder(spark, f"{out_path}/batch_id={v}")
            fs.delete(at, True)

    return write


def run_statistics(scored: DataFrame, truth: Column, out_path: str, checkpoint: str, text_col: str = "score_text",
                   steps: int = 20, available_now: bool = True) -> StreamingQuery:
    """Start counting a stream of scored mail by (bin, truth) into ``out_path``."""
    w = bin_counts(scored, truth, text_col, steps).writeStream.outputMode("complete").foreachBatch(
        counts_sink(out_path)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def read_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest whole counts (``bin``, ``pos``, ``n``); none before the first batch."""
    found = versions(spark, out_path)
    if not found:
        return spark.createDataFrame([], "bin int, pos boolean, n long")
    return spark.read.schema("bin int, pos boolean, n long").parquet(f"{out_path}/batch_id={found[-1]}")


def running_sweep(spark: SparkSession, out_path: str, steps: int = 20) -> DataFrame:
    """``threshold_sweep`` of all mail counted so far."""
    return sweep_counts(spark, read_counts(spark, out_path), steps)
