"""A5 as running statistics: after several batches, a restart and a replay the counts equal the batch job's."""

from pyspark.sql import functions as F

SCHEMA = "score_text string, spam boolean"


def _scored(spark, k):
    return spark.createDataFrame(
        [(f"{((i * 17 + k * 5) % 101) / 100:.4f}", None if i % 11 == 0 else i % 3 == 0) for i in range(40)]
        + [("", True), ("x", False), (None, True), ("1.5", True)], SCHEMA)


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_running_counts_equal_the_sweep(spark, tmp_path):
    from mailsift.operators.measure import bin_counts, threshold_sweep
    from mailsift.streaming.score import stream_table
    from mailsift.streaming.statistics import counts_sink, read_counts, run_statistics, running_sweep, versions

    drop, out, checkpoint = (str(tmp_path / n) for n in ("drop", "out", "checkpoint"))
    assert _rows(running_sweep(spark, out, 10)) == _rows(threshold_sweep(spark, _scored(spark, 0).limit(0), F.col("spam"), steps=10))
    so_far = None
    for k in range(4):  # every round starts the query anew from its checkpoint
        _scored(spark, k).coalesce(1).write.mode("append").parquet(drop)
        so_far = _scored(spark, k) if so_far is None else so_far.unionByName(_scored(spark, k))
        src = stream_table(spark, drop, SCHEMA, max_files_per_trigger=1)
        run_statistics(src, F.col("spam"), out, checkpoint, steps=10).awaitTermination()
        assert _rows(running_sweep(spark, out, 10)) == _rows(threshold_sweep(spark, so_far, F.col("spam"), steps=10))
    newest = versions(spark, out)[-1]
    assert versions(spark, out) == [newest - 1, newest]
    before = _rows(read_counts(spark, out))
    counts_sink(out)(bin_counts(so_far, F.col("spam"), steps=10), newest)  # the batch is replayed
    assert _rows(read_counts(spark, out)) == before and versions(spark, out) == [newest - 1, newest]
    (tmp_path / "out" / f"batch_id={newest}" / "_SUCCESS").unlink()  # a replay that has not ended
    assert versions(spark, out) == [newest - 1]


def test_a_run_with_a_new_checkpoint_replaces_later_versions(spark, tmp_path):
    from mailsift.operators.measure import bin_counts
    from mailsift.streaming.statistics import counts_sink, read_counts, versions

    out = str(tmp_path / "out")
    for k in (5, 6):
        counts_sink(out)(bin_counts(_scored(spark, k), F.col("spam")), k)
    fresh = bin_counts(_scored(spark, 0), F.col("spam"))
    counts_sink(out)(fresh, 0)
    assert versions(spark, out) == [0] and _rows(read_counts(spark, out)) == _rows(fresh)


def test_the_counts_of_all_partitions_are_not_one_tasks(spark, tmp_path):
    """One file is written, by a task of its own: what is counted before it stays in as many tasks as it was."""
    from mailsift.streaming.statistics import counts_sink, read_counts

    def task():
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    rows = spark.range(0, 8, 1, 8).select(F.col("id").cast("int").alias("bin"), F.lit(True).alias("pos"),
                                          F.udf(task, "int")().cast("long").alias("n"))
    counts_sink(str(tmp_path / "c"))(rows, 0)
    assert sorted(r.n for r in read_counts(spark, str(tmp_path / "c")).collect()) == list(range(8))
    assert len(list((tmp_path / "c/batch_id=0").glob("*.parquet"))) == 1
