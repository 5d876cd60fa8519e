"""What a stream's steps in Python hold at once is bounded, whatever the session's batches are."""

from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def _batch_size():
    """An Arrow UDF that gives rows and bytes of the batch that a row came in."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([{"rows": len(batch), "bytes": batch.nbytes}] * len(batch), pa.struct([("rows", pa.int64()), ("bytes", pa.int64())]))

    return F.arrow_udf(run, "rows long, bytes long").asNondeterministic()


@pytest.fixture
def default_session(spark):
    """A session with Spark's own bounds: 10,000 rows, 64 MB."""
    s = spark.newSession()
    s.conf.set(ROWS, "10000")
    s.conf.set(BYTES, "64m")
    return s


@pytest.mark.parametrize("size, rows", [(3, 6000), (20_000, 1000)])
def test_a_stream_hands_python_small_batches(default_session, tmp_path, size, rows):
    from mailsift.streaming.score import run_to_table

    s = default_session
    s.range(0, rows, 1, 1).write.parquet(f"{tmp_path}/in")
    src = s.readStream.schema("id long").parquet(f"{tmp_path}/in")
    out = src.select("id", _batch_size()(F.repeat(F.lit("x"), size)).alias("seen")).select("id", "seen.*")
    run_to_table(out, f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()
    got = s.read.parquet(f"{tmp_path}/table")
    assert got.select("id").distinct().count() == got.count() == rows
    most = got.agg(F.max("rows"), F.max("bytes")).first()
    assert most[0] <= 1024 and most[1] <= (4 << 20) + 2 * size + 8 * 1024
    assert (s.conf.get(ROWS), s.conf.get(BYTES)) == ("10000", "64m")  # the user's session keeps its own


def test_smaller_bounds_stay(default_session):
    from mailsift.batches import SESSION_BATCH, bound_batches

    s = default_session
    for given, rows, size in ((("100", "1m"), "100", "1m"), (("0", "16777216"), str(SESSION_BATCH[ROWS]), str(SESSION_BATCH[BYTES])),
                              (("5000", "67108864b"), str(SESSION_BATCH[ROWS]), str(SESSION_BATCH[BYTES])),
                              (("1024", "4096KB"), "1024", "4096KB")):
        s.conf.set(ROWS, given[0])
        s.conf.set(BYTES, given[1])
        bound_batches(s)
        assert (s.conf.get(ROWS), s.conf.get(BYTES)) == (rows, size)


def test_delivered_streams_are_bounded_too(spark, tmp_path, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from mailsift.operators.model import Linear, contract
    from mailsift.plans import score
    from mailsift.plans.train import Trained

    model = Linear(Vectors.dense([0.0] * 9), 1.0)
    trained = Trained(model, 1, 8, contract(model, 1, 8, "hashing-8"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m1").write_bytes(b"Subject: a\n\nb")
    seen = []
    monkeypatch.setattr(score, "deliver_maildir", lambda batch, base: seen.append(
        (batch.count(), *(int(batch.sparkSession.conf.get(k)) for k in (ROWS, BYTES)))))
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "10000")
    try:
        score.filter_files_stream(spark, trained, [str(tmp_path / "in")], f"{tmp_path}/out", mode="deliver").awaitTermination()
        assert spark.conf.get(ROWS) == "10000"
    finally:
        spark.conf.set(ROWS, before)
    assert seen == [(1, 1024, 4 << 20)]
