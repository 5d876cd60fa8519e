"""Arrow batches taken apart by bytes.

A session sends up to ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows (10,000 by default) and
``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB) to Python at once. Turned into Python objects a slice at a time, a
batch costs its own bytes and those of its result. A session of our own, as each stream has one, sends less
(``bound_batches``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of one slice; a larger value comes alone.
SLICE_BYTES = 1 << 20
#: What a session's batches are bounded to. Each step in Python holds one, its result and what the JVM has of both beside
#: its heap, and a task has all of its steps at work at once.
SESSION_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 1024}


def _number(setting: str) -> int:
    """A setting of rows or bytes: ``1000``, ``67108864b``, ``64m``, ``64MB``."""
    n, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(n) << 10 * " kmgtp".index(unit or " ")


def bound_batches(spark: SparkSession) -> None:
    """Lowers a session's batches to ``SESSION_BATCH``; a smaller bound stays. For sessions of our own: the one that a
    ``foreachBatch`` function gets is the stream's copy of the user's, which keeps its settings."""
    for key, most in SESSION_BATCH.items():
        if not 0 < _number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def slices(values: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of a string or binary array, in order; a larger value is a range of its own."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(values), 0).to_pylist()):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(values):
        yield start, len(values)


def _joined(parts: list[pa.Array]) -> pa.Array:
    """One array of the parts, which go as they are joined: a struct without nulls is joined field by field."""
    kind = parts[0].type
    if not pa.types.is_struct(kind):
        return pa.concat_arrays(parts)
    columns = [list(c) for c in zip(*(p.flatten() for p in parts), strict=True)]
    parts.clear()
    out = []
    for column in columns:
        out.append(pa.concat_arrays(column))
        column.clear()
    return pa.StructArray.from_arrays(out, fields=list(kind))


def by_slices(work: Callable[[list], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """The function of an iterator ``arrow_udf`` that hands ``work`` one slice of a batch at a time."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [work(batch.slice(lo, hi - lo).to_pylist()) for lo, hi in slices(batch)]
            del batch
            yield _joined(parts or [work([])])
            parts.clear()

    return run
