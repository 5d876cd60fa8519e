"""Shared plumbing of the training-data operators: Arrow UDFs over text and bounded memos."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: UTF-8 bytes of text that one call of a worker function gets at most (a longer text comes alone).
SLICE_BYTES = 4 << 20


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, in order; a longer text is a range of its own."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def text_udf(make: Callable[[], Callable], schema: str, text: Column | str, repeatable: bool = True,
             limit: int = SLICE_BYTES) -> Column:
    """A struct column computed from a text column by batches.

    ``make()`` runs once per task and returns ``work(list[str | None]) -> list of columns`` in the
    order of ``schema``. Only the text crosses into Python; other columns stay in the JVM.
    ``repeatable=False`` keeps the optimizer from evaluating it once more above a filter.
    """
    fields = T.StructType.fromDDL(schema)
    names = fields.names
    kinds = [arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            parts = []
            for lo, hi in slices(batch, limit):
                columns = work(batch.slice(lo, hi - lo).to_pylist())
                parts.append(pa.StructArray.from_arrays(
                    [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names))
            empty = pa.StructArray.from_arrays([pa.array([], type=k) for k in kinds], names)
            yield pa.concat_arrays(parts) if parts else empty

    udf = F.arrow_udf(run, fields)
    return (udf if repeatable else udf.asNondeterministic())(F.col(text) if isinstance(text, str) else text)


class Memo(dict):
    """A bounded memo in two generations: when the young one is full it becomes the old one, whose entries come back
    when asked for; what nobody asks for goes. Long keys are not kept."""

    def __init__(self, compute: Callable, most: int = 100_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest, self.old = compute, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


#: What a worker process keeps from task to task, by name and content.
_HELD: dict = {}


def held(key: tuple, make: Callable):
    """``make()``, once per worker process and key."""
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores behind it as it takes to be no column's name in any of ``tables``."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_text(column: str) -> Column:
    """crc32 of a column's text form, as the folds of the contracts use it."""
    return F.crc32(F.col(column).cast("string"))
