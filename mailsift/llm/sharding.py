"""Sharding by histogram sort: near-equal bytes, with one exchange.

The sort key is the text's hash and then the id's hash, as hexadecimal digits, so equal texts stand together. Exact
bytes and rows are counted below the boundaries of a grid over the key (cells); where a shard's border should fall inside a
cell and no boundary is near enough, that cell alone gets a finer grid, and so on until every border lies within the
tolerance. Cells of many rows (copies of one text, mostly) are then split further, down into the digits of the id, so that no
task numbers more than a small share of the rows; no border moves for that. Only then rows move, once, to their cells; slots number them across cells. Equal texts share a shard
unless their group alone is too large for the tolerance. All of it is DataFrame operations.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import unused
from mailsift.session import scratch_path

SHARDS = 40
#: Bytes of a row besides its text.
ROW_BYTES = 16
#: A border may miss its place by this share of a shard's bytes.
TOLERANCE = 0.005
#: Digits of the key that one refinement adds, and digits of the whole key.
DIGITS, KEY_DIGITS = 3, 32
#: Digits of the text's hash, which equal texts share, and digits that a refinement for rows adds within them.
TEXT_DIGITS, ROW_DIGITS = 16, 2
#: A cell may hold this many rows, or 1/CELL_SHARE of all if that is more.
CELL_ROWS, CELL_SHARE = 1_000, 1_024


@dataclass(frozen=True)
class Cell:
    """All rows whose key begins with ``prefix``."""

    prefix: str
    size: int
    rows: int


def key_of(id_col: str, text: str) -> Column:
    """The sort key: 16 digits of the text's hash, 16 of the id's. Null and empty texts are one group."""
    part = [F.lpad(F.hex(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(seed))), 16, "0")
            for c, seed in ((text, 1), (id_col, 2))]
    return F.concat(*part)


def _cells(rows: DataFrame, digits: int) -> list[Cell]:
    found = rows.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    return [Cell(r.prefix, r["size"], r["rows"]) for r in found.collect()]


def borders(cells: list[Cell], shards: int) -> tuple[list[int], list[tuple[int, float]]]:
    """For each border between shards: the boundary (number of cells before it) nearest to its place; and
    (cell, miss in bytes) where the place lies inside a cell."""
    ends, total = [0], 0
    for c in cells:
        total += c.size
        ends.append(total)
    at, inside = [], []
    for k in range(1, shards if cells else 1):
        goal = total * k / shards
        i = max(1, min(len(cells), bisect_left(ends, goal)))
        at.append(i if ends[i] - goal <= goal - ends[i - 1] else i - 1)
        inside.append((i - 1, min(abs(ends[i] - goal), abs(goal - ends[i - 1]))))
    return at, inside


def finer_depth(cell: Cell, allowed: int) -> int:
    """Digits of the grid that splits a cell of more than ``allowed`` rows: copies of a text part by their ids only, and
    then into as many cells as their number asks for."""
    n = len(cell.prefix)
    if n < TEXT_DIGITS:
        return min(TEXT_DIGITS, n + ROW_DIGITS)
    return min(KEY_DIGITS, n + max(1, math.ceil(math.log(cell.rows / allowed, 16))))


def refine(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[Cell]:
    """Cells in key order, fine enough for every border. ``rows``: (key, size).

    Each round collects 16 ** DIGITS counts for each border at most, whatever the table's size.
    """
    cells = sorted(_cells(rows, DIGITS), key=lambda c: c.prefix)
    while cells:
        allowed = tolerance * sum(c.size for c in cells) / shards
        wide = sorted({cells[i].prefix for i, miss in borders(cells, shards)[1]
                       if miss > allowed and cells[i].rows > 1 and len(cells[i].prefix) < KEY_DIGITS})
        if not wide:
            break
        finer = [c for n in sorted({len(p) for p in wide}) for c in _cells(
            rows.where(F.substring("key", 1, n).isin([p for p in wide if len(p) == n])), min(KEY_DIGITS, n + DIGITS))]
        cells = sorted([c for c in cells if c.prefix not in wide] + finer, key=lambda c: c.prefix)
    return cells


def lighter(rows: DataFrame, cells: list[Cell], most: int) -> dict[str, list[Cell]]:
    """For each cell of more than ``most`` rows the cells it is split into, in key order; none has more unless its rows share
    one key (equal rows). Borders stay where they are.

    A round collects 16 ** ROW_DIGITS counts a heavy cell at most, or 16 for each ``most`` rows.
    """
    found, open_ = {}, {c.prefix: c for c in cells if c.rows > most and len(c.prefix) < KEY_DIGITS}
    parent = {p: p for p in open_}
    while open_:
        steps: dict[tuple[int, int], list[str]] = {}
        for p, c in open_.items():
            steps.setdefault((len(p), finer_depth(c, most)), []).append(p)
        heavy = {}
        for (n, depth), own in sorted(steps.items()):
            for c in _cells(rows.where(F.substring("key", 1, n).isin(own)), depth):
                top = parent[c.prefix[:n]]
                if c.rows > most and len(c.prefix) < KEY_DIGITS:
                    heavy[c.prefix], parent[c.prefix] = c, top
                else:
                    found.setdefault(top, []).append(c)
        open_ = heavy
    return {p: sorted(own, key=lambda c: c.prefix) for p, own in found.items()}


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text",
          tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with shard_size (bytes), shard (0 to ``shards`` - 1) and shard_slot (gapless from 0 in each shard, in key order).

    Null texts have no bytes; null ids sort by the hash of an empty one. Repeated rows get slots of their own. An empty
    table gives no rows. Columns of ``docs`` pass through as they are; should one have an added column's name, rename it
    first (an error says so).
    """
    spark = docs.sparkSession
    clash = {"shard_size", "shard", "shard_slot"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + ROW_BYTES
    key, held = unused("shard_key", docs), unused("shard_cell", docs)
    keyed = docs.select("*", key_of(id_col, text).alias(key), size.alias("shard_size"))
    at = scratch_path(spark, "shard-keys")
    keyed.select(F.col(key).alias("key"), F.col("shard_size").alias("size")).write.parquet(at)
    cells = refine(spark.read.parquet(at), shards, tolerance)
    cuts = borders(cells, shards)[0]

    parts = lighter(spark.read.parquet(at), cells, max(CELL_ROWS, sum(c.rows for c in cells) // CELL_SHARE))

    plan, number, slot = [], 0, 0
    for i, whole in enumerate(cells):
        while number < len(cuts) and cuts[number] <= i:
            number, slot = number + 1, 0
        for c in parts.get(whole.prefix, [whole]):
            plan.append((c.prefix, number, slot))
            slot += c.rows
    # cells are bounded in number: the first grid, and the finer ones that ``refine`` and ``lighter`` state
    table = spark.createDataFrame(plan, "cell string, shard int, before bigint")
    depths = sorted({len(p) for p, _, _ in plan}) or [DIGITS]
    placed = keyed
    found = []
    for n in depths:
        prefix, place = unused(f"shard_prefix{n}", docs), unused(f"shard_place{n}", docs)
        own = F.broadcast(table.where(F.length("cell") == n).select(
            F.col("cell").alias(prefix), F.struct("cell", "shard", "before").alias(place)))
        placed = placed.join(own, F.substring(key, 1, n) == F.col(prefix), "left")
        found.append(F.col(place))
    inside = F.row_number().over(Window.partitionBy(F.col(held)["cell"]).orderBy(key, "shard_size")) - 1
    return placed.select(*docs.columns, key, "shard_size", F.coalesce(*found).alias(held)).select(
        *docs.columns, "shard_size", F.col(held)["shard"].alias("shard"),
        (F.col(held)["before"] + inside).alias("shard_slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within a file."""
    sharded.sortWithinPartitions("shard", "shard_slot").write.partitionBy("shard").parquet(path)
