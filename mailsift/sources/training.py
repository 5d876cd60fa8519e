"""The training table as JSON lines.

The writer keeps non-ASCII text unescaped. The reader is lenient the way the
reference's loader is: blank lines are skipped, missing ``subject``/``body``
are empty, missing metadata is an empty list, the label goes through integer
conversion (``1``, ``"1"``, ``0.0``, ``true`` pass; null, absent, ``"1.7"``
fail) and metadata items through float conversion (``"3.5"`` passes, ``"q"``
fails, nulls are dropped). Lines are parsed as VARIANT so the JSON type of
every leaf is known; a line that fails is returned in a second DataFrame with
its reason instead of being half-used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonvals import json_type, py_float, py_int, py_str
from ..functions.bind import let
from ..functions.text import py_strip

TRAINING_FIELDS = ("subject", "body", "metadata_features", "label")

def _type(v: Column) -> Column:
    return json_type(v)


def _text_field(v: Column, name: str) -> Column:
    """``str(item.get(name, ""))``."""
    return py_str(F.try_variant_get(v, f"$.{name}", "variant"), "")


def _label(v: Column) -> Column:
    """``int(label)``; null when the reference's conversion would fail."""
    return py_int(F.try_variant_get(v, "$.label", "variant")).cast("int")


def _float_of(x: Column) -> Column:
    return py_float(x)


def _metadata(v: Column) -> tuple[Column, Column]:
    """(numbers, ok): nulls dropped, every other item must convert."""
    x = F.try_variant_get(v, "$.metadata_features", "variant")
    t = _type(x)
    items = F.try_variant_get(x, "$", "array<variant>")
    kept = F.filter(items, lambda e: _type(e) != "VOID")
    nums = F.transform(kept, _float_of)
    arr_ok = F.forall(nums, lambda n: n.isNotNull())
    s = F.try_variant_get(x, "$", "string")
    # a JSON string is iterated character by character: only digits convert
    str_nums = F.transform(F.split(s, "", -1), lambda c: c.try_cast("double"))
    str_ok = s.rlike(r"^[0-9]*\z")
    numbers = (F.when(x.isNull(), F.array().cast("array<double>"))
               .when(t.startswith("ARRAY"), nums)
               .when(t == "STRING", F.when(s == "", F.array().cast("array<double>")).otherwise(str_nums)))
    ok = (F.when(x.isNull(), F.lit(True))
          .when(t.startswith("ARRAY"), arr_ok)
          .when(t == "STRING", str_ok)
          .otherwise(F.lit(False)))
    return numbers, ok


def _record(v: Column) -> Column:
    numbers, meta_ok = _metadata(v)
    label = _label(v)
    reason = (F.when(v.isNull(), F.lit("malformed JSON"))
              .when(~_type(v).startswith("OBJECT"), F.lit("not an object"))
              .when(label.isNull(), F.lit("bad label"))
              .when(~meta_ok, F.lit("bad metadata")))
    return F.struct(_text_field(v, "subject").alias("subject"), _text_field(v, "body").alias("body"),
                    label.alias("label"), numbers.alias("metadata_features"), reason.alias("reject_reason"))


def parse_training_lines(lines: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """S5 on a DataFrame of JSON lines → (rows, rejects).

    Each line is parsed once: the parsed VARIANT is bound inside one record
    struct, and the struct comes out of a generator (``inline``) so that the
    filters splitting rows from rejects cannot be pushed below it (which would
    copy the JSON parse into the filter condition once per use)."""
    rec = let(F.try_parse_json(F.col(value_col)), _record)
    d = (lines.filter(py_strip(F.col(value_col)) != "")
         .select(F.inline(F.array(F.struct(F.col(value_col).alias("line"), rec.alias("rec")))))
         .select("line", "rec.*"))
    good = d.filter(F.col("reject_reason").isNull()).drop("reject_reason", "line")
    bad = d.filter(F.col("reject_reason").isNotNull()).select("line", "reject_reason")
    return good, bad


def read_training(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read JSON lines from ``path`` → (rows, rejects)."""
    return parse_training_lines(spark.read.text(path))


def write_training(df: DataFrame, path: str, extra: tuple[str, ...] = ()) -> None:
    """K1: JSON lines, UTF-8 unescaped, overwriting ``path``. Null fields are
    written as JSON null so that a missing label is told apart from a bad one."""
    cols = [c for c in (*extra, *TRAINING_FIELDS) if c in df.columns]
    df.select(*cols).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
