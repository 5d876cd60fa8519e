"""Differential tests: the VARIANT-based conversions against Python's json +
float()/int() on generated JSON texts (X8 metadata, S5 labels)."""

import json
import random

from conftest import one_col
from mailsift.functions.vectors import parse_metadata

ITEMS = ["1", "2.5", "-3", "1e2", "0.0", "true", "false", "null", '"2"', '" 7 "', '"1_000"', '"x"', '"inf"',
         '"nan"', '""', "[1]", '{"a":1}', '"3.5e1"', "1.7", '"-0.25"', "12345678901234567890"]


def py_metadata(text, m):
    try:
        v = json.loads(text)
        if not isinstance(v, list):
            raise ValueError
        nums = [float(x) for x in v]
    except Exception:
        nums = []
    nums = nums[:m] + [0.0] * max(0, m - len(nums))
    return nums


def _same(a, b):
    return len(a) == len(b) and all((x != x and y != y) or x == y for x, y in zip(a, b))


def test_parse_metadata_matches_python(spark):
    rnd = random.Random(5)
    texts = ["[" + ", ".join(rnd.choice(ITEMS) for _ in range(rnd.randint(0, 4))) + "]" for _ in range(400)]
    texts += ['{"a": 1}', '"str"', "5", "not json", "", "[1, [2]]"]
    got = one_col(spark, texts, lambda c: parse_metadata(c, 3))
    bad = [(t, g, py_metadata(t, 3)) for t, g in zip(texts, got) if not _same(g, py_metadata(t, 3))]
    assert not bad[:5], bad[:5]


LABELS = ["1", "0", "1.0", "0.9", "-1", "true", "false", "null", '"1"', '" 1 "', '"1.7"', '"x"', '"1_0"', "[1]",
          '{"a":1}', "1e0", '""']


def py_label(text):
    try:
        item = json.loads(text)
        return int(item.get("label"))
    except Exception:
        return None


def test_training_labels_match_python(spark):
    from mailsift.sources.training import parse_training_lines

    lines = ['{"label": %s}' % v for v in LABELS] + ['{"subject": "x"}']
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, value string")
    good, _ = parse_training_lines(df.select("value"))
    got = sorted(r.label for r in good.collect())
    want = sorted(v for v in (py_label(line) for line in lines) if v is not None)
    assert got == want


def test_text_fields_print_json_values_like_python(spark):
    """``str(item.get("subject", ""))`` for non-string JSON values."""
    from pyspark.sql import functions as F

    from mailsift.functions.jsonvals import py_str

    values = ["1.5", "1.50", "0.1", "-0.0001", "0.00001", "1e5", "1e16", "1.5e16", "12345.678", "100", "0.0",
              "2.5e-7", "123456789.125", "1e-4", "9999999999999998.0", "7", "12345678901234567890", "3.0", "1E+2",
              "true", "false", "null", '"text"']
    df = spark.createDataFrame([(i, '{"subject": %s}' % v) for i, v in enumerate(values)], "i int, j string")
    got = [r[0] for r in df.orderBy("i").select(
        py_str(F.try_variant_get(F.try_parse_json("j"), "$.subject", "variant"))).collect()]
    assert got == [str(json.loads(v)) for v in values]
