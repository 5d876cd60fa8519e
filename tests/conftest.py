import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from mailsift.session import build_session

    s = build_session("local[4]", shuffle_partitions=8, app="mailsift-tests")
    yield s
    s.stop()


def one_col(spark, values, expr, schema="x string"):
    """Evaluate a column expression over a list of single values, in order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(expr(F.col(schema.split()[0]))).collect()]
