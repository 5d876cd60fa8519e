"""J1 over a domain list too long to broadcast, with a third of all mail on one domain; A5 without copies of the score."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def mail(spark, n=60_000):
    """A third on gmail.com, a sixth on a domain that isn't listed, some without a domain, the rest spread."""
    kind = F.col("id") % 6
    domain = F.when(kind < 2, "gmail.com").when(kind == 2, "corp.example").when((kind == 3) & (F.col("id") % 4 == 1), F.lit(None)).otherwise(
        F.concat(F.lit("d"), (F.xxhash64("id") % 5000).cast("string"), F.lit(".org")))
    return spark.range(n).withColumn("domain", domain).withColumn("tags", F.create_map(F.lit("k"), F.col("id")))


def names(spark):
    return spark.range(3000).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".org")).alias("domain")).unionAll(
        spark.createDataFrame([("gmail.com",), ("gmail.com",), ("x.org",)], "domain string"))


def test_heavy_domains_are_found(spark):
    from mailsift.functions.headers import heavy_domains

    assert sorted(heavy_domains(mail(spark), "domain", 8)) == ["corp.example", "gmail.com"]
    assert heavy_domains(mail(spark).limit(0), "domain", 8) == []


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_flags_are_those_of_plain_membership(spark, limit):
    from mailsift.functions.headers import flag_domains

    listed = {r.domain for r in names(spark).collect()}
    rows = flag_domains(mail(spark), "domain", names(spark), "free", broadcast_names=limit).collect()
    assert len(rows) == 60_000
    assert all(r.free == (r.domain in listed) for r in rows)
    assert flag_domains(mail(spark).limit(0), "domain", names(spark), "free", broadcast_names=limit).count() == 0


def test_no_task_has_more_than_twice_the_median(spark):
    from mailsift.functions.headers import flag_domains

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # the joined column is used, or the join would be planned away
        dealt = lambda df: np.array([r[1] for r in df.groupBy(F.spark_partition_id()).agg(
            F.count(F.lit(1)), F.max(F.col(df.columns[-1]).cast("string"))).collect()])
        flagged = dealt(flag_domains(mail(spark), "domain", names(spark), "free", broadcast_names=10))
        assert len(flagged) == 8 and flagged.sum() == 60_000 and flagged.max() <= 2 * np.median(flagged)
        d = names(spark).distinct().withColumnRenamed("domain", "d")
        plain = dealt(mail(spark).join(d, F.col("domain") == F.col("d"), "left"))
        assert plain.max() > 2 * np.median(plain)  # what the dealing is for
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_histogram_evaluates_the_score_once(spark):
    from mailsift.functions.scoring import fixed
    from mailsift.operators.measure import score_histogram, threshold_sweep

    rows = spark.range(100).select(fixed(F.col("id") / 100.0, 4).alias("score_text"), (F.col("id") % 2 == 0).alias("bad"))
    constant = "1.34217729E8"  # the splitting constant of the exact rounding, twice in each body
    one = rows._jdf.queryExecution().optimizedPlan().toString().count(constant)
    for out in (score_histogram(rows), threshold_sweep(spark, rows, F.col("bad"))):
        assert 0 < out._jdf.queryExecution().optimizedPlan().toString().count(constant) <= one
