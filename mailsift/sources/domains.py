"""A supplied free-mail domain list replacing the fixed provider set.

Accepts plain lists (one domain per line) and SpamAssassin-style
configuration lines (``freemail_domains a.com b.com``); ``#`` starts a
comment. Names on ``freemail_whitelist`` lines are taken out again; lines of
other directives (``util_…``) name no free-mail provider. The result is
de-duplicated, lower case, one column ``domain``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import WS_CLASS
from ..functions.text import py_strip

DIRECTIVES = ("freemail_domains", "freemail_whitelist", "util_rb_tld", "util_rb_2tld")


def domain_list(lines: DataFrame, value_col: str = "value") -> DataFrame:
    text = py_strip(F.regexp_replace(F.col(value_col), "#.*$", ""))
    words = F.split(text, "[" + WS_CLASS + "]+", -1)
    first = F.lower(F.get(words, 0))
    kind = F.when(first.isin(*DIRECTIVES), first).otherwise(F.lit(DIRECTIVES[0]))
    named = lines.select(kind.alias("kind"), F.explode(words).alias("w")).select("kind", F.lower("w").alias("domain")).filter(
        (F.col("domain") != "") & ~F.col("domain").isin(*DIRECTIVES) & F.col("kind").isin(*DIRECTIVES[:2]))
    return named.groupBy("domain").agg(F.bool_and(F.col("kind") == DIRECTIVES[0]).alias("free")).filter("free").select("domain")


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    return domain_list(spark.read.text(path))
