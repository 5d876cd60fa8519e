"""Native score formatting, verdicts and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_THRESHOLD, FALLBACK_SCORE_TEXT, HAM_FOLDER, SPAM_FOLDER
from .bind import let


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def check_threshold(threshold: float = DEFAULT_THRESHOLD) -> float:
    """X11: a threshold outside [0, 1] is refused before any job runs."""
    t = float(threshold)
    if not (0.0 <= t <= 1.0):
        raise ValueError(f"threshold {threshold} is not within 0 to 1")
    return t


_SPLIT = 134217729.0  # 2**27 + 1: splits a double into two halves whose products are exact


def fixed(x: Column | str, digits: int = 4) -> Column:
    """``"%.<digits>f"`` exactly as C and Python print it.

    C and Python round the exact binary value, ties to even; Spark's
    ``format_string`` rounds the shortest decimal form half up (0.00015 →
    "0.0002" instead of "0.0001", 0.03125 → "0.0313" instead of "0.0312"). Here
    ``|x|·10^digits`` is formed exactly as the sum ``p + err`` of two doubles
    (Dekker's product), the remainder is compared with one half exactly (the
    sign of a rounded sum is exact), and the digits are printed from the rounded
    integer.
    """
    scale, unit = float(10 ** digits), 10 ** digits

    def exact(v):
        a = F.abs(v)
        c = F.lit(_SPLIT) * a
        hi = c - (c - a)
        lo = a - hi
        p = a * F.lit(scale)
        return F.struct(p.alias("p"), ((hi * F.lit(scale) - p) + lo * F.lit(scale)).alias("err"))

    def rounded(pe):
        fl = F.floor(pe["p"])
        k = fl - F.when((pe["p"] == fl) & (pe["err"] < 0), 1).otherwise(0)
        return let(k, lambda k: k + F.when(((pe["p"] - k - F.lit(0.5)) + pe["err"]) > 0, 1)
                   .when(((pe["p"] - k - F.lit(0.5)) + pe["err"]) < 0, 0).otherwise(F.pmod(k, F.lit(2))))

    def text(v):
        sign = F.when(v.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))  # -0.0 included
        n = let(exact(v), rounded)
        body = let(n, lambda n: F.format_string("%s%d.%0" + str(digits) + "d", sign, F.floor(n / unit).cast("long"),
                                                F.pmod(n, F.lit(unit)).cast("long"))) if digits else \
            F.format_string("%s%d", sign, n)
        return (F.when(v.isNull(), F.lit(None).cast("string"))
                .when(F.isnan(v), F.lit("nan"))
                .when(v == float("inf"), F.lit("inf"))
                .when(v == float("-inf"), F.lit("-inf"))
                .otherwise(body))

    return let(_col(x).cast("double"), text)


def format_score(score: Column | str) -> Column:
    """X11: score text with four decimals, rounded like the reference's printf."""
    return fixed(score, 4)


def score_text(score: Column | str, failed: Column | None = None) -> Column:
    """E5: the four-decimal text, or ``0.5000`` when scoring failed or gave nothing."""
    s = _col(score)
    bad = s.isNull() if failed is None else (s.isNull() | F.coalesce(failed, F.lit(False)))
    return F.when(bad, F.lit(FALLBACK_SCORE_TEXT)).otherwise(format_score(s))


def parse_score(text: Column | str) -> Column:
    """Score read back from its text: trailing CR/LF/space/tab removed, leading
    whitespace allowed; anything else that is not a plain number gives null."""
    t = F.regexp_replace(_col(text), r"[\r\n \t]+\z", "")
    t = F.regexp_replace(t, r"^[ \t\n\x0b\f\r]+", "")
    ok = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    return F.when(ok, t.try_cast("double"))


def verdict(text: Column | str, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Decide on the re-parsed four-decimal text, as one struct column
    ``score`` (double or null), ``status`` (Yes/No/Error), ``folder``
    (spam/ham/null), ``error`` (null, ``empty response`` or ``invalid score: <text>``).
    The text is bound once, so filters on the result stay small."""
    t = check_threshold(threshold)

    def decide(raw):
        trimmed = F.regexp_replace(raw, r"[\r\n \t]+\z", "")
        empty = raw.isNull() | (raw == "")

        def with_score(s):
            error = (F.when(empty, F.lit("empty response"))
                     .when(s.isNull() | (s < 0.0) | (s > 1.0), F.concat(F.lit("invalid score: "), trimmed)))
            return let(error, lambda e: F.struct(
                F.when(e.isNull(), s).alias("score"),
                F.when(e.isNotNull(), F.lit("Error")).when(s >= F.lit(t), F.lit("Yes")).otherwise(F.lit("No"))
                .alias("status"),
                F.when(e.isNotNull(), F.lit(None).cast("string")).when(s >= F.lit(t), F.lit(SPAM_FOLDER))
                .otherwise(F.lit(HAM_FOLDER)).alias("folder"),
                e.alias("error")))

        return let(parse_score(raw), with_score)

    return let(_col(text).cast("string"), decide)


def verdict_columns(text: Column | str, threshold: float = DEFAULT_THRESHOLD) -> dict[str, Column]:
    """X12 as separate columns (each is a field of ``verdict``)."""
    v = verdict(text, threshold)
    return {k: v[k] for k in ("score", "status", "folder", "error")}
