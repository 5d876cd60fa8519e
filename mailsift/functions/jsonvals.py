"""Python-style conversions of JSON values, natively over Spark VARIANT.

``int(x)``, ``float(x)`` and ``str(x)`` of a value decoded by Python's ``json``
module depend on its JSON type (``true`` is 1, ``"2"`` is 2.0, ``null`` fails).
Parsing as VARIANT keeps that type, so the conversions below reproduce the
Python outcome without leaving the JVM. A null result means "the Python
conversion raises".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import WS_CLASS
from .text import py_strip

_WS = "[" + WS_CLASS + "]*"
INT_TEXT = "^" + _WS + r"[+-]?[0-9]+(_[0-9]+)*" + _WS + r"\z"
FLOAT_TEXT = ("^" + _WS + r"[+-]?((([0-9]+(_[0-9]+)*)?\.?[0-9]+(_[0-9]+)*|[0-9]+(_[0-9]+)*\.)([eE][+-]?[0-9]+)?"
              r"|(?i:inf|infinity|nan))" + _WS + r"\z")
INTEGRAL = ("TINYINT", "SMALLINT", "INT", "BIGINT")
NUMERIC = INTEGRAL + ("FLOAT", "DOUBLE")


def json_type(v: Column) -> Column:
    """Type name of a VARIANT value (``BIGINT``, ``DECIMAL(p,s)``, ``STRING``, ``VOID`` for JSON null, ...)."""
    return F.schema_of_variant(v)


def is_number(t: Column) -> Column:
    return t.isin(*NUMERIC) | t.startswith("DECIMAL")


def py_float(x: Column) -> Column:
    """``float(value)``: numbers, booleans and numeric text convert; null, lists, objects and other text fail."""
    t = json_type(x)
    s = F.try_variant_get(x, "$", "string")
    from_text = F.when(s.rlike(FLOAT_TEXT), F.regexp_replace(py_strip(s), "_", "").try_cast("double"))
    return (F.when(is_number(t), F.try_variant_get(x, "$", "double"))
            .when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("double"))
            .when(t == "STRING", from_text))


def py_int(x: Column) -> Column:
    """``int(value)``: integers, floats (truncated), booleans and integer text convert."""
    t = json_type(x)
    s = F.try_variant_get(x, "$", "string")
    from_text = F.when(s.rlike(INT_TEXT), F.regexp_replace(py_strip(s), "_", "").try_cast("long"))
    return (F.when(t.isin(*INTEGRAL), F.try_variant_get(x, "$", "long"))
            .when(is_number(t), F.try_variant_get(x, "$", "double").try_cast("long"))
            .when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("long"))
            .when(t == "STRING", from_text))


def _py_float_repr(v: Column) -> Column:
    """``repr(float)`` for a double: plain digits between 1e-4 and 1e16, else
    ``<mantissa>e<sign><2+ digits>`` (digits from Java's shortest form)."""
    a = F.abs(v)
    plain = F.regexp_replace(v.cast("decimal(38,18)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    java = v.cast("string")  # e.g. 1.5E-5
    mant = F.regexp_replace(F.regexp_extract(java, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exp = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).cast("int")
    sci = F.concat(mant, F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
                   F.lpad(F.abs(exp).cast("string"), 2, "0"))
    return (F.when(v == 0, F.when(java.startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0")))
            .when((a >= 1e-4) & (a < 1e16), plain)
            .when(java.contains("E"), sci)
            .otherwise(java))


def py_str(x: Column, missing: str = "") -> Column:
    """``str(value)`` with a default for a missing key: JSON null → "None", booleans → True/False."""
    t = json_type(x)
    return (F.when(x.isNull(), F.lit(missing))
            .when(t == "VOID", F.lit("None"))
            .when(t == "STRING", F.try_variant_get(x, "$", "string"))
            .when(t == "BOOLEAN", F.when(F.try_variant_get(x, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
            # integers: integral types, or a scale-0 decimal too long for a long (a JSON float
            # such as 3.0 also becomes a short scale-0 decimal, and prints as 3.0)
            .when(t.isin(*INTEGRAL) | t.rlike(r"^DECIMAL\((19|[2-9][0-9]),0\)$"),
                  F.try_variant_get(x, "$", "string"))
            .when(is_number(t), _py_float_repr(F.try_variant_get(x, "$", "double")))
            .otherwise(F.to_json(x)))
