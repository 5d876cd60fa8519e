"""Binding a value once inside a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Catalyst inlines column definitions into every place that uses them (and
    into pushed-down filters), so an expression used many times would be copied
    many times; binding it through a one-element ``transform`` keeps one copy.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
