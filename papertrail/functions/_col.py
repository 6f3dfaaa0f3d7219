"""Small helpers to accept a column name or a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_str(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once per row and pass it to ``fn`` as a lambda
    variable (keeps generated code small when ``fn`` uses it many times)."""
    return F.element_at(F.transform(F.array(value), fn), 1)
