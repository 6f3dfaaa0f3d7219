"""Column functions that cut a text blob into records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertrail.functions._col import col_of
from papertrail.functions.text import strip


def split_records(c, crlf: bool = True) -> Column:
    """Parts separated by three or more newlines, each stripped, empties
    dropped, order kept (S1).  CRLF is normalised to LF first."""
    x = col_of(c)
    if crlf:
        x = F.replace(x, F.lit("\r\n"), F.lit("\n"))
    parts = F.transform(F.split(x, r"\n{3,}"), lambda p: strip(p))
    return F.filter(parts, lambda p: F.length(p) > 0)
