"""Running (prefix) aggregates per group without one task per group.

``Window.partitionBy(g).orderBy(o)`` puts every row of a group in one
task; a group holding a third of the table would then run on a single
core.  :func:`prefix_scan` instead

1. range-partitions by (group, order) and fixes that layout with a
   reliable checkpoint (shared ``spark.checkpoint.dir``),
2. aggregates each (partition, group) slice — one row per slice,
3. combines the slices of earlier partitions with a window over that
   small slice table (at most #partitions rows per group),
4. runs the window inside each (partition, group) slice only and adds the
   offset of step 3.

Supported aggregates are associative: sum, count, max, min.
The order columns must make rows unique inside a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail.operators.sizing import checked_broadcast

_FN = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(fn: str, off: Column, inner: Column) -> Column:
    if fn == "sum":
        return F.coalesce(off, F.lit(0)) + F.coalesce(inner, F.lit(0))
    if fn == "max":
        return F.greatest(off, inner)
    return F.least(off, inner)


def prefix_scan(df: DataFrame, group: list, order: list, aggs: dict, inclusive: bool = True,
                checkpoint: bool = True) -> DataFrame:
    """Add running aggregates.

    ``aggs`` maps an output column to ``(fn, column)`` or
    ``(fn, column, inclusive)`` with fn in sum/max/min;
    ``("sum", F.lit(1))`` counts rows.  Non-inclusive aggregates cover
    strictly earlier rows (sum → 0, max/min → null when none).
    """
    incl = {k: (v[2] if len(v) > 2 else inclusive) for k, v in aggs.items()}
    aggs = {k: (v[0], v[1]) for k, v in aggs.items()}
    inputs = {f"_in_{k}": (v[1] if isinstance(v[1], Column) else F.col(v[1])) for k, v in aggs.items()}
    s = df
    for name, c in inputs.items():
        s = s.withColumn(name, c)
    s = s.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order) \
         .withColumn("_pid", F.spark_partition_id())
    if checkpoint:
        s = s.checkpoint(eager=True)
    slice_aggs = [_FN[fn](F.col(f"_in_{k}")).alias(f"_s_{k}") for k, (fn, _) in aggs.items()]
    slices = s.groupBy("_pid", *group).agg(*slice_aggs)
    wo = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = slices.select("_pid", *group, *[_FN[fn](F.col(f"_s_{k}")).over(wo).alias(f"_o_{k}")
                                           for k, (fn, _) in aggs.items()])
    out = s.join(checked_broadcast(offs, 1_000_000), ["_pid", *group], "left")
    for k, (fn, _) in aggs.items():
        wi = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding,
                                                                            0 if incl[k] else -1)
        out = out.withColumn(k, _combine(fn, F.col(f"_o_{k}"), _FN[fn](F.col(f"_in_{k}")).over(wi)))
    drop = ["_pid"] + list(inputs) + [f"_o_{k}" for k in aggs]
    return out.drop(*drop)
