"""Corpus-level DataFrame operators: projections, unions, joins on keys,
ordinals, batching and deterministic splits.

Scale notes
-----------
* No operator here needs a global single-partition window.  Ordinals
  after a sort (:func:`sequence_after_sort`) use a range-partitioned sort,
  a checkpoint, per-partition counts (one row per partition) and
  per-partition offsets.
* Splits are decided per row from a hash of (seed, id) and need no
  shuffle; the stratified split ranks rows inside (label, hash bucket)
  groups, so even a label holding a third of all rows is spread over
  many tasks.
* Key joins broadcast one side only after a bounded size check
  (:mod:`papertrail.operators.sizing`); otherwise they are shuffle joins
  that AQE may split when skewed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail.functions._col import col_of
from papertrail.functions.text import extract_doi, normalize_bib_doi, strip
from papertrail.operators.sizing import checked_broadcast

# ------------------------------------------------------------------ P1-P3


def title_abstract(title, abstract) -> Column:
    """strip(title + "\\n" + abstract), missing parts as ''."""
    return strip(F.concat(F.coalesce(col_of(title), F.lit("")), F.lit("\n"), F.coalesce(col_of(abstract), F.lit(""))))


def drop_empty(df: DataFrame, c, keep: bool = False, placeholder: str = " ") -> DataFrame:
    """Training drops empty content; inference (``keep=True``) keeps the row
    with ``placeholder`` as content."""
    x = col_of(c)
    if keep:
        name = c if isinstance(c, str) else "content"
        return df.withColumn(name, F.when(F.coalesce(F.length(x), F.lit(0)) == 0, F.lit(placeholder)).otherwise(x))
    return df.filter(F.coalesce(F.length(x), F.lit(0)) > 0)


def label_sources(sources: list, label_col: str = "label") -> DataFrame:
    """[(df, label), ...] → one table with a literal label per source."""
    parts = [df.withColumn(label_col, F.lit(int(lab))) for df, lab in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def render_prompt(template: str, **cols) -> Column:
    """Fill ``{name}`` slots of ``template`` with columns.

    Built from literal pieces and columns with ``concat``: substituted
    values are never scanned again, and ``%`` or braces inside values are
    kept as they are.  ``{{``/``}}`` in the template are literal braces.
    """
    import string

    pieces = []
    for lit, field, spec, conv in string.Formatter().parse(template):
        if lit:
            pieces.append(F.lit(lit))
        if field is not None:
            pieces.append(F.coalesce(col_of(cols[field]).cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys present in both tables."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


# ------------------------------------------------------------------ P5-P7


def drop_image_assets(df: DataFrame, path: str, exts=(".jpg", ".jpeg", ".png", ".gif")) -> DataFrame:
    ext = F.lower(F.regexp_extract(col_of(path), r"(\.[^./]*)$", 1))
    return df.filter(~ext.isin(*exts))


def slice_from(df: DataFrame, by, start: int, end: int | None = None, seq_col: str = "seq") -> DataFrame:
    """Rows ``start <= seq < end`` after sorting by ``by`` (0-based)."""
    s = sequence_after_sort(df, by, 0, seq_col)
    cond = F.col(seq_col) >= start
    if end is not None:
        cond = cond & (F.col(seq_col) < end)
    return s.filter(cond)


def route_store(questions: DataFrame, stores: DataFrame, route: str = "route", store_key: str = "store_type",
                max_broadcast_rows: int = 10_000) -> DataFrame:
    """Left join of routed questions to the store table (P6): a question
    whose store is missing keeps a null store and gets an error text."""
    s = checked_broadcast(stores, max_broadcast_rows)
    j = questions.join(s, questions[route] == s[store_key], "left")
    return j.withColumn("error", F.when(s[store_key].isNull(),
                                        F.concat(F.lit("knowledge base not available: "), questions[route])))


# ------------------------------------------------------------------ joins


def pair_by_doi(records: DataFrame, bib: DataFrame, rec_id: str = "record_id", rec_text: str = "text",
                bib_doi: str = "doi", bib_order: str = "entry_no", max_broadcast_rows: int = 5_000_000) -> DataFrame:
    """Equi-join text records to bib entries on normalised DOI.

    Bib side: one entry per DOI, the last in file order wins, empty DOIs
    skipped (``max_by`` is partially aggregated, so a DOI repeated a
    million times costs one row per map task).
    """
    b = (bib.withColumn("_doi", normalize_bib_doi(col_of(bib_doi))).filter(F.col("_doi").isNotNull())
         .groupBy("_doi").agg(F.max_by(F.struct(*[F.col(c) for c in bib.columns]), F.col(bib_order)).alias("entry")))
    r = records.withColumn("_doi", extract_doi(col_of(rec_text)))
    j = r.join(checked_broadcast(b, max_broadcast_rows), "_doi", "inner")
    return j.withColumnRenamed("_doi", "doi_key")


def unmatched(records: DataFrame, bib: DataFrame, rec_text: str = "text", bib_doi: str = "doi") -> DataFrame:
    """Records with no DOI or no bib partner (J2), with an 80-char snippet."""
    r = records.withColumn("doi", extract_doi(col_of(rec_text)))
    b = bib.select(normalize_bib_doi(col_of(bib_doi)).alias("doi")).filter(F.col("doi").isNotNull())
    # rows without a DOI match nothing: kept apart, they are no hot join key
    miss = r.filter("doi is not null").join(b, "doi", "left_anti").unionByName(r.filter("doi is null"))
    return miss.withColumn("snippet", F.substring(col_of(rec_text), 1, 80))


def match_by_name(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """Inner join of two corpora on a file stem (J3).  Of rows that share a stem
    on one side the last one (largest by all columns) is kept."""
    def last(df):
        rest = [c for c in df.columns if c != name]
        if not rest:
            return df.distinct()
        return df.groupBy(name).agg(F.max(F.struct(*rest)).alias("_last")).select(name, "_last.*")
    return last(a).join(last(b), name, "inner")


def restore_names(results: DataFrame, mapping: DataFrame, key: str = "custom_id", name: str = "name",
                  max_broadcast_rows: int = 5_000_000) -> DataFrame:
    """Left join to the id → name mapping; unknown ids keep the id."""
    m = checked_broadcast(mapping.select(key, name).dropDuplicates([key]), max_broadcast_rows)
    return results.join(m, key, "left").withColumn(name, F.coalesce(F.col(name), F.col(key)))


def response_join(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Outputs joined to inputs by record id, never by row position (J8); a
    request without a response stays, with nulls."""
    return requests.join(responses, key, "left")


# ------------------------------------------------------------------ ordinals


def sequence_after_sort(df: DataFrame, by, start: int = 0, col: str = "seq") -> DataFrame:
    """Dense 0-based position after sorting by ``by`` plus ``start``.

    Range-partitioned sort → checkpoint (so that the partitioning is fixed
    while it is read twice) → per-partition counts → running offsets over
    the (one row per partition) count table → join back.
    """
    by_cols = [col_of(c) for c in (by if isinstance(by, (list, tuple)) else [by])]
    s = df.orderBy(*by_cols).withColumn("_pid", F.spark_partition_id()) \
          .withColumn("_mono", F.monotonically_increasing_id())
    s = s.checkpoint(eager=True)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_m0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = s.join(F.broadcast(offsets.select("_pid", "_off", "_m0")), "_pid")
    out = out.withColumn(col, (F.col("_off") + F.col("_mono") - F.col("_m0") + F.lit(start)).cast("long"))
    return out.drop("_pid", "_mono", "_off", "_m0")


def batch_no(df: DataFrame, by, size: int, col: str = "batch_no", seq_col: str = "seq") -> DataFrame:
    """Consecutive batches of ``size`` rows in ``by`` order."""
    s = sequence_after_sort(df, by, 0, seq_col)
    return s.withColumn(col, F.floor(F.col(seq_col) / F.lit(size)).cast("long"))


def resolve_name_conflicts(df: DataFrame, label: str, filename: str, out: str = "target_name",
                           order=None) -> DataFrame:
    """In ``order`` (unique per class), every file of a class takes the first
    free one of ``name.ext``, ``name_1.ext``, ``name_2.ext`` … (W3).

    A file of n earlier namesakes cannot get a lower number than n, so all
    start there; where a made name meets another file's own name, the later
    file and its later namesakes move up until no name is taken twice.  The
    counts are prefix scans, so a name repeated across a third of the corpus
    still spreads over many tasks.
    """
    from papertrail.operators.scan import prefix_scan

    by = list(order or [filename])
    f = col_of(filename)
    ext = F.regexp_extract(f, r"^.+?(\.[^.]*)$", 1)
    stem = F.when(ext == "", f).otherwise(F.substring(f, F.lit(1), F.length(f) - F.length(ext)))
    d = prefix_scan(df, [label, filename], by, {"_n": ("sum", F.lit(1))}, inclusive=False).withColumn("_k", F.col("_n"))
    while True:
        d = d.withColumn(out, F.when(F.col("_k") == 0, f).otherwise(F.concat(stem, F.lit("_"), F.col("_k").cast("string"), ext)))
        d = d.checkpoint()
        taken = d.groupBy(label, out).agg(F.min(F.struct(*by)).alias("_first"), F.count(F.lit(1)).alias("_c")).filter("_c > 1")
        if taken.isEmpty():
            return d.drop("_n", "_k")
        d = d.join(taken, [label, out], "left")
        later = F.coalesce(F.struct(*by) != F.col("_first"), F.lit(False)).cast("long")
        d = d.withColumn("_x", F.col("_k") - F.col("_n") + later).drop("_first", "_c")
        d = prefix_scan(d, [label, filename], by, {"_up": ("max", "_x")})
        d = d.withColumn("_k", F.col("_n") + F.col("_up")).drop("_x", "_up")


# ------------------------------------------------------------------ splits


def hash_bucket(id_col, seed: int = 42, buckets: int = 10_000) -> Column:
    """conv(substr(md5(seed || id), 1, 8), 16, 10) % buckets: the same in
    Spark SQL and DuckDB and independent of partitioning."""
    return hash32(id_col, seed) % F.lit(buckets)


def hash32(id_col, seed: int = 42) -> Column:
    h = F.md5(F.concat(F.lit(str(seed)), col_of(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def split(df: DataFrame, fractions=(0.8, 0.1, 0.1), by: str = "id", seed: int = 42,
          names=("train", "val", "test"), stratify: str | None = None, col: str = "split") -> DataFrame:
    """Deterministic random split.

    Without ``stratify`` every row picks its part from its own hash
    bucket (no shuffle).  With ``stratify`` rows are ordered by
    (hash, id) inside their label and cut at the cumulative fractions,
    which gives exact per-label proportions; the rank is computed inside
    (label, hash-range) groups plus a running count of the earlier ranges,
    so no task ever holds a whole label.
    """
    cum, acc = [], 0.0
    for f in fractions:
        acc += f
        cum.append(acc)
    if stratify is None:
        u = hash_bucket(by, seed) / F.lit(10_000.0)
        expr = reduce(lambda e, i: e.when(u < F.lit(cum[i]), F.lit(names[i])),
                      range(1, len(cum) - 1), F.when(u < F.lit(cum[0]), F.lit(names[0])))
        return df.withColumn(col, expr.otherwise(F.lit(names[len(cum) - 1])))
    pos = stratified_position(df, stratify, by, seed)
    p = F.col("_pos")
    n = F.col("_n")
    expr = F.when(p < n * F.lit(cum[0]), F.lit(names[0]))
    for i in range(1, len(cum) - 1):
        expr = expr.when(p < n * F.lit(cum[i]), F.lit(names[i]))
    return pos.withColumn(col, expr.otherwise(F.lit(names[len(cum) - 1]))).drop("_pos", "_n")


def stratified_position(df: DataFrame, label: str, by: str, seed: int = 42, ranges: int = 4096) -> DataFrame:
    """Adds ``_pos`` (0-based rank of (hash, id) inside the label) and
    ``_n`` (label size)."""
    h = hash32(by, seed)
    d = df.withColumn("_h", h).withColumn("_r", F.floor(F.col("_h") * F.lit(ranges) / F.lit(2 ** 32)).cast("long"))
    cnt = d.groupBy(label, "_r").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(label).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    cnt = (cnt.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
              .withColumn("_n", F.sum("_c").over(Window.partitionBy(label))))
    # count table: up to #labels × ranges rows
    d = d.join(checked_broadcast(cnt.select(label, "_r", "_before", "_n"), 500_000), [label, "_r"])
    wr = Window.partitionBy(label, "_r").orderBy("_h", by)
    d = d.withColumn("_pos", F.col("_before") + F.row_number().over(wr) - 1)
    return d.drop("_h", "_r", "_before")


def kfold(df: DataFrame, k: int = 5, by: str = "id", seed: int = 42, col: str = "fold") -> DataFrame:
    """Shuffled (not stratified) fold number 0..k-1 from the row hash."""
    return df.withColumn(col, (hash32(by, seed) % F.lit(k)).cast("int"))
