"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is ``span`` consecutive benchmark words (a shorter item is one
window of its own length t).  For windows of t words the k-grams
(k = min(5, t)) are hashed and the smallest hash of every t - k + 1
consecutive k-grams is kept, in benchmark and documents alike.  A shared
span of t words holds the same k-grams, hence the same smallest hash: no
shared window can be missed.

1. The document fingerprints (about a fifth of all positions) are joined
   with the distinct benchmark fingerprints; texts with a common one are
   candidates.  Fingerprints carry no item, so a fingerprint that a third
   of all items or documents share multiplies nothing.
2. Only in candidates, hits are extended to whole windows and compared
   word by word with the distinct benchmark windows.
3. Hit windows of a text become the union of their words, and the items
   that own them.

Results depend on the text alone, so they are joined back by 96 bits of
its hashes; equal texts share one result.

Defined cases: a null or wordless text has no words and no hits; a
wordless item has no window; an item without id still marks its words but
is not listed; repeated items count once; empty tables give zero hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import bind, lower_ascii, small

# the ASCII characters between words, after lower-casing (fixed value: complement of the contract's word pattern)
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 5
SPAN = 13
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20
SALTS = 32


def words(text: Column) -> Column:
    """The words in order.  ``split`` takes time in proportion to the text;
    ``regexp_extract_all`` copies the whole text for every match."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _upto(n: Column) -> Column:
    """0 .. n - 1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, k: int) -> Column:
    return F.transform(_upto(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def _sliding_min(x: Column, width: int, step: int = 1) -> Column:
    """The minimum of every ``width`` consecutive values, from that of ``step``
    values: the width doubles, then the rest overlaps."""
    if step == width:
        return x
    by = min(step, width - step)
    return bind(x, lambda v: _sliding_min(F.transform(
        _upto(F.size(v) - by), lambda i: F.least(F.get(v, i), F.get(v, i + by))), width, step + by))


def minima(w: Column, t: int, gram: int = GRAM) -> Column:
    """The smallest k-gram hash of each window of ``t`` words, by position."""
    k = min(gram, t)
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return _sliding_min(bind(hashes, lambda h: _grams(h, k)), t - k + 1)


def windows(w: Column, t: int, gram: int = GRAM) -> Column:
    """Every window of ``t`` words: struct(t, at, fp, words)."""
    return bind(minima(w, t, gram), lambda m: F.transform(_upto(F.size(m)), lambda i: F.struct(
        F.lit(t).alias("t"), i.alias("at"), F.get(m, i).alias("fp"),
        F.array_join(F.slice(w, i + 1, t), " ").alias("words"))))


def _key(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.hash(t).alias("k2")]


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", span: int = SPAN,
                      gram: int = GRAM) -> DataFrame:
    """t, fp, words, item_id of every benchmark window."""
    b = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w"))
    b = b.withColumn("t", F.least(F.size("w"), F.lit(span))).filter("t > 0").checkpoint()
    lengths = sorted(r["t"] for r in b.select("t").distinct().collect())  # at most ``span`` values
    out = None
    for t in lengths:
        x = b.filter(F.col("t") == t).select("item_id", F.explode_outer(windows(F.col("w"), t, gram)).alias("x"))
        x = x.select("item_id", "x.t", "x.fp", "x.words")
        out = x if out is None else out.unionByName(x)
    if out is None:
        return b.select("item_id", "t", F.lit(0).cast("long").alias("fp"), F.lit("").alias("words"))
    return out


def hit_windows(docs: DataFrame, bench: DataFrame, text_col: str, gram: int = GRAM,
                max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """k1, k2, at, t, win of every occurrence of a benchmark window, per
    distinct text.  ``bench``: win, t, fp, words."""
    text = F.col(text_col)
    lengths = sorted(r["t"] for r in bench.select("t").distinct().collect())
    fps = small(bench.select("fp").distinct().checkpoint(), max_broadcast_rows)
    # 1. fingerprints of every text against those of the benchmark
    found = bind(words(text), lambda w: F.array_distinct(F.concat(*[minima(w, t, gram) for t in lengths])))
    near = docs.select(*_key(text), F.explode_outer(found).alias("fp")).filter("fp is not null")
    near = near.join(fps, "fp", "left_semi").select("k1", "k2").distinct().checkpoint()
    # 2. whole windows, in texts with a common fingerprint only
    keyed = docs.select(*_key(text), text.alias("text")).join(small(near, max_broadcast_rows), ["k1", "k2"], "left_semi")
    every = bind(words(F.col("text")), lambda w: F.concat(*[windows(w, t, gram) for t in lengths]))
    x = keyed.select("k1", "k2", F.explode_outer(every).alias("x")).filter("x is not null")
    x = x.select("k1", "k2", "x.at", "x.t", "x.fp", "x.words")
    return x.join(small(bench, max_broadcast_rows), ["t", "fp", "words"]).select("k1", "k2", "at", "t", "win")


def _covered(spans: Column) -> Column:
    """Number of words in the union of sorted [at, at + t) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda a, s: F.struct(
        F.greatest(a["end"], s["at"] + s["t"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["at"] + s["t"] - F.greatest(a["end"], s["at"]))).alias("n")), lambda a: a["n"])


def _joined(d: DataFrame, hits: DataFrame, max_rows: int) -> DataFrame:
    """``d`` left-joined with ``hits``: by broadcast up to ``max_rows`` rows and
    MAX_BROADCAST_BYTES, else in SALTS parts of every key, so that the copies
    of a frequent text meet their hits in many tasks."""
    width = 8 * F.size("spans") + F.coalesce(F.aggregate(
        "items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16), F.lit(0)) + 64
    r = hits.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    if r["rows"] <= max_rows and r["bytes"] <= MAX_BROADCAST_BYTES:
        return d.join(F.broadcast(hits), ["k1", "k2"], "left")
    d = d.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    hits = hits.withColumn("salt", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return d.join(hits, ["k1", "k2", "salt"], "left").drop("salt")


def flagged(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
            span: int = SPAN, gram: int = GRAM, ratio: int = 20, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
            carry: list[str] | None = None) -> DataFrame:
    """row (struct of the ``carry`` columns of ``docs``, default all), k1, k2 (the
    text's hashes) and contamination (struct): n_words, n_hit, spans (at, t of
    the hit windows), items (ids as sorted strings) and contaminated
    (n_hit > 0 and ratio * n_hit >= n_words)."""
    bw = benchmark_windows(items, item_id, item_text, span, gram)
    named = bw.withColumn("win", F.sha2(F.concat_ws(" ", F.col("t").cast("string"), "words"), 256)).checkpoint()
    bench = named.select("win", "t", "fp", "words").distinct().checkpoint()
    owners = named.filter("item_id is not null").select("win", F.col("item_id").cast("string").alias("item")).distinct()
    if bench.isEmpty():
        hits = docs.sparkSession.createDataFrame(
            [], "k1 long, k2 int, spans array<struct<at:int,t:int>>, items array<string>")
    else:
        occ = hit_windows(docs, bench, text_col, gram, max_broadcast_rows).distinct().checkpoint()
        spans = occ.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("at", "t"))).alias("spans"))
        listed = occ.select("k1", "k2", "win").distinct().join(owners, "win").groupBy("k1", "k2").agg(
            F.array_sort(F.collect_set("item")).alias("items"))
        hits = spans.join(listed, ["k1", "k2"], "left")
    text = F.col(text_col)
    d = docs.select(F.struct(*(carry or ["*"])).alias("row"), *_key(text), F.size(words(text)).cast("long").alias("n_words"))
    j = _joined(d, hits.checkpoint(), max_broadcast_rows).withColumn(
        "n_hit", F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")))
    c = F.struct("n_words", "n_hit", F.coalesce("spans", F.array().cast("array<struct<at:int,t:int>>")).alias("spans"),
                 F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                 ((F.col("n_hit") > 0) & (F.col("n_hit") * ratio >= F.col("n_words"))).alias("contaminated"))
    return j.select("row", "k1", "k2", c.alias("contamination"))


def decontaminate(docs: DataFrame, items: DataFrame, carry: list[str] | None = None, **options) -> DataFrame:
    """The ``carry`` columns of ``docs`` (default: all but one of that name) and
    the struct column ``contamination``; options as in :func:`flagged`."""
    carry = carry or [c for c in docs.columns if c != "contamination"]
    return flagged(docs, items, carry=carry, **options).select("row.*", "contamination")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text",
                      max_broadcast_rows: int = MAX_BROADCAST_ROWS, **options) -> DataFrame:
    """The rows of ``docs``, unchanged, that are not contaminated."""
    found = flagged(docs, items, text_col, max_broadcast_rows=max_broadcast_rows, carry=[text_col], **options)
    bad = found.filter("contamination.contaminated").select("k1", "k2").distinct().checkpoint()
    d = docs.select(F.struct("*").alias("row"), *_key(F.col(text_col)))
    return d.join(small(bad, max_broadcast_rows), ["k1", "k2"], "left_anti").select("row.*")
