"""Chunking and token windows.

All forms are per-row generators (``posexplode`` of an array built with
higher-order functions): no shuffle, and a 20,000-word document simply
yields more rows.  Long documents make the output skewed by row, so
callers that feed an Arrow function afterwards repartition first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.functions._col import col_of, let


def window_count(n: Column, size: int, step: int) -> Column:
    """0 if n = 0; 1 if n ≤ size; else ceil((n − size) / step) + 1."""
    return (F.when(n <= 0, F.lit(0)).when(n <= size, F.lit(1))
            .otherwise(F.ceil((n - F.lit(size)) / F.lit(step)).cast("int") + 1))


def chunk_fixed(df: DataFrame, text: str, size: int = 4096, overlap: int = 1024, id_col: str = "chunk_id",
                out: str = "chunk") -> DataFrame:
    """Character windows of ``size`` starting every ``size − overlap``;
    the last window reaches the end of the text (F14a, W1)."""
    step = size - overlap

    def windows(t):
        n = window_count(F.length(t), size, step)
        starts = F.when(n > 0, F.sequence(F.lit(0), (n - 1) * step, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.substring(t, s + 1, size))
    chunks = let(col_of(text), windows)
    return df.select("*", F.posexplode(chunks).alias(id_col, out))


#: where a piece that is too long is cut next; the separator stays at its end
SEPARATORS = ("\n\n", "\n", " ")


def separator_pieces(text, size: int) -> Column:
    """The text cut into pieces of at most ``size`` characters: at blank lines,
    pieces still too long at line ends, then at spaces, then at fixed offsets.
    Put together, the pieces are the text."""
    def cut(pieces, into):
        return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > size, into(p)).otherwise(F.array(p))))

    def offsets(p):
        return F.transform(F.sequence(F.lit(1), F.length(p), F.lit(size)), lambda i: F.substring(p, i, size))

    pieces = F.array(col_of(text))
    for sep in SEPARATORS:
        pieces = cut(pieces, lambda p, sep=sep: F.regexp_extract_all(p, F.lit(f"(?s)(?:.*?{sep}|.+\\z)"), F.lit(0)))
    return cut(pieces, offsets)


def packed_spans(ends, size: int, overlap: int) -> Column:
    """(from, to) of the chunks into which pieces, given by their ends, are packed:
    a chunk takes pieces up to ``size`` characters, the next one begins with the
    last pieces that fit in ``overlap`` (and leave room for the piece to come)."""
    none = F.array().cast("array<int>")
    spans = F.array().cast("array<struct<from:int,to:int>>")
    start = F.struct(spans.alias("spans"), none.alias("begins"), F.lit(0).alias("end"))

    def step(state, end):
        begins, at = state["begins"], state["end"]
        first = F.get(begins, F.lit(0))
        full = (F.size(begins) > 0) & (end - first > size)
        done = F.when(full, F.concat(state["spans"], F.array(F.struct(first.alias("from"), at.alias("to"))))).otherwise(state["spans"])
        left = F.when(full, F.filter(begins, lambda b: (at - b <= overlap) & (end - b <= size))).otherwise(begins)
        return F.struct(done.alias("spans"), F.concat(left, F.array(at)).alias("begins"), end.alias("end"))

    def last(state):
        rest = F.struct(F.get(state["begins"], F.lit(0)).alias("from"), state["end"].alias("to"))
        return F.when(F.size(state["begins"]) > 0, F.concat(state["spans"], F.array(rest))).otherwise(state["spans"])
    return F.aggregate(col_of(ends), start, step, last)


def chunk_recursive(df: DataFrame, key: str, text: str, size: int = 4096, overlap: int = 1024,
                    id_col: str = "chunk_id", out: str = "chunk") -> DataFrame:
    """Separator-aware chunks (F14b): the text is cut at its separators and the
    pieces are packed greedily, all inside the row."""
    def ends(pieces):
        lengths = F.transform(pieces, lambda p: F.length(p))
        sums = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
        return F.aggregate(lengths, sums, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["ends"], F.array(s["at"] + n)).alias("ends")),
                           lambda s: s["ends"])

    filled = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.length("_text") > 0)
    pieces = F.filter(separator_pieces("_text", size), lambda p: F.length(p) > 0)
    spans = let(let(pieces, ends), lambda e: packed_spans(e, size, overlap))
    at = filled.select("_key", "_text", F.posexplode_outer(spans).alias("_id", "_span"))
    return at.select(F.col("_key").alias(key), F.col("_id").alias(id_col),
                     F.expr("substring(_text, _span.from + 1, _span.to - _span.from)").alias(out))


def token_windows(tokens, max_length: int = 512, stride: int = 384, max_windows: int | None = None) -> Column:
    """Windows of ``max_length`` tokens starting every ``max_length − stride``
    tokens (``stride`` is the overlap); stops at the first window that
    reaches the end (F15).  ``max_windows`` keeps only the first windows
    (the classifier's limit; None keeps all)."""
    step = max_length - stride

    def windows(t):
        n = window_count(F.size(t), max_length, step)
        if max_windows is not None:
            n = F.least(n, F.lit(max_windows))
        starts = F.when(n > 0, F.sequence(F.lit(0), (n - 1) * step, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.slice(t, s + 1, max_length))
    return let(col_of(tokens), windows)


def pad_truncate(ids, n: int, pad: int = 0, label_pad: int | None = None) -> Column:
    """struct(ids, mask[, labels]): first ``n`` ids, padded on the right
    with ``pad``; mask 1 for real tokens; labels replace padding by
    ``label_pad`` (e.g. −100) (F16)."""
    x = F.slice(col_of(ids), 1, n)
    k = F.size(x)
    padn = F.greatest(F.lit(n) - k, F.lit(0))
    ids_p = F.concat(x, F.array_repeat(F.lit(pad), padn))
    mask = F.concat(F.array_repeat(F.lit(1), k), F.array_repeat(F.lit(0), padn))
    fields = [ids_p.alias("ids"), mask.alias("mask")]
    if label_pad is not None:
        fields.append(F.concat(x, F.array_repeat(F.lit(label_pad), padn)).alias("labels"))
    return F.struct(*fields)


def hashed_ids(tokens, vocab: int = 30_000) -> Column:
    """Token ids from an md5 bucket (the same in Spark and DuckDB); a
    fixed vocabulary needs no global ranking pass."""
    return F.transform(col_of(tokens), lambda t: (F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("long") % vocab).cast("int"))
