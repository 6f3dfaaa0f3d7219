"""Substring deduplication through super-k-mers partitioned by minimiser.

A window is ``window`` consecutive words.  Its minimiser is the smallest
hash of its ``gram``-word grams; consecutive windows with one minimiser
form a super-k-mer.  Equal windows have equal minimisers, so they meet in
one bucket.

1. (minimiser, id) pairs of all documents are aggregated, combining on the
   map side: minimisers of a single id can hold no repeat and stay home.
2. The other super-k-mers travel as one packed string each.  Equal strings
   are first collapsed to their smallest id (again on the map side: a text
   copied a million times sends one string per task).
3. Each bucket sorts its windows and gives every window the smallest id
   that holds it.  A minimiser with more than ``hot`` distinct strings (a
   passage in very many contexts) is not gathered in one task: its windows
   are grouped one by one across the cluster instead.
4. The smallest ids return to every occurrence by an equi-join of small
   rows; windows of a larger id become spans to remove.

Windows are judged on the input, never on what is left.  Window equality
is decided on the words themselves; hashes only route.

Defined cases: a null text has no words; texts shorter than the window
lose nothing; a null id ranks after every other id; rows that repeat an id
never remove each other's words; extra columns are kept aside; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import discard, small, stored
from papertrail.llm.wordhash import gram_hashes, hashed_words, slices, sliding_min

WINDOW = 50
GRAM = 8
HOT = 20_000
MAX_BROADCAST_ROWS = 500_000
LAST = (1 << 63) - 1


def super_kmers(texts: pa.Array, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, text number, first word within it, windows) of all runs of
    windows with one minimiser."""
    at, words = hashed_words(texts)
    counts = np.diff(at)
    if not (counts >= window).any():
        return tuple(np.empty(0, "int64") for _ in range(4))
    low = sliding_min(gram_hashes(words, gram)[:len(words) - gram + 1], window - gram + 1)
    text = np.repeat(np.arange(len(counts)), counts)[:len(low)]
    first = np.arange(len(low)) - at[text]
    keep = first <= counts[text] - window
    low, text, first = low[keep], text[keep], first[keep]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(low)))
    return low[start].view("int64"), text[start], first[start], length


def window_owners(strings: list[bytes], firsts: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """For each packed string: runs (from, to, smallest id) over its windows,
    found by sorting the windows of all strings."""
    wins, owner, place = [], [], []
    for s, (text, first) in enumerate(zip(strings, firsts)):
        ends = np.flatnonzero(np.frombuffer(text + b" ", "uint8") == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        for a, b in zip(starts[:len(ends) - window + 1].tolist(), ends[window - 1:].tolist()):
            wins.append(text[a:b])
            owner.append(first)
        place.append(len(ends) - window + 1)
    least = [0] * len(wins)
    run: list[int] = []
    for i in sorted(range(len(wins)), key=wins.__getitem__):
        if run and wins[run[0]] != wins[i]:
            m = min(owner[j] for j in run)
            for j in run:
                least[j] = m
            run = []
        run.append(i)
    if run:
        m = min(owner[j] for j in run)
        for j in run:
            least[j] = m
    out, base = [], 0
    for n in place:
        runs: list[tuple[int, int, int]] = []
        for i in range(n):
            if runs and runs[-1][2] == least[base + i]:
                runs[-1] = (runs[-1][0], i, runs[-1][2])
            else:
                runs.append((i, i, least[base + i]))
        out.append(runs)
        base += n
    return out


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("first", pa.int64())]))


def _owners_of_buckets(window: int):
    """Arrow map over rows (h, pk, packed, first) sorted by h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            if len(held) == 1:
                h, pk, text, first = held[0]
                out.append((h, pk, [{"a": 0, "b": text.count(b" ") + 1 - window, "first": first}]))
            else:
                for (h, pk, _, _), runs in zip(held, window_owners([x[2] for x in held], [x[3] for x in held], window)):
                    out.append((h, pk, [{"a": a, "b": b, "first": f} for a, b, f in runs]))
            held.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                               pa.array(cols[2], _RUNS)], ["h", "pk", "runs"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and held[0][0] != row[0]:
                    close()
                    if len(out) >= 5000:
                        yield flush()
                held.append(row)
        if held:
            close()
        if out:
            yield flush()

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("th"),
                       F.col(id_col).alias("own_id"), text.alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, candidates, packed).  spans: id, th, spans (from, to: words
    removed, may overlap); candidates: id, th, own_id, text of the documents
    with a shared minimiser; packed: the stored super-k-mers that spans reads."""
    keyed = _keyed(docs, id_col, text_col)

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2):
                h, text, _, _ = super_kmers(b.column(2), window, gram)
                if len(h):
                    at = pa.array(text)
                    yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(at), b.column(1).take(at)],
                                                     ["h", "id", "th"])

    pairs = keyed.select("id", "th", "text").mapInArrow(minimisers, "h long, id long, th long")
    shared = pairs.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("h")
    mine = pairs.join(shared, "h").groupBy("id", "th").agg(F.collect_set("h").alias("hs"))
    candidates = stored(keyed.join(mine, ["id", "th"]), "repeat-candidates")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "packed", "id", "th", "start"]
        for whole in batches:
            for b in slices(whole, 3):
                h, text, first, length = super_kmers(b.column(3), window, gram)
                lists = b.column(2).to_pylist()
                sets = [set(x) for x in lists]
                words: dict[int, list[bytes]] = {}
                rows: list[tuple] = []
                ids, ths, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)
                for k, t, f, n in zip(h.tolist(), text.tolist(), first.tolist(), length.tolist()):
                    if k in sets[t]:
                        if t not in words:
                            words = {t: texts[t].as_py().encode().split()}
                        rows.append((k, b" ".join(words[t][f:f + n + window - 1]), ids[t], ths[t], f))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.binary() if name == "packed" else pa.int64()) for c, name in zip(cols, names)], names)

    packed = candidates.select("id", "th", "hs", "text").mapInArrow(
        pack, "h long, packed binary, id long, th long, start long")
    packed = stored(packed.withColumn("pk", F.xxhash64("packed")), "super-kmers")  # on disk until the spans are
    strings = packed.groupBy("h", "pk", "packed").agg(F.min("id").alias("first"))
    crowd = packed.groupBy("h").agg(F.approx_count_distinct("pk").alias("n")).filter(F.col("n") > hot).select("h")
    crowd = crowd.checkpoint()
    rest = strings
    if not crowd.isEmpty():
        rest = strings.join(small(crowd, MAX_BROADCAST_ROWS), "h", "left_anti")
    rest = rest.select("h", "pk", "packed", "first").repartition("h").sortWithinPartitions("h")
    owners = rest.mapInArrow(_owners_of_buckets(window), "h long, pk long, runs array<struct<a:int,b:int,first:long>>")
    if not crowd.isEmpty():
        owners = owners.unionByName(_owners_one_by_one(strings.join(small(crowd, MAX_BROADCAST_ROWS), "h", "left_semi"), window))
    seen = packed.select("h", "pk", "id", "th", "start").join(owners, ["h", "pk"])
    runs = seen.select("id", "th", "start", F.explode_outer("runs").alias("r")).filter("r.first < id")
    spans = runs.groupBy("id", "th").agg(F.collect_set(F.struct(
        (F.col("start") + F.col("r.a")).alias("from"), (F.col("start") + F.col("r.b") + window).alias("to"))).alias("spans"))
    return spans, candidates.select("id", "th", "own_id", "text"), packed


def _owners_one_by_one(strings: DataFrame, window: int) -> DataFrame:
    """The runs of crowded minimisers: every window is a row of its own."""
    w = F.split(F.col("packed").cast("string"), " ")
    wins = F.transform(F.sequence(F.lit(0), F.size("w") - window),
                       lambda i: F.struct(i.alias("i"), F.array_join(F.slice(F.col("w"), i + 1, window), " ").alias("win")))
    x = strings.withColumn("w", w).select("h", "pk", "first", F.explode_outer(wins).alias("x"))
    x = x.select("h", "pk", "first", "x.i", "x.win").withColumn("wk", F.xxhash64("win"))
    least = x.groupBy("wk", "win").agg(F.min("first").alias("least"))
    y = x.select("h", "pk", "i", "wk", "win").join(least, ["wk", "win"])
    return y.groupBy("h", "pk").agg(F.collect_list(F.struct(
        F.col("i").alias("a"), F.col("i").alias("b"), F.col("least").alias("first"))).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row of ``docs``: the id column, n_words, n_removed and kept_text (the
    words that stay, joined by one space)."""
    spans, candidates, packed = repeated_spans(docs, id_col, text_col, window, gram, hot)
    spans = stored(spans, "repeat-spans")
    discard(packed)
    changed = candidates.join(spans, ["id", "th"]).select("own_id", "text", "spans")
    same = _keyed(docs, id_col, text_col).join(small(spans.select("id", "th"), MAX_BROADCAST_ROWS), ["id", "th"], "left_anti")
    same = same.select("own_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                rows = []
                for text, cut in zip(b.column(1), b.column(2).to_pylist()):
                    words = text.as_py().encode().split()
                    gone = 0
                    kept = words
                    if cut:
                        stay = np.ones(len(words), bool)
                        for s in cut:
                            stay[s["from"]:s["to"]] = False
                        kept = [words[i] for i in np.flatnonzero(stay).tolist()]
                        gone = len(words) - len(kept)
                    rows.append((len(words), gone, b" ".join(kept).decode()))
                n, gone, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                                  pa.array(kept, pa.string())], ["own_id", "n_words", "n_removed", "kept_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"own_id {kind}, n_words long, n_removed long, kept_text string"
    out = changed.mapInArrow(keep, schema).unionByName(same.mapInArrow(keep, schema))
    return out.withColumnRenamed("own_id", id_col)
