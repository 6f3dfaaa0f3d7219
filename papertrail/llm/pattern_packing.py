"""Best-fit packing of whole documents by patterns fitted to the length histogram.

Documents are tokenised into pieces of at most ``max_tokens`` (only longer
documents are cut).  What packing has to know of the corpus is its length
histogram, ``max_tokens`` numbers whatever the input:

1. *Patterns* of few documents that fill a sequence are enumerated over the
   lengths that occur: pairs, copies of one length with their complement, and
   triples whose remainder is parted in several ratios.
2. *Non-negative least squares* fits how often each pattern is used to the
   histogram (accelerated projected gradient on the sparse pattern matrix).
3. The counts are *rounded* down and clipped to what the histogram holds.
4. *Residuals* are packed best fit by length class: the longest length left
   is filled up with the longest that still fits, as often as the counts
   allow.  Every step uses a length up, so there are at most ``max_tokens``.

The outcome is a table of slots by length: copies ``from`` .. ``to`` of that
length lie in given sequences and places.  Its size depends on
``max_tokens`` alone.  A piece takes the slot of its rank among the pieces
of its length: its rank in its task plus the counts of the tasks before, so
neither a length that a third of all rows share nor anything else is gathered
in one task, and pieces are never sorted.

Defined cases: a null or empty text is the end id alone (without one it
gives no piece); a null id is carried; repeated rows are packed each; other
columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papertrail.llm.common import small, stored
from papertrail.llm.packing import text_ids
from papertrail.llm.wordhash import slices

#: ratios in which two documents share what a first one leaves
RATIOS = (0.5, 0.4, 0.3, 0.2, 0.1, 0.05)
COPIES = 16  # at most so many documents of one length in a fitted pattern
ROUNDS = 400
MAX_OFFSETS = 1 << 20  # rows of the (task, length) table that may be broadcast


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048,
              end_id: int | None = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian
    uint32), and ``task`` and ``rank``: the earlier pieces of that length in the
    task that made it (they hold for one run: store the rows, as :func:`place` does)."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    step = 4 * max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), [0] * (max_tokens + 1)
        for batch in batches:
            for b in slices(batch, 1):
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                    ids = text_ids(text.as_py(), path) + end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at:at + step]
                        n = len(part) // 4
                        rows.append((doc, k, at // 4, n, part, task, seen[n]))
                        seen[n] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "piece", "start", "length", "ids", "task", "rank"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    d = docs.select(F.col(id_col).cast("long").alias("a"), F.coalesce(text_col, F.lit("")).cast("binary").alias("b"))
    return d.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, task long, rank long")


def patterns(present: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, copies), each (patterns, 3); 0 copies where a pattern has fewer lengths.

    ``present``: the lengths that occur, ascending.
    """
    below = np.zeros(size + 1, "int64")  # the longest length that occurs up to x
    below[present] = present
    below = np.maximum.accumulate(below)
    rows = []

    def add(*parts: tuple[np.ndarray, np.ndarray]) -> None:
        n = len(parts[0][0])
        lens, mult = np.zeros((n, 3), "int64"), np.zeros((n, 3), "int64")
        for k, (x, c) in enumerate(parts):
            lens[:, k], mult[:, k] = x, np.where(x > 0, c, 0)
        rows.append(np.hstack([lens, mult]))

    one = np.ones(len(present), "int64")
    for copies in range(1, COPIES + 1):
        a = present[present * copies <= size]
        if not len(a):
            break
        rest = size - a * copies
        b = below[rest]
        add((a, copies * one[:len(a)]), (b, 1), (below[rest - b], 1))
        for r in RATIOS:
            b = below[(rest * r).astype("int64")]
            add((a, copies * one[:len(a)]), (below[rest - b], 1), (b, 1))
            c = below[rest - b]
            add((a, copies * one[:len(a)]), (b, np.where(b > 0, (rest - c) // np.maximum(b, 1), 0)), (c, 1))
    every = np.unique(np.vstack(rows), axis=0)
    lens, mult = every[:, :3], every[:, 3:]
    used = (lens * mult).sum(1)
    best = used >= size - size // 64  # patterns that nearly fill a sequence
    return lens[best], mult[best]


def fit(lens: np.ndarray, mult: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that minimises the squared differences of the patterns' lengths,
    ``x`` copies each, from the histogram; long lengths, hard to place later,
    weigh more."""
    size = len(histogram) - 1
    weight = np.sqrt(np.arange(size + 1) / size)
    a = mult * weight[lens]
    norm = np.sqrt((a * a).sum(1))
    a = a / norm[:, None]  # unit columns; equal lengths of one pattern simply add up
    h = histogram * weight
    flat = lens.ravel()
    per_row = np.bincount(flat, a.ravel(), size + 1)
    step = 1.0 / max(float((a * per_row[lens]).sum(1).max()), 1e-12)  # bounds the largest eigenvalue of AᵀA
    x = np.zeros(len(lens))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        missing = h - np.bincount(flat, (a * y[:, None]).ravel(), size + 1)
        new = np.maximum(y + step * (a * missing[lens]).sum(1), 0.0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((y - new) * (new - x)).sum() > 0:  # momentum points uphill: start it anew
            t_new = 1.0
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x / norm


class Plan:
    """Slots by length: which sequence and place the copies of a length take."""

    def __init__(self, histogram: np.ndarray):
        size = len(histogram) - 1
        left = histogram.astype("int64").tolist()
        self.sequences = 0
        self.taken = [0] * (size + 1)
        self.rows: list = []  # length, first copy, copies in a sequence, first sequence, place
        self.fitted = 0  # sequences that the fit decided
        present = np.flatnonzero(histogram)
        if not len(present):
            return
        lens, mult = patterns(present, size)
        times = fit(lens, mult, np.asarray(histogram, "float64")) if len(lens) else np.empty(0)
        for k in np.argsort(-times, kind="stable").tolist():
            n = int(times[k])
            if n < 1:
                break
            need: dict[int, int] = {}
            for x, c in zip(lens[k].tolist(), mult[k].tolist()):
                if c:
                    need[x] = need.get(x, 0) + c
            self._use(need, min(n, *(left[x] // c for x, c in need.items())), left)
        self.fitted = self.sequences
        live = [x for x in range(1, size + 1) if left[x]]
        while live:
            room, need = size, {}
            while room and (at := bisect_right(live, room)):
                while at and need.get(live[at - 1], 0) >= left[live[at - 1]]:
                    at -= 1
                if not at:
                    break
                x = live[at - 1]
                need[x] = need.get(x, 0) + min(room // x, left[x] - need.get(x, 0))
                room = size - sum(y * c for y, c in need.items())
            self._use(need, min(left[x] // c for x, c in need.items()), left)
            live = [x for x in live if left[x]]

    def _use(self, need: dict[int, int], times: int, left: list[int]) -> None:
        if times < 1:
            return
        place = 0
        for x, c in sorted(need.items(), reverse=True):
            self.rows.append((x, self.taken[x], c, self.sequences, place))
            self.taken[x] += times * c
            left[x] -= times * c
            place += x * c
        self.sequences += times

    def slots(self) -> np.ndarray:
        """Rows sorted by length and first copy."""
        return np.array(sorted(self.rows), "int64").reshape(-1, 5)


def place(pieces: DataFrame, max_tokens: int = 2048, max_offsets: int = MAX_OFFSETS) -> DataFrame:
    """``pieces`` (any columns; ``length`` from 1 to ``max_tokens``, ``task`` and
    ``rank`` as :func:`pieces_of` gives them) with ``sequence_id`` and ``offset``
    in place of ``task`` and ``rank``.

    The counts of the tasks, by which a rank in the task becomes one in the
    corpus, are broadcast up to ``max_offsets`` rows; beyond that they are
    joined by task and length, of which each task has at most its own rows.
    """
    spark = pieces.sparkSession
    kept = stored(pieces, "pieces")
    fields = [f for f in pieces.schema.fields if f.name not in ("task", "rank")]
    names = [f.name for f in fields]
    counts = kept.groupBy("task", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select("task", "length", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "piece-counts")
    histogram = np.zeros(max_tokens + 1, "int64")
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most max_tokens rows
        histogram[r["length"]] = r["n"]
    table = Plan(histogram).slots()
    plan = spark.sparkContext.broadcast((table, table[:, 0] << 44 | table[:, 1]))
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, key = plan.value
        for b in batches:
            length, copy = b.column(at).to_numpy(), b.column(len(names)).to_numpy()
            row = slot[np.searchsorted(key, length << 44 | copy, "right") - 1]
            nth = copy - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(names)], pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)],
                [*names, "sequence_id", "offset"])

    offsets = small(counts.select("task", "length", "_before"), max_offsets)
    whole = kept.join(offsets, ["task", "length"]).select(*names, (F.col("rank") + F.col("_before")).alias("_copy"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    return whole.mapInArrow(run, ", ".join([*kinds, "sequence_id long, offset long"]))


def best_fit(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048,
             end_id: int | None = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id, offset."""
    return place(pieces_of(docs, path, id_col, text_col, max_tokens, end_id), max_tokens)
