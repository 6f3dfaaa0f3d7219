"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - w . x) with one weight vector w over
hashed text features, shared by all grades, and ordered thresholds theta.
From it come the expected grade and the tail probability P(grade >= k) by
which documents are selected.

Features are hashed into ``2 ** BITS`` columns and count once each: the
lower-cased words without punctuation, the words' first 4 to 7 bytes, and
the text's shape (shares of capitals, digits, punctuation and white space,
repeated words, word and text length, each in steps).  Columns whose
presence does not differ between grades (a screen on the normal score of
the difference) have weight 0.

The model is fitted on at most ``max_train`` rated documents, chosen by the
hash of their id; that bound is its only limit.  Scoring covers every
document and whole texts, in map tasks, with the weights broadcast
(``2 ** BITS`` float32 numbers, whatever the corpus).

Defined cases: a null or empty text has shape features only; null ids or
grades are not trained on; repeated rows are scored each; without any
rated document, or with a single grade, every document gets that grade
(the top one if none is known); extra columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrail.llm.common import forget, lean
from papertrail.llm.wordhash import coded_words, hashes, mixed, slices

BITS = 18
MAX_TRAIN = 12_000
ROUNDS = 200
LEAST_DOCS = 5
SCREEN = 4.0
L2 = 1e-4
KEEP_TAIL = 0.6
SLICE_BYTES = 1 << 20  # text whose features are in memory at once
BLOCK = 1 << 19  # features that a round of the fit takes at once

_PREFIXES = (0, 4, 5, 6, 7)  # bytes of a word; 0: all
_PUNCTUATION = r"[!-/:-@\[-`{-~]+"
_SHAPES = [r"[A-Z]", r"[0-9]", r"[!-/:-@\[-`{-~]", r"[\n\r]", r"[^\x00-\x7f]", r"[|]", r"[#$%&*]", "!"]


def _shape_columns(texts: pa.Array, at: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """One column per text and shape measure, each in quarter-octave steps."""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype("float64")
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    first = np.unique(text.astype("int64") * (1 << 32) + words) >> 32
    distinct = np.bincount(first, minlength=len(n))
    cols = [pc.count_substring_regex(texts, p).to_numpy(zero_copy_only=False) / np.maximum(size, 1) for p in _SHAPES]
    cols += [distinct / np.maximum(n, 1), n / np.maximum(size, 1)]
    steps = [np.round(4 * np.log2(c + 1e-3)).astype("int64") for c in cols]
    steps += [np.round(2 * np.log2(size + 1)).astype("int64"), np.round(2 * np.log2(n + 1)).astype("int64")]
    codes = np.stack([(j + 1) * 1000 + s for j, s in enumerate(steps)], 1)
    return (mixed(codes.view("uint64")) >> np.uint64(64 - bits)).astype("int64")


def features(texts: pa.Array, bits: int = BITS, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, column) of the distinct features of each text, sorted;
    with ``weights``, only those of a weight other than 0."""
    at, words, code = coded_words(pc.replace_substring_regex(texts, _PUNCTUATION, " "), lower=True)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rows, cols = [], []
    for k, size in enumerate(_PREFIXES):
        named = [w[:size] for w in words] if size else words
        col = (mixed(hashes(named) + np.uint64(k)) >> np.uint64(64 - bits)).astype("int64")
        if weights is None:
            rows.append(text)
            cols.append(col[code])
        else:
            here = np.flatnonzero((weights[col] != 0)[code])
            rows.append(text[here])
            cols.append(col[code[here]])
    shape = _shape_columns(texts, at, code, bits)
    rows.append(np.repeat(np.arange(len(shape)), shape.shape[1]))
    cols.append(shape.reshape(-1))
    key = np.unique((np.concatenate(rows).astype("int64") << bits) | np.concatenate(cols))
    return key >> bits, key & ((1 << bits) - 1)


class CumulativeLink:
    """Fitted weights and ordered thresholds; ``grades`` = len(theta) + 1."""

    def __init__(self, weights: np.ndarray, theta: np.ndarray):
        self.weights, self.theta = weights, theta

    def probabilities(self, eta: np.ndarray) -> np.ndarray:
        """P(grade = k) per row."""
        below = _sigmoid(self.theta[None, :] - eta[:, None])
        ends = np.concatenate([np.zeros((len(eta), 1)), below, np.ones((len(eta), 1))], 1)
        return np.diff(ends, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _blocks(columns: list[np.ndarray], place: np.ndarray, entries: int = BLOCK) -> list[tuple]:
    """(first document, end, document from the first on, place of the column)
    of the features of consecutive documents, about ``entries`` a block: what a
    round holds besides them has the size of one block.  Empties ``columns``."""
    ends = np.cumsum([len(c) for c in columns])
    cuts = [0, *(np.flatnonzero(np.diff(ends // entries)) + 1).tolist(), len(columns)]
    out = []
    for x, y in zip(cuts, cuts[1:]):
        row = np.repeat(np.arange(y - x, dtype="int32"), [len(c) for c in columns[x:y]])
        out.append((x, y, row, place[np.concatenate(columns[x:y])]))
        columns[x:y] = [None] * (y - x)
    return out


def fit(columns: list[np.ndarray], grade: np.ndarray, grades: int, bits: int = BITS, rounds: int = ROUNDS,
        l2: float = L2, least_docs: int = LEAST_DOCS, screen: float = SCREEN) -> CumulativeLink:
    """Maximum a posteriori fit by Adam.  ``columns``: the features of each
    training document; the list is emptied on the way.  Features of fewer than ``least_docs`` documents, or
    whose mean grade is within ``screen`` standard errors of the average,
    keep weight 0.  Thresholds are theta_0 and positive gaps, so they stay
    ordered."""
    n = len(grade)
    mean, spread = grade.mean(), max(grade.std(), 1e-9)
    held, off = np.zeros(1 << bits), np.zeros(1 << bits)
    for c, g in zip(columns, grade.tolist()):  # a document has a feature once
        held[c] += 1
        off[c] += g - mean
    z = np.abs(off) / (spread * np.sqrt(np.maximum(held * (1 - held / n), 1e-9)))
    use = (held >= least_docs) & (held < n) & (z >= screen)
    seen = np.zeros(1 << bits, bool)
    for i, c in enumerate(columns):  # one by one, so that what is left out goes at once
        columns[i] = c = c[use[c]]
        seen[c] = True
    names = np.flatnonzero(seen)
    place = np.zeros(1 << bits, "int32")
    place[names] = np.arange(len(names))
    blocks = _blocks(columns, place)
    del columns
    share = np.cumsum(np.bincount(grade, minlength=grades)[:-1] + 0.5) / (n + 0.5 * grades)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(len(names)), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    k = len(names)
    for step in range(1, rounds + 1):
        w, gaps = p[:k], np.exp(p[k + 1:])
        theta = p[k] + np.concatenate([[0], np.cumsum(gaps)])
        eta = np.concatenate([np.bincount(row, w[col], minlength=y - x) for x, y, row, col in blocks])
        edge = np.concatenate([[-60], theta, [60]])
        hi, lo = _sigmoid(edge[grade + 1] - eta), _sigmoid(edge[grade] - eta)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        mass = np.maximum(hi - lo, 1e-9)
        g_eta = (dhi - dlo) / mass / n  # of the mean negative log likelihood
        g_theta = np.zeros(grades + 1)
        np.add.at(g_theta, grade + 1, -dhi / mass / n)
        np.add.at(g_theta, grade, dlo / mass / n)
        g_theta = g_theta[1:-1]
        later = np.cumsum(g_theta[::-1])[::-1]
        g_w = np.zeros(k)
        for x, y, row, col in blocks:
            np.add.at(g_w, col, g_eta[x:y][row])
        g = np.concatenate([g_w + l2 * w, later[:1], later[1:] * gaps])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros(1 << bits, "float32")
    weights[names] = p[:k]
    return CumulativeLink(weights, p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1:]))]))


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3, id_col: str = "doc_id", text_col: str = "text",
          grade_col: str = "grade", max_train: int = MAX_TRAIN, bits: int = BITS) -> CumulativeLink:
    """Fit on the rated documents.  ``ratings``: id and grade 0..grades-1; an
    id rated several times keeps its lowest grade."""
    r = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).filter(
        "id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    chosen = r.orderBy(F.xxhash64("id"), "id").limit(max_train)  # bounded by max_train, so broadcast below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                row, col = features(b.column(1), bits)
                at = np.searchsorted(row, np.arange(b.num_rows + 1))
                cols = pa.array([col[x:y].astype("int32").tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), cols], ["grade", "cols"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, cols = [], []
        for b in batches:
            for g, c in zip(b.column(0).to_pylist(), b.column(1)):
                if len(marks) < 2 * max_train:  # ids that the table repeats add at most as many again
                    marks.append(g)
                    cols.append(np.frombuffer(c.as_buffer().to_pybytes(), "int32"))
        known = sorted(set(marks))
        if len(known) < 2:
            m = only_grade(known[0] if known else grades - 1, grades, bits)
        else:
            m = fit(cols, np.array(marks), grades, bits)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.theta.tolist()])],
                                         ["weights", "theta"])

    d = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rated = d.join(F.broadcast(chosen), "id").select("grade", "text").mapInArrow(lean(run), "grade int, cols binary")
    # the bounded sample is fitted in one task; the driver gets the weights only
    row = rated.repartition(1).mapInArrow(lean(fitted), "weights binary, theta array<double>").first()
    if row is None:
        return only_grade(grades - 1, grades, bits)
    return CumulativeLink(np.frombuffer(row["weights"], "float32"), np.array(row["theta"]))


def only_grade(grade: int, grades: int, bits: int = BITS) -> CumulativeLink:
    """The model that gives every document one grade."""
    theta = np.where(np.arange(grades - 1) < grade, -50.0, 50.0) + np.arange(grades - 1) * 1e-3
    return CumulativeLink(np.zeros(1 << bits, "float32"), theta)


def scored(docs: DataFrame, model: CumulativeLink, text_col: str = "text", bits: int = BITS,
           carry: list[str] | None = None) -> DataFrame:
    """row (struct of the ``carry`` columns, default all) and quality (struct):
    expected (grade), tail (P of the top grade), probabilities (one per grade)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.theta))
    names = carry or docs.columns
    inside = names.index(text_col) if text_col in names else None  # a carried text is not sent a second time
    row = F.struct(*(carry or ["*"])).alias("row")
    rows = docs.select(row) if inside is not None else docs.select(row, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    quality = T.StructType().add("expected", "double").add("tail", "double").add("probabilities", T.ArrayType(T.DoubleType()))
    schema = T.StructType().add("row", rows.schema["row"].dataType).add("quality", quality)
    kind = pa.struct([("expected", pa.float64()), ("tail", pa.float64()), ("probabilities", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = CumulativeLink(*sent.value)
        for whole in batches:
            if inside is not None:
                text = pc.fill_null(whole.column(0).field(inside), "")
                whole = pa.RecordBatch.from_arrays([whole.column(0), text], ["row", "text"])
            for b in slices(whole, 1, SLICE_BYTES):
                row, col = features(b.column(1), bits, m.weights)
                p = m.probabilities(np.bincount(row, m.weights[col], minlength=b.num_rows))
                expected = p @ np.arange(p.shape[1])
                found = [{"expected": e, "tail": t[-1], "probabilities": t} for e, t in zip(expected.tolist(), p.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["row", "quality"])

    return rows.mapInArrow(lean(run), schema)


def score(docs: DataFrame, model: CumulativeLink, text_col: str = "text", bits: int = BITS,
          carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` (default: all but one named
    ``quality``) and a struct column ``quality``."""
    carry = carry or [c for c in docs.columns if c != "quality"]
    return scored(docs, model, text_col, bits, carry).select("row.*", "quality")


def select_top(docs: DataFrame, model: CumulativeLink, tail: float = KEEP_TAIL, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, unchanged, whose P(top grade) is at least ``tail``."""
    return scored(docs, model, text_col, bits).filter(F.col("quality.tail") >= tail).select("row.*")


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from the two judgements of ``labels``: one point for quality, one
    for not being toxic, so the top grade (2) is good on both."""
    return labels.select("doc_id", (F.col("quality") + F.lit(1) - F.col("toxic")).cast("int").alias("grade"))
