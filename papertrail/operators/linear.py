"""Linear text classifiers on hashed words, many at once (M1-M4).

Texts become sparse vectors inside their row (:func:`hashed_features`).  Training
minimises the class-weighted focal loss by gradient steps: one pass over the
stored vectors gives the gradients and the validation counts of *all* models, so a
tuning run of 20 trials and 5 folds reads the table as often as a single fit.
Every task adds up its rows' gradients; sums travel one model at a time, and what
reaches the driver is models x dims x classes numbers, whatever the corpus.

A model's best epoch is the one with the highest macro F1 on its validation
rows; a model whose F1 has not risen for ``patience`` epochs stops.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.functions._col import let
from papertrail.functions.text import tokenize
from papertrail.operators import metrics as M
from papertrail.operators import retrieval as R

DIMS = 4096
ROWS = 256  # rows that a task turns into a dense block at a time


def buckets(tokens, dims: int = DIMS) -> Column:
    """The hash bucket of every token."""
    return F.transform(tokens, lambda t: R.md5_bucket(t, dims).cast("int"))


def hashed_features(tokens, dims: int = DIMS) -> Column:
    """ARRAY<STRUCT<bucket, value>> of a token array: each bucket's count over the
    length of the vector of counts."""
    def unit(tfs):
        norm = F.sqrt(F.aggregate(tfs, F.lit(0.0), lambda acc, t: acc + t["tf"] * t["tf"]))
        return let(norm, lambda n: F.transform(tfs, lambda t: F.struct(
            t["term"].cast("int").alias("bucket"), (t["tf"] / n).alias("value"))))
    return let(R.term_freqs(F.transform(buckets(tokens, dims), lambda b: b.cast("string"))), unit)


@dataclass(frozen=True)
class Trial:
    """What a model is trained with; ``gamma`` 0 is the weighted logistic loss."""

    gamma: float = 2.0
    rate: float = 4.0
    reg: float = 0.0


@dataclass
class Head:
    """Weights (dims x classes) and biases of a linear head."""

    weights: np.ndarray
    bias: np.ndarray


def focal_gradient(logits: np.ndarray, y: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(losses, derivatives by logit) of rows under several models.

    ``logits``: rows x models x classes; ``alpha``: models x classes; ``gamma``: models.
    """
    z = logits - logits.max(-1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(-1, keepdims=True)
    of_y = np.take_along_axis(p, y[:, None, None], 2)[..., 0].clip(1e-12, 1.0)
    rest = (1.0 - of_y).clip(1e-12, 1.0)
    weight = alpha[:, y].T
    loss = -weight * rest ** gamma * np.log(of_y)
    slope = weight * (gamma * of_y * rest ** (gamma - 1.0) * np.log(of_y) - rest ** gamma)
    mine = np.zeros_like(p)
    np.put_along_axis(mine, y[:, None, None], 1.0, 2)
    return loss, slope[..., None] * (mine - p)


def _pass(rows: DataFrame, heads: np.ndarray, bias: np.ndarray, trials: list, folds: list, alpha: np.ndarray, gradients: bool) -> dict:
    """One scan: for each model the gradient of its training rows' summed loss, the
    loss and number of these rows, and the confusion counts of its validation
    and of its held-out rows."""
    spark = rows.sparkSession
    dims, models, classes = heads.shape
    sent = spark.sparkContext.broadcast((heads.reshape(dims, -1), bias, np.array([t.gamma for t in trials]), np.array(folds), alpha))

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        w, b, gamma, fold, weight = sent.value
        grad, grad_b = np.zeros((dims, models * classes)), np.zeros((models, classes))
        loss, n = np.zeros(models), np.zeros(models)
        counts = np.zeros((2, models, classes, classes))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                lists = part.column(3)
                flat = lists.flatten()
                row = np.repeat(np.arange(len(part)), np.diff(np.asarray(lists.offsets)))
                at = row * dims + flat.field("bucket").to_numpy()
                x = np.bincount(at, flat.field("value").to_numpy(), minlength=len(part) * dims).reshape(len(part), dims)
                y = part.column(0).to_numpy().astype("int64")
                logits = (x @ w).reshape(len(part), models, classes) + b
                out = part.column(1).to_numpy()[:, None] == fold[None, :]
                held = part.column(2).to_numpy(zero_copy_only=False)[:, None]
                said = logits.argmax(-1)
                for k, use in enumerate((~out & held, out)):
                    r, m = np.nonzero(use)
                    np.add.at(counts[k], (m, y[r], said[r, m]), 1)
                train = ~out & ~held
                each, slope = focal_gradient(logits, y, weight, gamma)
                loss += (each * train).sum(0)
                n += train.sum(0)
                if gradients:
                    slope *= train[..., None]
                    grad += x.T @ slope.reshape(len(part), -1)
                    grad_b += slope.sum(0)
        grad = grad.reshape(dims, models, classes)
        for m in range(models):
            total = np.concatenate([[loss[m], n[m]], counts[:, m].ravel(), grad_b[m], grad[:, m].ravel() if gradients else []])
            yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([total.tobytes()], pa.binary())], ["model", "sums"])

    def add_up(table):
        import pyarrow as pa

        total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"model": table.column("model")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    # a task yields a gradient for each model: as many tasks as run at once, however finely the table is split
    rows = rows.select("label", "fold", "held", "features").coalesce(spark.sparkContext.defaultParallelism)
    parts = rows.mapInArrow(add, "model long, sums binary")
    found = {r["model"]: np.frombuffer(r["sums"]) for r in parts.groupBy("model").applyInArrow(add_up, "model long, sums binary").collect()}
    cells, size = 2 + 2 * classes * classes, 2 + 2 * classes * classes + classes + (dims * classes if gradients else 0)
    sums = np.stack([found.get(m, np.zeros(size)) for m in range(models)])
    counts = sums[:, 2:cells].reshape(models, 2, classes, classes)
    out = {"loss": sums[:, 0] / np.maximum(sums[:, 1], 1), "n": sums[:, 1], "validation": counts[:, 0], "held_out": counts[:, 1],
           "bias": sums[:, cells:cells + classes]}
    if gradients:
        out["weights"] = sums[:, cells + classes:].reshape(models, dims, classes).transpose(1, 0, 2)
    return out


def macro_f1(counts: np.ndarray) -> np.ndarray:
    """Macro F1 of confusion counts (..., true class, predicted class)."""
    hit = np.diagonal(counts, axis1=-2, axis2=-1)
    both = counts.sum(-1) + counts.sum(-2)
    return np.where(both > 0, 2 * hit / np.maximum(both, 1), 0.0).mean(-1)


@dataclass
class Fitted:
    heads: list  # the best epoch's head of each model
    best_epoch: list
    history: list  # (model, epoch, loss, f1), from epoch 1 to where the model stopped
    held_out: np.ndarray  # macro F1 on the held-out fold


def fit(rows: DataFrame, classes, trials: list, folds: list, epochs: int = 20, patience: int = 5, dims: int = DIMS,
        weighted: bool = True) -> Fitted:
    """Train one model for every (trial, fold) pair of the equally long lists.

    ``rows`` (stored): ``features``, ``label`` (0 .. classes - 1), ``fold`` and
    ``held`` (validation rows).  A model trains on the rows of other folds that are
    not held, validates on those that are, and never sees its own fold (-1: none).
    Class weights are those of each model's training rows.
    """
    k, models = len(classes), len(trials)
    count = {(r["fold"], r["label"]): r["n"] for r in rows.filter("NOT held").groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    alpha = np.ones((models, k))
    for m, f in enumerate(folds):
        n = np.array([sum(v for (g, c), v in count.items() if g != f and c == x) for x in range(k)], float)
        if weighted:
            alpha[m] = np.where(n > 0, n.sum() / (k * np.maximum(n, 1)), 1.0)
    w, b = np.zeros((dims, models, k)), np.zeros((models, k))
    rate, reg = (np.array([getattr(t, x) for t in trials]) for x in ("rate", "reg"))
    best, best_w, best_b = np.full(models, -1.0), w.copy(), b.copy()
    best_epoch, live, history = np.zeros(models, int), np.ones(models, bool), []
    for epoch in range(epochs + 1):
        got = _pass(rows, w, b, trials, folds, alpha, gradients=epoch < epochs)
        if epoch:
            f1 = macro_f1(got["validation"])
            history += [(m, epoch, float(got["loss"][m]), float(f1[m])) for m in np.flatnonzero(live).tolist()]
            better = live & (f1 > best)
            best[better], best_epoch[better] = f1[better], epoch
            best_w[:, better], best_b[better] = w[:, better], b[better]
            live &= epoch - best_epoch < patience
        if epoch == epochs or not live.any():
            break
        step = np.where(live, rate / np.maximum(got["n"], 1), 0.0)
        w = w - step[None, :, None] * got["weights"] - (np.where(live, rate * reg, 0.0))[None, :, None] * w
        b = b - step[:, None] * got["bias"]
    last = _pass(rows, best_w, best_b, trials, folds, alpha, gradients=False)
    return Fitted([Head(best_w[:, m].copy(), best_b[m].copy()) for m in range(models)], best_epoch.tolist(), history, macro_f1(last["held_out"]))


def grid(rows: DataFrame, classes, trials: list, folds: int = 5, **kw) -> tuple[DataFrame, Fitted]:
    """All trials on all folds at once (M4): (trial, fold, best_epoch, f1_macro), which
    :func:`metrics.fold_average` and :func:`metrics.best_trial` take, and the fit."""
    every = [(t, f) for t in range(len(trials)) for f in range(folds)]
    got = fit(rows, classes, [trials[t] for t, _ in every], [f for _, f in every], **kw)
    table = [(t, f, int(e), float(x)) for (t, f), e, x in zip(every, got.best_epoch, got.held_out)]
    return rows.sparkSession.createDataFrame(table, "trial long, fold long, best_epoch long, f1_macro double"), got


# ------------------------------------------------------------------ scoring


def window_vectors(first: np.ndarray, tokens: np.ndarray, dims: int, max_length: int | None, stride: int,
                   max_windows: int | None) -> tuple[np.ndarray, ...]:
    """(windows of each document, window, bucket, value): unit vectors of the bucket
    counts of token windows.  ``tokens``: the buckets of all documents' tokens,
    ``first``: where each document begins, and the end."""
    n = np.diff(first)
    if max_length is None:
        many, step = np.minimum(n, 1), 1
        size = n
    else:
        step, size = max_length - stride, np.minimum(n, max_length)
        many = np.where(n == 0, 0, np.where(n <= max_length, 1, -(-(n - max_length) // step) + 1))
        many = many if max_windows is None else np.minimum(many, max_windows)
    doc = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    begin = first[doc] + nth * step
    length = np.minimum(size[doc], first[doc + 1] - begin)
    at = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
    cell, count = np.unique(np.repeat(np.arange(len(doc)), length) * dims + tokens[at], return_counts=True)
    window = cell // dims
    norm = np.sqrt(np.bincount(window, count.astype("float64") ** 2, minlength=len(doc)))
    return many, window, cell % dims, count / norm[window]


def pooled(many: np.ndarray, window: np.ndarray, bucket: np.ndarray, value: np.ndarray, dims: int, how: str) -> tuple[np.ndarray, ...]:
    """(document, bucket, value): mean or maximum of the documents' window vectors,
    a bucket that a window lacks being 0 there."""
    doc = np.repeat(np.arange(len(many)), many)[window]
    if how == "mean":
        return doc, bucket, value / many[doc]
    cell, group = np.unique(doc * dims + bucket, return_inverse=True)
    top = np.zeros(len(cell))
    np.maximum.at(top, group, value)
    return cell // dims, cell % dims, top


def classify_long(docs: DataFrame, key: str, text: str, head: Head, max_length: int | None = 512, stride: int = 384,
                  max_windows: int | None = None, how: str = "mean") -> DataFrame:
    """(key, predicted_label, confidence, probs) (M3): the vectors of a document's
    token windows are pooled and go through one linear head; without tokens the
    pooled vector is 0.

    Tokens are hashed once, not once a window; a document's windows never leave its
    row, so nothing is shuffled.  The head, of fixed size, is broadcast."""
    if how not in ("mean", "max"):
        raise ValueError("how is 'mean' or 'max'")
    dims, classes = head.weights.shape
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                b = batch.slice(start, ROWS)
                first = np.asarray(b.column(1).offsets).astype("int64")
                tokens = b.column(1).flatten().to_numpy().astype("int64")
                doc, bucket, value = pooled(*window_vectors(first - first[0], tokens, dims, max_length, stride, max_windows), dims, how)
                z = np.stack([np.bincount(doc, value * own.weights[bucket, c], minlength=b.num_rows) for c in range(classes)], 1) + own.bias
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z.tolist(), pa.list_(pa.float64()))], [key, "logits"])

    d = docs.select(F.col(key), F.coalesce(buckets(tokenize(text), dims), F.array().cast("array<int>")).alias("_tokens"))
    kind = d.schema[key].dataType.simpleString()
    p = M.softmax_argmax("logits")
    scored = d.mapInArrow(run, f"`{key}` {kind}, logits array<double>").select(key, p.alias("_p"))
    return scored.select(key, F.col("_p.label").alias("predicted_label"), F.col("_p.confidence").alias("confidence"), F.col("_p.probs").alias("probs"))


def classify(docs: DataFrame, key: str, text: str, head: Head) -> DataFrame:
    """(key, predicted_label, confidence, probs) of whole texts (M2)."""
    return classify_long(docs, key, text, head, max_length=None)
