"""Many linear classifiers at once against plain NumPy; pooled windows and the head."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papertrail.functions.text import tokenize
from papertrail.operators import linear as L
from papertrail.operators import metrics as M

DIMS, K = 32, 3
RNG = np.random.default_rng(5)
VOCAB = [f"w{k}" for k in range(40)]


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for k in range(120):
        y = int(RNG.choice(K, p=[0.6, 0.3, 0.1]))
        words = [VOCAB[int(RNG.integers(13 * y, 13 * y + 20) % 40)] for _ in range(12)]
        out.append((k, y, k % 3, k % 7 == 0, " ".join(words) if k else ""))
    df = spark.createDataFrame(out, "id long, label long, fold long, held boolean, text string").repartition(4)
    return df.withColumn("features", L.hashed_features(tokenize("text"), DIMS)).checkpoint()


def dense(rows):
    data = rows.orderBy("id").collect()
    x = np.zeros((len(data), DIMS))
    for r, d in enumerate(data):
        for f in d["features"]:
            x[r, f["bucket"]] += f["value"]
    return x, *(np.array([d[c] for d in data]) for c in ("label", "fold", "held"))


def plain_fit(rows, trial, fold, epochs):
    """Gradient steps with a numerical check's worth of plainness: a loop over rows."""
    x, y, folds, held = dense(rows)
    train = (folds != fold) & ~held
    n = np.bincount(y[train], minlength=K)
    alpha = n.sum() / (K * n)
    w, b, out = np.zeros((DIMS, K)), np.zeros(K), []
    for _ in range(epochs):
        gw, gb = np.zeros_like(w), np.zeros(K)
        for xi, yi in zip(x[train], y[train]):
            z = xi @ w + b
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            q = p[yi]
            d = alpha[yi] * (trial.gamma * q * (1 - q) ** (trial.gamma - 1) * np.log(q) - (1 - q) ** trial.gamma)
            g = d * ((np.arange(K) == yi) - p)
            gw += np.outer(xi, g)
            gb += g
        w = w - trial.rate / train.sum() * gw - trial.rate * trial.reg * w
        b = b - trial.rate / train.sum() * gb
        out.append((w, b))
    return out


def test_gradient_is_the_slope_of_the_loss():
    z, y = RNG.normal(size=(6, 2, K)), RNG.integers(0, K, 6)
    alpha, gamma = RNG.random((2, K)) + 0.5, np.array([0.0, 2.0])
    _, slope = L.focal_gradient(z, y, alpha, gamma)
    for k in range(K):
        up, down = z.copy(), z.copy()
        up[..., k] += 1e-6
        down[..., k] -= 1e-6
        numeric = (L.focal_gradient(up, y, alpha, gamma)[0] - L.focal_gradient(down, y, alpha, gamma)[0]) / 2e-6
        assert np.allclose(numeric, slope[..., k], atol=1e-6)


def test_all_models_of_one_scan_match_plain_fits(rows):
    trials = [L.Trial(2.0, 3.0, 0.0), L.Trial(0.0, 1.0, 0.01)]
    table, got = L.grid(rows, range(K), trials, folds=3, epochs=5, patience=99, dims=DIMS)
    x, y, folds, held = dense(rows)
    k = 0
    for trial in trials:
        for fold in range(3):
            steps = plain_fit(rows, trial, fold, 5)
            use = (folds != fold) & held
            f1 = []
            for w, b in steps:
                counts = np.zeros((K, K))
                np.add.at(counts, (y[use], (x[use] @ w + b).argmax(1)), 1)
                f1.append(L.macro_f1(counts))
            best = int(np.argmax(f1))
            assert got.best_epoch[k] == best + 1
            assert np.allclose(got.heads[k].weights, steps[best][0]) and np.allclose(got.heads[k].bias, steps[best][1])
            k += 1
    avg = M.fold_average(table, "trial", ["f1_macro"])
    assert table.count() == 6 and M.best_trial(avg, "trial", "f1_macro").count() == 1


def test_best_epoch_is_that_of_early_stopping(spark, rows):
    got = L.fit(rows, range(K), [L.Trial(2.0, 6.0), L.Trial(1.0, 0.5)], [-1, -1], epochs=12, patience=3, dims=DIMS)
    log = spark.createDataFrame([(m, e, f1) for m, e, _, f1 in got.history], "run long, epoch_no long, f1 double")
    want = {r["run"]: r["best_epoch"] for r in M.early_stop(log, "run", ["epoch_no"], "f1", 3).collect()}
    assert [want[0], want[1]] == got.best_epoch
    assert all(a >= b - 1e-9 for a, b in zip([h[2] for h in got.history if h[0] == 1], [h[2] for h in got.history if h[0] == 1][1:]))


def test_scores_of_whole_texts_and_of_pooled_windows(spark):
    head = L.Head(RNG.normal(size=(DIMS, K)), RNG.normal(size=K))
    words = [str(VOCAB[int(RNG.integers(40))]) for _ in range(70)]
    texts = {1: " ".join(words), 2: "w1 w2", 3: "", 4: None, 5: " ".join(words[:11])}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")

    def vector(ws):
        v = np.zeros(DIMS)
        if ws:
            df = spark.createDataFrame([(ws,)], "w array<string>").select(L.hashed_features("w", DIMS).alias("f")).first()
            for f in df["f"]:
                v[f["bucket"]] += f["value"]
        return v

    def softmax(v):
        z = v @ head.weights + head.bias
        e = np.exp(z - z.max())
        return e / e.sum()

    got = {r["id"]: np.array(r["probs"]) for r in L.classify(docs, "id", "text", head).collect()}
    assert set(got) == set(texts) and all(np.allclose(got[k], softmax(vector((t or "").split()))) for k, t in texts.items())
    for how in ("mean", "max"):
        got = {r["id"]: np.array(r["probs"]) for r in
               L.classify_long(docs, "id", "text", head, max_length=10, stride=4, how=how).collect()}
        for k, t in texts.items():
            ws = (t or "").split()
            wins = [vector(ws[s:s + 10]) for s in range(0, max(len(ws) - 4, 1), 6)] if ws else [np.zeros(DIMS)]
            want = np.mean(wins, 0) if how == "mean" else np.max(wins, 0)
            assert np.allclose(got[k], softmax(want)), (k, how)
