"""Registered ML queries: train/evaluate, classify, windowed classify,
tuning, majority baseline.  Labels: `labels.quality` joined to
`documents`."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from papertrail.functions.text import tokenize
from papertrail.operators import corpus as C
from papertrail.operators import linear as L
from papertrail.operators import metrics as M
from papertrail.operators import ml as ML
from papertrail.plans import duck as D
from papertrail.plans.q_search import _SQL_WINDOWS
from papertrail.plans.registry import register
from papertrail.session import scratch_path, table

CLASSES = [0, 1]


def labelled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("label"))
    j = d.join(lab, "doc_id")
    return C.split(j, (0.8, 0.2), by="doc_id", seed=7, names=("train", "test"), stratify="label")


def training_rows(spark, sf, dims: int = L.DIMS):
    """Labelled texts as vectors, with a fold and 15 % of each class held out of
    training for validation; written once, read by every pass."""
    s = labelled(spark, sf).filter("label IS NOT NULL")
    s = C.split(s, (0.85, 0.15), by="doc_id", seed=11, names=("fit", "held"), stratify="label", col="part")
    s = C.kfold(s, 5, by="doc_id", seed=13)
    empty = F.array().cast("array<struct<bucket:int,value:double>>")
    x = F.coalesce(L.hashed_features(tokenize("text"), dims), empty)
    s = s.select("doc_id", "label", "split", "fold", (F.col("part") == "held").alias("held"), x.alias("features"))
    path = scratch_path(spark, f"features-{uuid.uuid4().hex}")
    s.filter(F.size("features") > 0).write.parquet(path)  # empty texts are not trained on
    return spark.read.schema(s.schema).parquet(path)


def _train_eval(spark, sf):
    rows = training_rows(spark, sf)
    train = rows.filter("split = 'train'").withColumn("fold", F.lit(0))
    got = L.fit(train, CLASSES, [L.Trial()], [-1], epochs=20, patience=5)
    test = labelled(spark, sf).filter("split = 'test'")
    pred = L.classify(test, "doc_id", "text", got.heads[0]).join(test.select("doc_id", "label"), "doc_id")
    return ML.evaluate(pred, "label", "predicted_label", CLASSES)


register("m_train_eval")(_train_eval)

#: weights that both engines can write down: -1 .. 1 by bucket and class, and a bias by class
GIVEN = "((bucket * 7919 + class * 104729) % 2001 - 1000) / 1000.0"


def given_head(dims: int = L.DIMS) -> L.Head:
    """A head of given weights, so that scoring itself can be held against SQL."""
    bucket, cls = np.arange(dims)[:, None], np.arange(len(CLASSES))[None, :]
    return L.Head(((bucket * 7919 + cls * 104729) % 2001 - 1000) / 1000.0, np.arange(len(CLASSES)) / 10.0)


def sql_scores(windows: str) -> str:
    """CTEs ending in ``scored(doc_id, p0, p1)`` of ``windows(doc_id, win, w)``: the mean of
    the windows' vectors under the given weights; documents without a window have the biases."""
    return f"""tf AS (SELECT doc_id, win, bucket, count(*) AS tf FROM (SELECT doc_id, win, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {L.DIMS} AS bucket
       FROM (SELECT doc_id, win, unnest(w) AS term FROM {windows})) GROUP BY ALL),
norm AS (SELECT doc_id, win, sqrt(sum(tf * tf)) AS n FROM tf GROUP BY ALL),
x AS (SELECT doc_id, bucket, tf / n AS v FROM tf JOIN norm USING (doc_id, win)),
z AS (SELECT doc_id, class, sum(v * {GIVEN}) AS z FROM x CROSS JOIN (SELECT unnest(range({len(CLASSES)})) AS class) GROUP BY ALL),
wins AS (SELECT doc_id, count(*) AS n FROM {windows} GROUP BY doc_id),
zz AS (SELECT d.doc_id, c.class, coalesce(z.z / wins.n, 0.0) + c.class / 10.0 AS z FROM documents d
       CROSS JOIN (SELECT unnest(range({len(CLASSES)})) AS class) c LEFT JOIN z ON z.doc_id = d.doc_id AND z.class = c.class
       LEFT JOIN wins ON wins.doc_id = d.doc_id),
scored AS (SELECT doc_id, CASE WHEN max(z) FILTER (class = 1) > max(z) FILTER (class = 0) THEN 1 ELSE 0 END AS predicted_label,
                  1 / (1 + exp(-abs(max(z) FILTER (class = 1) - max(z) FILTER (class = 0)))) AS confidence FROM zz GROUP BY doc_id)"""


def _classify(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pred = L.classify(docs, "doc_id", "text", given_head())
    stats = M.prediction_stats(pred.checkpoint(), "predicted_label", "confidence", CLASSES)
    return stats.select("label", "count", F.round("pct", 6).alias("pct"), F.round("avg_confidence", 6).alias("avg_confidence"))


register("m_classify", sql=f"""
WITH whole AS (SELECT doc_id, 0 AS win, {D.tokens('text')} AS w FROM documents),
{sql_scores('whole')},
t AS (SELECT count(*) AS n, avg(confidence) AS c FROM scored)
SELECT CAST(d.label AS BIGINT) AS label, count(s.doc_id) AS count, round(count(s.doc_id) * 100.0 / max(t.n), 6) AS pct,
       round(max(t.c), 6) AS avg_confidence
FROM range({len(CLASSES)}) d(label) CROSS JOIN t LEFT JOIN scored s ON s.predicted_label = d.label GROUP BY d.label
""")(_classify)


def _classify_long(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    p = L.classify_long(docs, "doc_id", "text", given_head())
    return p.select("doc_id", "predicted_label", F.round("confidence", 6).alias("confidence"))


register("m_classify_long", sql=f"""
WITH {_SQL_WINDOWS.replace('@L@', '512').replace('@S@', '128')},
{sql_scores('w')}
SELECT doc_id, predicted_label, round(confidence, 6) AS confidence FROM scored
""")(_classify_long)

#: the tuning run: 20 trials
TRIALS = [L.Trial(gamma, rate, reg) for gamma in (0.0, 1.0, 2.0, 3.0, 5.0) for rate in (2.0, 8.0) for reg in (0.0, 1e-3)]


def _tune(spark, sf):
    rows = training_rows(spark, sf).filter("split = 'train'")
    trials, _ = L.grid(rows, CLASSES, TRIALS, folds=5, epochs=8, patience=3)
    average = M.fold_average(trials, "trial", ["f1_macro"])
    best = M.best_trial(average, "trial", "f1_macro").select("trial", F.lit(True).alias("best"))
    return average.join(F.broadcast(best), "trial", "left").select(  # one row
        "trial", F.round("f1_macro", 6).alias("f1_macro"), F.coalesce("best", F.lit(False)).alias("best"))


register("m_tune")(_tune)


def _eval_row(spark, sf):
    """The labelled documents scored by the given head, held against their labels."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("y")).filter("y IS NOT NULL")
    docs = table(spark, sf, "documents").select("doc_id", "text")  # scored first: a join would move whole texts
    pred = L.classify(docs, "doc_id", "text", given_head()).withColumn("probs", F.transform("probs", lambda v: F.round(v, 6)))
    s = pred.join(lab, "doc_id").select("y", F.col("predicted_label").cast("long").alias("pred"), "probs",
                                        F.floor(F.col("doc_id") / 32).alias("batch")).checkpoint()
    row = M.evaluation_row(s, "y", "pred", "probs", CLASSES, alpha=M.class_weights(s, "y", CLASSES), batch="batch")
    return row.select(*[F.round(c, 6).alias(c) if c != "n_test" else F.col(c) for c in row.columns])


register("m_eval_row", sql=f"""
WITH whole AS (SELECT doc_id, 0 AS win, {D.tokens('text')} AS w FROM documents),
{sql_scores('whole')},
s AS (SELECT doc_id, CAST(quality AS BIGINT) AS y, predicted_label AS pred, round(CASE WHEN predicted_label = 0 THEN confidence ELSE 1 - confidence END, 6) AS p0,
             round(CASE WHEN predicted_label = 1 THEN confidence ELSE 1 - confidence END, 6) AS p1
      FROM scored JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
n AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN y = pred THEN 1 ELSE 0 END)::DOUBLE AS c FROM s),
rep AS (SELECT d.label, count(*) FILTER (y = d.label AND pred = d.label)::DOUBLE AS tp, count(*) FILTER (y = d.label)::DOUBLE AS t,
               count(*) FILTER (pred = d.label)::DOUBLE AS pk FROM s CROSS JOIN (SELECT unnest(range({len(CLASSES)})) AS label) d GROUP BY d.label),
sc AS (SELECT *, CASE WHEN pk > 0 THEN tp / pk ELSE 0 END AS pr, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS rc,
              CASE WHEN pk + t > 0 THEN 2 * tp / (pk + t) ELSE 0 END AS f1 FROM rep),
agg AS (SELECT avg(pr) AS pr, avg(rc) AS rc, avg(f1) AS f1, avg(CASE WHEN t > 0 THEN rc END) AS bal, max(f1) FILTER (label = 0) AS f0,
               max(f1) FILTER (label = 1) AS f1c, sum(pk * t) AS pt, sum(pk * pk) AS pp, sum(t * t) AS tt FROM sc),
ex AS (SELECT 0 AS cls, y = 0 AS pos, p0 AS score FROM s UNION ALL SELECT 1, y = 1, p1 FROM s),
cs AS (SELECT cls, score, count(*) FILTER (pos) AS pos, count(*) FILTER (NOT pos) AS neg FROM ex GROUP BY ALL),
rk AS (SELECT cls, pos, neg, sum(pos) OVER (PARTITION BY cls) AS P, sum(neg) OVER (PARTITION BY cls) AS N,
              sum(pos) OVER w - pos AS pos_lt, sum(neg) OVER w - neg AS neg_lt FROM cs WINDOW w AS (PARTITION BY cls ORDER BY score)),
roc AS (SELECT cls, sum(pos * neg_lt + 0.5 * pos * neg) / max(P) / max(N) AS auc, sum(pos * (P - pos_lt) / (P + N - pos_lt - neg_lt)) / max(P) AS ap
        FROM rk GROUP BY cls),
al AS (SELECT label, CASE WHEN t = 0 THEN 1.0 ELSE n.n / ({len(CLASSES)} * t) END AS weight FROM rep CROSS JOIN n),
ls AS (SELECT doc_id // 32 AS batch, avg(pow(1 - CASE WHEN y = 1 THEN p1 ELSE p0 END, 2) * -ln(CASE WHEN y = 1 THEN p1 ELSE p0 END) * weight) AS b
       FROM s JOIN al ON al.label = s.y GROUP BY 1)
SELECT round(c / n, 6) AS accuracy, CAST(n AS BIGINT) AS n_test, round(pr, 6) AS precision_macro, round(rc, 6) AS recall_macro, round(f1, 6) AS f1_macro,
  round(bal, 6) AS balanced_accuracy, round(CASE WHEN (n * n - pp) * (n * n - tt) > 0 THEN (c * n - pt) / sqrt((n * n - pp) * (n * n - tt)) ELSE 0 END, 6) AS mcc,
  round(f0, 6) AS f1_0, round(f1c, 6) AS f1_1, (SELECT round(avg(auc), 6) FROM roc) AS roc_auc_macro, (SELECT round(avg(ap), 6) FROM roc) AS pr_auc_macro,
  (SELECT round(avg(b), 6) FROM ls) AS test_loss
FROM agg CROSS JOIN n
""")(_eval_row)


def _baseline(spark, sf):
    s = labelled(spark, sf)
    pred = ML.baseline_predictions(s.filter("split = 'train'"), s.filter("split = 'test'"), "label")
    ev = ML.evaluate(pred, "label", "predicted_label", CLASSES)
    return ev.select(*[F.round(c, 6).alias(c) if c != "n_test" else F.col(c) for c in ev.columns])


register("m_baseline", sql=f"""
WITH t AS (SELECT d.doc_id, CAST(l.quality AS BIGINT) AS label, {D.hash32('d.doc_id', 7)} AS h FROM documents d JOIN labels l USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, doc_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM t),
s AS (SELECT doc_id, label, CASE WHEN pos < n * 0.8 THEN 'train' ELSE 'test' END AS split FROM r),
maj AS (SELECT label AS m FROM s WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
p AS (SELECT s.label AS y, maj.m AS pred FROM s CROSS JOIN maj WHERE split = 'test'),
dim AS (SELECT CAST(x AS BIGINT) AS label FROM range(2) t(x)),
rep AS (SELECT d.label,
   (SELECT count(*) FROM p WHERE y = d.label AND pred = d.label) AS tp,
   (SELECT count(*) FROM p WHERE y = d.label) AS support, (SELECT count(*) FROM p WHERE pred = d.label) AS npred FROM dim d),
rep2 AS (SELECT label, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM rep),
rep3 AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM rep2),
tt AS (SELECT y AS k, count(*) AS t FROM p GROUP BY y), pp AS (SELECT pred AS k, count(*) AS pk FROM p GROUP BY pred),
tp AS (SELECT coalesce(pp.pk, 0) AS pk, coalesce(tt.t, 0) AS t FROM pp FULL JOIN tt USING (k)),
sm AS (SELECT sum(pk * t)::DOUBLE AS pt, sum(pk * pk)::DOUBLE AS ppk, sum(t * t)::DOUBLE AS ttk FROM tp),
cs AS (SELECT sum(CASE WHEN y = pred THEN 1 ELSE 0 END)::DOUBLE AS c, count(*)::DOUBLE AS n FROM p)
SELECT round(c / n, 6) AS accuracy, CAST(n AS BIGINT) AS n_test,
  (SELECT round(avg(pr), 6) FROM rep3) AS precision_macro, (SELECT round(avg(rc), 6) FROM rep3) AS recall_macro,
  (SELECT round(avg(f1), 6) FROM rep3) AS f1_macro,
  (SELECT round(avg(r), 6) FROM (SELECT y, avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS r FROM p GROUP BY y)) AS balanced_accuracy,
  round(CASE WHEN sqrt((n * n - ppk) * (n * n - ttk)) > 0 THEN (c * n - pt) / sqrt((n * n - ppk) * (n * n - ttk)) ELSE 0.0 END, 6) AS mcc
FROM cs CROSS JOIN sm
""")(_baseline)
