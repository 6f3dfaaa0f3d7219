"""Registered metric queries.

Predictions come from the `embeddings` table: true class y = label % 3,
logits = the first three vector components, probabilities = softmax,
prediction = argmax (first wins), confidence = max probability.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.operators import corpus as C
from papertrail.operators import metrics as M
from papertrail.plans import duck as D
from papertrail.plans.registry import register
from papertrail.session import table

CLASSES4 = [0, 1, 2, 3]
CLASSES3 = [0, 1, 2]


def scored(spark, sf, rounded: bool = False):
    e = table(spark, sf, "embeddings")
    sm = M.softmax_argmax(F.slice("embedding", 1, 3))
    probs = F.transform(sm["probs"], lambda v: F.round(v, 6)) if rounded else sm["probs"]
    return e.select("vec_id", (F.col("label") % 3).cast("long").alias("y"), probs.alias("probs"),
                    sm["label"].cast("long").alias("pred"), sm["confidence"].alias("conf"))


_SQL_SCORED = """scored0 AS (
  SELECT vec_id, label, list_transform(embedding[1:3], lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
scored1 AS (
  SELECT vec_id, label, list_transform(e, lambda v: exp(v - list_max(e))) AS ex FROM scored0),
scored AS (
  SELECT vec_id, CAST(label % 3 AS BIGINT) AS y,
         list_transform(ex, lambda v: v / list_sum(ex)) AS probs,
         CAST(list_position(list_transform(ex, lambda v: v / list_sum(ex)), list_max(list_transform(ex, lambda v: v / list_sum(ex)))) - 1 AS BIGINT) AS pred,
         list_max(list_transform(ex, lambda v: v / list_sum(ex))) AS conf
  FROM scored1)"""

SQL_SCORED = _SQL_SCORED
_SQL_DIM4 = "dim AS (SELECT CAST(x AS BIGINT) AS label FROM range(4) t(x))"
_SQL_DIM3 = "dim AS (SELECT CAST(x AS BIGINT) AS label FROM range(3) t(x))"


def _r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------ A1-A3

register("a_label_counts", sql=f"""
WITH {_SQL_SCORED}, {_SQL_DIM4}
SELECT d.label, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM dim d LEFT JOIN (SELECT pred AS label, count(*) AS n FROM scored GROUP BY pred) c USING (label)
""")(lambda spark, sf: M.label_counts(scored(spark, sf), "pred", CLASSES4))


def _pred_stats(spark, sf):
    s = M.prediction_stats(scored(spark, sf), "pred", "conf", CLASSES4)
    return s.select("label", "count", _r6("pct").alias("pct"), _r6("avg_confidence").alias("avg_confidence"))


register("a_pred_stats", sql=f"""
WITH {_SQL_SCORED}, {_SQL_DIM4},
c AS (SELECT d.label, CAST(coalesce(c.n, 0) AS BIGINT) AS count
      FROM dim d LEFT JOIN (SELECT pred AS label, count(*) AS n FROM scored GROUP BY pred) c USING (label)),
t AS (SELECT count(*) AS n, avg(conf) AS ac FROM scored)
SELECT label, count, round(CASE WHEN t.n > 0 THEN count * 100.0 / t.n ELSE 0.0 END, 6) AS pct, round(t.ac, 6) AS avg_confidence
FROM c CROSS JOIN t
""")(_pred_stats)


def _class_weights(spark, sf):
    lab = table(spark, sf, "labels")
    return M.class_weights(lab, "quality", CLASSES3).select("label", _r6("weight").alias("weight"))


register("a_class_weights", sql=f"""
WITH {_SQL_DIM3}, c AS (SELECT CAST(quality AS BIGINT) AS label, count(*) AS n FROM labels GROUP BY 1),
t AS (SELECT count(*) AS n FROM labels)
SELECT d.label, round(CASE WHEN coalesce(c.n, 0) = 0 THEN 1.0 ELSE t.n / (3.0 * c.n) END, 6) AS weight
FROM dim d LEFT JOIN c USING (label) CROSS JOIN t
""")(_class_weights)

# ------------------------------------------------------------------ A4-A8

register("a_confusion", sql=f"""
WITH {_SQL_SCORED}, {_SQL_DIM3}
SELECT d.label,
  CAST(count(s.y) FILTER (WHERE s.pred = 0) AS BIGINT) AS p_0,
  CAST(count(s.y) FILTER (WHERE s.pred = 1) AS BIGINT) AS p_1,
  CAST(count(s.y) FILTER (WHERE s.pred = 2) AS BIGINT) AS p_2
FROM dim d LEFT JOIN scored s ON s.y = d.label GROUP BY d.label
""")(lambda spark, sf: M.confusion_matrix(scored(spark, sf), "y", "pred", CLASSES3))


register("a_accuracy", sql=f"""
WITH {_SQL_SCORED}
SELECT round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM scored
""")(lambda spark, sf: M.accuracy(scored(spark, sf), "y", "pred").select(_r6("accuracy").alias("accuracy"), "n"))

_SQL_REPORT = f"""{_SQL_DIM4},
r0 AS (SELECT d.label,
         (SELECT count(*) FROM scored s WHERE s.y = d.label AND s.pred = d.label) AS tp,
         (SELECT count(*) FROM scored s WHERE s.y = d.label) AS support,
         (SELECT count(*) FROM scored s WHERE s.pred = d.label) AS npred
       FROM dim d),
r1 AS (SELECT label, support,
         CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM r0),
rep AS (SELECT label, precision, recall,
         CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
         CAST(support AS BIGINT) AS support FROM r1)"""


def _class_report(spark, sf):
    r = M.class_report(scored(spark, sf), "y", "pred", CLASSES4)
    return r.select("label", _r6("precision").alias("precision"), _r6("recall").alias("recall"), _r6("f1").alias("f1"), "support")


register("a_class_report", sql=f"""
WITH {_SQL_SCORED}, {_SQL_REPORT}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep
""")(_class_report)


def _macro(spark, sf):
    m = M.macro_scores(M.class_report(scored(spark, sf), "y", "pred", CLASSES4))
    return m.select(*[_r6(c).alias(c) for c in m.columns])


register("a_macro_f1", sql=f"""
WITH {_SQL_SCORED}, {_SQL_REPORT}
SELECT round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM rep
""")(_macro)


register("a_balanced_acc", sql=f"""
WITH {_SQL_SCORED}
SELECT round(avg(r), 6) AS balanced_accuracy FROM (SELECT y, avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS r FROM scored GROUP BY y)
""")(lambda spark, sf: M.balanced_accuracy(scored(spark, sf), "y", "pred").select(_r6("balanced_accuracy").alias("balanced_accuracy")))


register("a_mcc", sql=f"""
WITH {_SQL_SCORED},
t AS (SELECT y AS k, count(*) AS t FROM scored GROUP BY y),
p AS (SELECT pred AS k, count(*) AS pk FROM scored GROUP BY pred),
tp AS (SELECT coalesce(p.pk, 0) AS pk, coalesce(t.t, 0) AS t FROM p FULL JOIN t USING (k)),
s AS (SELECT sum(pk * t)::DOUBLE AS pt, sum(pk * pk)::DOUBLE AS pp, sum(t * t)::DOUBLE AS tt FROM tp),
cs AS (SELECT sum(CASE WHEN y = pred THEN 1 ELSE 0 END)::DOUBLE AS c, count(*)::DOUBLE AS n FROM scored)
SELECT round(CASE WHEN sqrt((n * n - pp) * (n * n - tt)) > 0 THEN (c * n - pt) / sqrt((n * n - pp) * (n * n - tt)) ELSE 0.0 END, 6) AS mcc
FROM s CROSS JOIN cs
""")(lambda spark, sf: M.mcc(scored(spark, sf), "y", "pred").select(_r6("mcc").alias("mcc")))

# ------------------------------------------------------------------ A9, A10

_SQL_RANKED = f"""{_SQL_SCORED},
ex AS (SELECT y, CAST(generate_subscripts(probs, 1) - 1 AS BIGINT) AS cls, unnest(list_transform(probs, lambda v: round(v, 6))) AS score FROM scored),
cs AS (SELECT cls, score, sum(CASE WHEN y = cls THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y <> cls THEN 1 ELSE 0 END) AS neg
       FROM ex WHERE cls < 3 GROUP BY cls, score),
rk AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_lt, coalesce(sum(neg) OVER w, 0) AS neg_lt,
              sum(pos) OVER (PARTITION BY cls) AS P, sum(neg) OVER (PARTITION BY cls) AS N
       FROM cs WINDOW w AS (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _roc(spark, sf):
    r = M.roc_auc_ovr(scored(spark, sf, rounded=True), "y", "probs", 3)
    return r.select(F.col("cls").cast("long").alias("cls"), _r6("auc").alias("auc"))


register("a_roc_auc", sql=f"""
WITH {_SQL_RANKED}
SELECT cls, round(sum(pos * neg_lt + 0.5 * pos * neg) / (first(P) * first(N)), 6) AS auc
FROM rk GROUP BY cls HAVING first(P) > 0 AND first(N) > 0
""")(_roc)


def _pr(spark, sf):
    r = M.average_precision(scored(spark, sf, rounded=True), "y", "probs", 3)
    return r.select(F.col("cls").cast("long").alias("cls"), _r6("ap").alias("ap"))


register("a_pr_auc", sql=f"""
WITH {_SQL_RANKED}
SELECT cls, round(sum(pos / P * (P - pos_lt) / (P + N - pos_lt - neg_lt)), 6) AS ap FROM rk WHERE P > 0 GROUP BY cls
""")(_pr)

# ------------------------------------------------------------------ A11


def _focal(spark, sf):
    s = scored(spark, sf).withColumn("batch", F.floor(F.col("vec_id") / 32))
    alpha = M.class_weights(s, "y", CLASSES3)
    f = M.focal_loss(s, "y", "probs", gamma=2.0, alpha=alpha, batch="batch")
    plain = M.focal_loss(s, "y", "probs", gamma=2.0)
    return f.select(_r6("focal_loss").alias("focal_loss"), plain.select(_r6("focal_loss")).scalar().alias("focal_loss_mean"))


register("a_focal_loss", sql=f"""
WITH {_SQL_SCORED}, {_SQL_DIM3},
c AS (SELECT y AS label, count(*) AS n FROM scored GROUP BY y), t AS (SELECT count(*) AS n FROM scored),
w AS (SELECT d.label, CASE WHEN coalesce(c.n, 0) = 0 THEN 1.0 ELSE t.n / (3.0 * c.n) END AS weight FROM dim d LEFT JOIN c USING (label) CROSS JOIN t),
r AS (SELECT s.vec_id, floor(s.vec_id / 32) AS batch, -ln(s.probs[s.y + 1]) AS ce, w.weight FROM scored s LEFT JOIN w ON s.y = w.label),
l AS (SELECT batch, pow(1.0 - exp(-ce), 2.0) * ce * coalesce(weight, 1.0) AS fl, pow(1.0 - exp(-ce), 2.0) * ce AS fl0 FROM r)
SELECT (SELECT round(avg(b), 6) FROM (SELECT avg(fl) AS b FROM l GROUP BY batch)) AS focal_loss,
       (SELECT round(avg(fl0), 6) FROM l) AS focal_loss_mean
""")(_focal)

# ------------------------------------------------------------------ A12, A13, A15, A20


def _fold_metrics(spark, sf):
    """(trial, fold, value): per user (trial) and event-id fold, the mean
    value over non-error events; a fold with only errors failed (null)."""
    ev = table(spark, sf, "events")
    return (ev.groupBy(F.col("user_id").alias("trial"), (F.col("event_id") % 5).alias("fold"))
            .agg(F.avg(F.when(F.col("event_type") != "error", F.col("value"))).alias("value")))


_SQL_FOLDS = """folds AS (SELECT user_id AS trial, event_id % 5 AS fold, avg(CASE WHEN event_type <> 'error' THEN value END) AS value
                 FROM events GROUP BY 1, 2)"""


def _fold_avg(spark, sf):
    return M.fold_average(_fold_metrics(spark, sf), "trial", ["value"]).select("trial", _r6("value").alias("value"))


register("a_fold_avg", sql=f"""
WITH {_SQL_FOLDS}
SELECT trial, round(coalesce(avg(value), -1.0), 6) AS value FROM folds GROUP BY trial
""")(_fold_avg)


def _best_trial(spark, sf):
    avg = M.fold_average(_fold_metrics(spark, sf), "trial", ["value"]).withColumn("value", _r6("value"))
    return M.best_trial(avg, "trial", "value")


register("a_best_trial", sql=f"""
WITH {_SQL_FOLDS}, a AS (SELECT trial, round(coalesce(avg(value), -1.0), 6) AS value FROM folds GROUP BY trial)
SELECT trial, value FROM a ORDER BY value DESC, trial ASC LIMIT 1
""")(_best_trial)


def _batch_status(spark, sf):
    ev = table(spark, sf, "events")
    st = (F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "errored")
          .when(F.col("event_type") == "view", "processing").otherwise("canceled"))
    return M.batch_status(ev.select(st.alias("status")), "status")


register("a_batch_status", sql="""
SELECT count(*) FILTER (WHERE event_type = 'view') AS processing, count(*) FILTER (WHERE event_type = 'purchase') AS succeeded,
       count(*) FILTER (WHERE event_type = 'error') AS errored,
       count(*) FILTER (WHERE event_type IN ('view', 'purchase', 'error')) AS total
FROM events
""")(_batch_status)


def _split_report(spark, sf):
    d = C.split(table(spark, sf, "documents").select("doc_id"), (0.8, 0.1, 0.1), by="doc_id")
    return M.dataset_split_report(d, "split")


register("a_split_report", sql=f"""
WITH t AS (SELECT ({D.hash32('doc_id')} % 10000) / 10000.0 AS u FROM documents)
SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM t GROUP BY 1
""")(_split_report)

# ------------------------------------------------------------------ A14


def _rouge_pairs(spark, sf):
    from papertrail.plans.q_corpus import _qa_from_conversations

    qa = _qa_from_conversations(spark, sf)
    return qa.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair"), "question", "answer")


def _rouge_n(spark, sf):
    pairs = _rouge_pairs(spark, sf)
    outs = []
    for n in (1, 2):
        r = M.rouge_n(pairs, "pair", "answer", "question", n)
        outs.append(r.select("pair", F.lit(n).cast("long").alias("n"), _r6("precision").alias("precision"),
                             _r6("recall").alias("recall"), _r6("fmeasure").alias("fmeasure")))
    return outs[0].unionByName(outs[1])


_TOK = "list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


def _sql_rouge(n: int) -> str:
    def grams(x):
        t = _TOK.format(x=x)
        if n == 1:
            return t
        return (f"CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n - 2}), "
                f"lambda i: array_to_string({t}[i:i + {n - 1}], ' ')) ELSE [] END")
    return f"""
gp{n} AS (SELECT pair, g, count(*) AS cp FROM (SELECT pair, unnest({grams('answer')}) AS g FROM pairs) GROUP BY 1, 2),
gr{n} AS (SELECT pair, g, count(*) AS cr FROM (SELECT pair, unnest({grams('question')}) AS g FROM pairs) GROUP BY 1, 2),
ov{n} AS (SELECT pair, sum(least(cp, cr)) AS overlap FROM gp{n} JOIN gr{n} USING (pair, g) GROUP BY pair),
b{n} AS (SELECT p.pair, coalesce((SELECT sum(cp) FROM gp{n} WHERE gp{n}.pair = p.pair), 0) AS np,
                coalesce((SELECT sum(cr) FROM gr{n} WHERE gr{n}.pair = p.pair), 0) AS nr, coalesce(o.overlap, 0) AS overlap
         FROM pairs p LEFT JOIN ov{n} o USING (pair)),
s{n} AS (SELECT pair, CASE WHEN np > 0 THEN overlap / np ELSE 0.0 END AS precision,
                CASE WHEN nr > 0 THEN overlap / nr ELSE 0.0 END AS recall FROM b{n})"""


register("a_rouge_n", sql=f"""
WITH pairs AS (
  SELECT CAST(u.conv_id AS VARCHAR) || '_' || CAST(u.turn AS VARCHAR) AS pair, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn AND a.role = 'assistant'
  WHERE u.role = 'user'),
{_sql_rouge(1)},
{_sql_rouge(2)}
SELECT pair, CAST(1 AS BIGINT) AS n, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS fmeasure FROM s1
UNION ALL
SELECT pair, CAST(2 AS BIGINT) AS n, round(precision, 6), round(recall, 6),
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) FROM s2
""")(_rouge_n)


# ------------------------------------------------------------------ A17, F21, F22, F30


def _pool(how):
    def q(spark, sf):
        e = table(spark, sf, "embeddings")
        p = M.pool_windows(e, "label", "embedding", how)
        return p.select(F.col("label").cast("long").alias("label"), F.col("pos").cast("long").alias("pos"), _r6("value").alias("value"))
    return q


_SQL_POOL = """
SELECT CAST(label AS BIGINT) AS label, pos, round({fn}(v), 6) AS value FROM (
  SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
GROUP BY label, pos
"""
register("a_pool_mean", sql=_SQL_POOL.format(fn="avg"))(_pool("mean"))
register("a_pool_max", sql=_SQL_POOL.format(fn="max"))(_pool("max"))


def _softmax(spark, sf):
    s = scored(spark, sf)
    return s.select("vec_id", "pred", _r6("conf").alias("confidence"),
                    *[_r6(F.element_at("probs", i + 1)).alias(f"p{i}") for i in range(3)])


register("f_softmax", sql=f"""
WITH {_SQL_SCORED}
SELECT vec_id, pred, round(conf, 6) AS confidence, round(probs[1], 6) AS p0, round(probs[2], 6) AS p1, round(probs[3], 6) AS p2 FROM scored
""")(_softmax)


def _l2(spark, sf):
    from papertrail.operators.retrieval import l2_normalize

    e = table(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x, i: x * (F.lit(1.0) + i.cast("double")))
    n = e.select("vec_id", l2_normalize(scaled).alias("u"))
    return n.select("vec_id", F.posexplode("u").alias("pos", "v")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), _r6("v").alias("value"))


register("f_l2", sql="""
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM s)
SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS pos,
       unnest(list_transform(v, lambda x: round(CASE WHEN norm > 0 THEN x / norm ELSE 0.0 END, 6))) AS value FROM n
""")(_l2)


def _one_hot(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.select("doc_id", F.posexplode(M.one_hot("quality", 3)).alias("cls", "v")).select(
        "doc_id", F.col("cls").cast("long").alias("cls"), F.col("v").cast("long").alias("v"))


register("f_one_hot", sql="""
SELECT doc_id, CAST(c AS BIGINT) AS cls, CAST(CASE WHEN quality = c THEN 1 ELSE 0 END AS BIGINT) AS v
FROM labels CROSS JOIN range(3) t(c)
""")(_one_hot)

# ------------------------------------------------------------------ W7


def _early_stop(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    r = M.early_stop(ev, "user_id", ["ts", "event_id"], "value", patience=3)
    return r.select("user_id", F.col("best_epoch").cast("long").alias("best_epoch"), "best_value",
                    F.col("stop_epoch").cast("long").alias("stop_epoch"))


register("w_early_stop", sql="""
WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
                  max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
           FROM events),
b AS (SELECT *, best_before IS NULL OR value > best_before AS improved FROM a),
c AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM b),
s AS (SELECT user_id, min(epoch) AS stop_epoch FROM c WHERE epoch - last_imp >= 3 GROUP BY user_id),
l AS (SELECT c.*, s.stop_epoch FROM c LEFT JOIN s USING (user_id) WHERE s.stop_epoch IS NULL OR c.epoch <= s.stop_epoch)
SELECT user_id, CAST(max(epoch) AS BIGINT) AS best_epoch, arg_max(value, epoch) AS best_value, CAST(first(stop_epoch) AS BIGINT) AS stop_epoch
FROM l WHERE improved GROUP BY user_id
""")(_early_stop)
