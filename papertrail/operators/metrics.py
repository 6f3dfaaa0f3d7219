"""Evaluation metrics as aggregations.

Every metric is a combinable aggregate over (label, prediction) or
(class, score) groups: map-side partial aggregation means a class that
holds a third of all rows still costs one row per map task.  The ranking
metrics (ROC-AUC, average precision) first collapse rows to distinct
(class, score) counts and then use :func:`papertrail.operators.scan.prefix_scan`
for the running counts.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail.functions._col import col_of, let
from papertrail.functions.stem import stems
from papertrail.operators.scan import prefix_scan
from papertrail.operators.sizing import checked_broadcast


def class_dim(spark, classes, name: str = "label") -> DataFrame:
    """The fixed list of class labels as a one-column table."""
    return spark.createDataFrame([(int(c),) for c in classes], f"{name} long")


# ------------------------------------------------------------------ A1-A3


def label_counts(df: DataFrame, label: str, classes) -> DataFrame:
    """(label, count), zero-filled for classes that never occur (A1)."""
    dim = class_dim(df.sparkSession, classes, "label")
    cnt = df.groupBy(F.col(label).cast("long").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    return dim.join(cnt, "label", "left").select("label", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def prediction_stats(df: DataFrame, label: str, conf: str, classes) -> DataFrame:
    """(label, count, pct, avg_confidence) with pct = count/total·100 (A2).

    avg_confidence is the mean over all predictions (same on every row).
    """
    lc = label_counts(df, label, classes)
    tot = df.agg(F.count(F.lit(1)).alias("n"), F.avg(col_of(conf)).alias("c"))
    n = tot.select("n").scalar()
    c = tot.select("c").scalar()
    return lc.select("label", "count",
                     F.when(n > 0, F.col("count") * F.lit(100.0) / n).otherwise(F.lit(0.0)).alias("pct"),
                     c.alias("avg_confidence"))


def class_weights(df: DataFrame, label: str, classes) -> DataFrame:
    """weight_c = N / (K · count_c); 1.0 when the class is absent (A3)."""
    k = len(classes)
    lc = label_counts(df, label, classes)
    n = df.select(F.count(F.lit(1))).scalar()
    return lc.select("label", F.when(F.col("count") == 0, F.lit(1.0))
                     .otherwise(n / (F.lit(float(k)) * F.col("count"))).alias("weight"))


# ------------------------------------------------------------------ A4-A8


def confusion_matrix(df: DataFrame, y: str, p: str, classes) -> DataFrame:
    """Rows = true label, one ``p_<c>`` column per predicted class (A4)."""
    dim = class_dim(df.sparkSession, classes, "label")
    piv = (df.groupBy(F.col(y).cast("long").alias("label"))
           .pivot(p, list(classes)).agg(F.count(F.lit(1))))
    for c in classes:
        if str(c) not in piv.columns:
            piv = piv.withColumn(str(c), F.lit(None).cast("long"))
    out = dim.join(piv, "label", "left")
    return out.select("label", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(f"p_{c}") for c in classes])


def confusion_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).cast("long").alias("y"), F.col(p).cast("long").alias("p")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((col_of(y) == col_of(p)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def class_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, tp, support, pred) of every class that occurs, from one pass over
    ``df``: its confusion counts feed both the true and the predicted side."""
    cc = confusion_counts(df, y, p)
    zero = F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero).alias("tp"),
                             F.col("n").alias("support"), zero.alias("pred")),
                    F.struct(F.col("p").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("pred")))
    return cc.select(F.explode(sides).alias("s")).select("s.*").groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("pred").alias("pred"))


def _ratio(a, b) -> Column:
    return F.when(col_of(b) > 0, col_of(a) / col_of(b)).otherwise(F.lit(0.0))


def _with_scores(counts: DataFrame) -> DataFrame:
    r = counts.withColumn("precision", _ratio("tp", "pred")).withColumn("recall", _ratio("tp", "support"))
    return r.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_report(df: DataFrame, y: str, p: str, classes) -> DataFrame:
    """precision, recall, f1, support per class; 0 on zero division."""
    dim = class_dim(df.sparkSession, classes, "label")
    r = _with_scores(dim.join(class_counts(df, y, p), "label", "left").fillna(0, ["tp", "support", "pred"]))
    return r.select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))


def evaluation(df: DataFrame, y: str, p: str, classes) -> DataFrame:
    """One row, from one pass over ``df``: accuracy, n_test, macro precision,
    recall and F1 over ``classes``, balanced accuracy, mcc."""
    dim = class_dim(df.sparkSession, classes, "label").withColumn("listed", F.lit(True))
    r = _with_scores(dim.join(class_counts(df, y, p), "label", "full").fillna(0, ["tp", "support", "pred"]))
    n, c = F.sum("support"), F.sum("tp")
    macro = [F.avg(F.when(F.col("listed"), F.col(m))).alias(f"{m}_macro") for m in ("precision", "recall", "f1")]
    sums = [F.sum(F.col(x) * F.col(z)).cast("double").alias(k) for k, x, z in (
        ("pt", "pred", "support"), ("pp", "pred", "pred"), ("tt", "support", "support"))]
    one = r.agg((c / n).alias("accuracy"), n.alias("n_test"), c.cast("double").alias("c"), n.cast("double").alias("s"), *macro, *sums,
                F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return one.select("accuracy", "n_test", "precision_macro", "recall_macro", "f1_macro", "balanced_accuracy",
                      F.when(den > 0, (F.col("c") * F.col("s") - F.col("pt")) / den).otherwise(F.lit(0.0)).alias("mcc"))


def evaluation_row(df: DataFrame, y: str, p: str, probs: str, classes, alpha: DataFrame | None = None, gamma: float = 2.0,
                   batch: str | None = None) -> DataFrame:
    """One row with every figure of an evaluation (M5): test_loss (focal, mean of
    batch means where ``batch`` is given), accuracy, n_test, macro precision,
    recall and F1, F1 per class, balanced accuracy, mcc, and the macro averages
    of one-vs-rest ROC-AUC and average precision.

    ``classes`` are 0 .. k-1, the positions of ``probs``; ``alpha``: (label,
    weight).  Classes without positives or negatives are left out of the AUC.
    """
    k = len(classes)
    if list(classes) != list(range(k)):
        raise ValueError("classes must be the positions of probs")
    per = _per_class_ranks(_ranked_counts(df, y, probs, k)).agg(F.avg("auc").alias("roc_auc_macro"), F.avg("ap").alias("pr_auc_macro"))
    report = class_report(df, y, p, classes)
    f1 = report.agg(*[F.max(F.when(F.col("label") == c, F.col("f1"))).alias(f"f1_{c}") for c in classes])
    loss = focal_loss(df, y, probs, gamma, alpha, batch=batch).withColumnRenamed("focal_loss", "test_loss")
    one = evaluation(df, y, p, classes)
    for other in (f1, per, loss):  # each has one row
        one = one.crossJoin(F.broadcast(other))
    return one


def macro_scores(report: DataFrame) -> DataFrame:
    """Macro and support-weighted averages of a class report."""
    tot = F.sum("support")
    return report.agg(F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
                      F.avg("f1").alias("f1_macro"),
                      (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1_weighted"))


def balanced_accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean recall over the classes present in ``y``."""
    per = df.groupBy(col_of(y).alias("_y")).agg(F.avg((col_of(y) == col_of(p)).cast("double")).alias("r"))
    return per.agg(F.avg("r").alias("balanced_accuracy"))


def mcc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Multiclass Matthews correlation (A8):
    (c·s − Σ p_k t_k) / sqrt((s² − Σ p_k²)(s² − Σ t_k²)), 0 if undefined."""
    return evaluation(df, y, p, []).select("mcc")


# ------------------------------------------------------------------ A9-A10


def one_hot(label, k: int) -> Column:
    """[int(label = 0), …, int(label = k-1)]."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (col_of(label) == i).cast("int"))


def class_scores(df: DataFrame, y: str, probs: str, k: int) -> DataFrame:
    """(cls, score, pos, neg): one-vs-rest counts per distinct score."""
    ex = df.select(col_of(y).alias("_y"), F.posexplode(col_of(probs)).alias("cls", "score"))
    ex = ex.filter(F.col("cls") < k)
    return (ex.groupBy("cls", "score")
            .agg(F.sum((F.col("_y") == F.col("cls")).cast("long")).alias("pos"),
                 F.sum((F.col("_y") != F.col("cls")).cast("long")).alias("neg")))


def _ranked_counts(df: DataFrame, y: str, probs: str, k: int) -> DataFrame:
    cs = class_scores(df, y, probs, k)
    scanned = prefix_scan(cs, ["cls"], ["score"], {"pos_lt": ("sum", "pos"), "neg_lt": ("sum", "neg")},
                          inclusive=False)
    tot = cs.groupBy("cls").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return scanned.join(F.broadcast(tot), "cls")  # one row per class


def _per_class_ranks(ranked: DataFrame) -> DataFrame:
    """(cls, auc, ap) from one scan of the ranked counts; null where undefined."""
    ge_pos = F.col("P") - F.col("pos_lt")
    ge_all = F.col("P") + F.col("N") - F.col("pos_lt") - F.col("neg_lt")
    pairs = F.col("pos") * F.col("neg_lt") + F.lit(0.5) * F.col("pos") * F.col("neg")
    return ranked.groupBy("cls", "P", "N").agg(F.sum(pairs).alias("won"), F.sum(F.col("pos") * ge_pos / ge_all).alias("gained")).select(
        "cls", F.try_divide("won", F.col("P") * F.col("N")).alias("auc"), F.try_divide("gained", F.col("P")).alias("ap"))


def roc_auc_ovr(df: DataFrame, y: str, probs: str, k: int) -> DataFrame:
    """Per-class one-vs-rest ROC-AUC (rank form, ties count one half)."""
    r = _ranked_counts(df, y, probs, k)
    term = F.col("pos") * F.col("neg_lt") + F.lit(0.5) * F.col("pos") * F.col("neg")
    per = r.groupBy("cls").agg((F.sum(term) / (F.first("P") * F.first("N"))).alias("auc"),
                               F.first("P").alias("P"), F.first("N").alias("N"))
    return per.filter((F.col("P") > 0) & (F.col("N") > 0)).select("cls", "auc")


def roc_auc_ovr_macro(df: DataFrame, y: str, probs: str, k: int) -> DataFrame:
    return roc_auc_ovr(df, y, probs, k).agg(F.avg("auc").alias("roc_auc_macro"))


def average_precision(df: DataFrame, y: str, probs: str, k: int) -> DataFrame:
    """Per-class AP: Σ over score thresholds (desc, ties grouped) of
    (R_n − R_{n−1})·P_n (A10)."""
    r = _ranked_counts(df, y, probs, k)
    ge_pos = F.col("P") - F.col("pos_lt")
    ge_all = F.col("P") + F.col("N") - F.col("pos_lt") - F.col("neg_lt")
    term = F.col("pos") / F.col("P") * ge_pos / ge_all
    per = r.filter(F.col("P") > 0).groupBy("cls").agg(F.sum(term).alias("ap"))
    return per


def pr_auc_macro(df: DataFrame, y: str, probs: str, k: int) -> DataFrame:
    return average_precision(df, y, probs, k).agg(F.avg("ap").alias("pr_auc_macro"))


# ------------------------------------------------------------------ A11


def focal_loss(df: DataFrame, y: str, probs: str, gamma: float = 2.0, alpha: DataFrame | None = None,
               reduction: str = "mean", batch: str | None = None) -> DataFrame:
    """ce = −ln p_true; loss = (1 − e^−ce)^γ · ce · α_label.

    ``alpha``: optional (label, weight) table.  ``batch``: the reported
    loss is the mean of per-batch means.  ``reduction="none"`` returns
    the per-row loss column.
    """
    d = df
    p_true = F.element_at(col_of(probs), (col_of(y) + 1).cast("int"))
    ce = -F.log(p_true.cast("double"))
    loss = F.pow(F.lit(1.0) - F.exp(-ce), F.lit(gamma)) * ce
    if alpha is not None:
        d = d.join(F.broadcast(alpha.select(F.col("label").alias("_al"), F.col("weight").alias("_aw"))),
                   col_of(y) == F.col("_al"), "left")
        loss = loss * F.coalesce(F.col("_aw"), F.lit(1.0))
    d = d.withColumn("focal_loss", loss)
    if reduction == "none":
        return d.drop("_al", "_aw")
    agg = F.avg if reduction == "mean" else F.sum
    if batch is None:
        return d.agg(agg("focal_loss").alias("focal_loss"))
    per = d.groupBy(batch).agg(agg("focal_loss").alias("b"))
    return per.agg(F.avg("b").alias("focal_loss"))


# ------------------------------------------------------------------ A12, A13, A15, A20


def fold_average(df: DataFrame, trial: str, metrics: list) -> DataFrame:
    """Mean of each metric over folds; null (failed) folds skipped,
    −1.0 when every fold failed (A12)."""
    return df.groupBy(trial).agg(*[F.coalesce(F.avg(m), F.lit(-1.0)).alias(m) for m in metrics])


def best_trial(df: DataFrame, trial: str, value: str, params: list | None = None) -> DataFrame:
    """The trial with the largest value; ties → lowest trial number."""
    key = F.struct(F.col(value), -F.col(trial))
    cols = [trial, value] + list(params or [])
    best = df.agg(F.max_by(F.struct(*[F.col(c) for c in cols]), key).alias("b"))
    return best.select("b.*")


def batch_status(df: DataFrame, status: str) -> DataFrame:
    """succeeded / errored / processing counts; total = the sum of the three."""
    s = col_of(status)
    agg = df.agg(F.count_if(s == "processing").alias("processing"), F.count_if(s == "succeeded").alias("succeeded"),
                 F.count_if(s == "errored").alias("errored"))
    return agg.withColumn("total", F.col("processing") + F.col("succeeded") + F.col("errored"))


def dataset_split_report(df: DataFrame, split: str) -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ A17, F21


def pool_windows(df: DataFrame, doc: str, vec: str, how: str = "mean", mask: str | None = None) -> DataFrame:
    """Element-wise mean or max of the window vectors of a document.

    Windows whose mask sums to 0 (padding) are excluded.  Returns
    (doc, pos, value): one row per vector position; :func:`collect_vector`
    turns it back into an array.
    """
    d = df
    if mask is not None:
        d = d.filter(F.aggregate(col_of(mask), F.lit(0), lambda a, x: a + x) > 0)
    ex = d.select(col_of(doc).alias(doc), F.posexplode(col_of(vec)).alias("pos", "v"))
    fn = F.avg if how == "mean" else F.max
    return ex.groupBy(doc, "pos").agg(fn(F.col("v").cast("double")).alias("value"))


def collect_vector(df: DataFrame, key: str, pos: str = "pos", value: str = "value", out: str = "vec") -> DataFrame:
    """(key, pos, value) → (key, array ordered by pos); bounded by the vector width."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"),
                                                                                 F.col(value).alias("v")))),
                                           lambda s: s["v"]).alias(out))


def softmax(logits) -> Column:
    x = F.transform(col_of(logits), lambda v: v.cast("double"))
    e = let(x, lambda xs: let(F.array_max(xs), lambda m: F.transform(xs, lambda v: F.exp(v - m))))
    return let(e, lambda es: let(F.aggregate(es, F.lit(0.0), lambda a, v: a + v),
                                 lambda tot: F.transform(es, lambda v: v / tot)))


def softmax_argmax(logits) -> Column:
    """struct(probs, label, confidence): argmax, first wins on ties."""
    def pick(p):
        conf = F.array_max(p)
        label = (F.array_position(p, conf) - 1).cast("int")
        return F.struct(p.alias("probs"), label.alias("label"), conf.alias("confidence"))
    return let(softmax(logits), pick)


def early_stop(df: DataFrame, run: str, order: list, metric: str, patience: int) -> DataFrame:
    """Early stopping over an epoch log.

    Per run: epoch number (1-based, in ``order``), running best before
    the epoch, improvement flag (strictly better), epochs since the last
    improvement; the run stops at the first epoch where that gap reaches
    ``patience``.  Returns (run, best_epoch, best_value, stop_epoch).
    """
    b = prefix_scan(df, [run], order, {"epoch": ("sum", F.lit(1), True), "_best_before": ("max", metric, False)})
    b = b.withColumn("improved", F.col("_best_before").isNull() | (F.col(metric) > F.col("_best_before")))
    c = prefix_scan(b, [run], order, {"last_imp": ("max", F.when(F.col("improved"), F.col("epoch")))}, inclusive=True)
    c = c.withColumn("gap", F.col("epoch") - F.col("last_imp"))
    stop = c.filter(F.col("gap") >= patience).groupBy(run).agg(F.min("epoch").alias("stop_epoch"))
    c = c.join(stop, run, "left")
    live = c.filter(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch")))
    best = live.filter("improved").groupBy(run).agg(F.max_by(F.struct("epoch", F.col(metric).alias("v")), "epoch").alias("b"),
                                                    F.first("stop_epoch").alias("stop_epoch"))
    return best.select(run, F.col("b.epoch").alias("best_epoch"), F.col("b.v").alias("best_value"), "stop_epoch")


def rouge_tokens(c) -> Column:
    """ROUGE tokenisation: lower case, runs of [a-z0-9] (no stemming)."""
    return F.filter(F.split(F.regexp_replace(F.lower(col_of(c)), "[^a-z0-9]+", " "), " "), lambda t: F.length(t) > 0)


def ngrams(tokens, n: int) -> Column:
    if n == 1:
        return col_of(tokens)

    def grams(t):
        cnt = F.greatest(F.size(t) - F.lit(n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), cnt), lambda i: F.array_join(F.slice(t, i, n), " "))
    return let(col_of(tokens), grams)


def rouge_n(df: DataFrame, pair: str, pred: str, ref: str, n: int) -> DataFrame:
    """(pair, precision, recall, fmeasure) of ROUGE-N."""
    return rouge_n_tokens(df.select(pair, rouge_tokens(pred).alias("tp"), rouge_tokens(ref).alias("tr")), pair, "tp", "tr", n)


def rouge_n_tokens(df: DataFrame, pair: str, pred: str, ref: str, n: int) -> DataFrame:
    """:func:`rouge_n` of token arrays."""
    from papertrail.operators.retrieval import term_freqs

    def grams(col):
        return let(col_of(col), lambda t: F.when(F.size(t) >= n, ngrams(t, n)).otherwise(F.array().cast("array<string>")))

    def shared(a, b):
        """Sum of the smaller counts: both sides' counts in one sorted array, where
        equal n-grams are neighbours."""
        state = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("sum"))
        return F.aggregate(F.array_sort(F.concat(a, b)), state, lambda s, x: F.struct(
            x["term"].alias("term"), x["tf"].alias("tf"),
            (s["sum"] + F.when(s["term"] == x["term"], F.least(s["tf"], x["tf"])).otherwise(F.lit(0))).alias("sum")), lambda s: s["sum"])

    d = df.select(F.col(pair), grams(pred).alias("gp"), grams(ref).alias("gr"))
    d = d.select(pair, F.size("gp").alias("np"), F.size("gr").alias("nr"), shared(term_freqs("gp"), term_freqs("gr")).alias("overlap"))
    out = d.withColumn("precision", _ratio("overlap", "np")).withColumn("recall", _ratio("overlap", "nr"))
    f = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("fmeasure", f).select(pair, "precision", "recall", "fmeasure")


LCS_BITS = 62  # tokens in a block: two blocks and a carry stay below 2**63


def lcs_length(a, b) -> Column:
    """Length of the longest common subsequence of two token arrays.

    Bit-parallel: ``a`` lies in blocks of bits, all set; each token of ``b`` adds
    the bits that are set where ``a`` has it, carrying from block to block, which
    clears one bit for every token that the subsequence gains.  A row costs
    len(b) * len(a) / 62 steps, and one comparison for each token of ``a`` and
    distinct token of ``b`` to mark where it stands."""
    ones = F.lit((1 << LCS_BITS) - 1)
    none = F.array().cast("array<bigint>")

    def masks(x, y):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / LCS_BITS).cast("int")),
                             lambda k: F.slice(x, k * LCS_BITS + 1, LCS_BITS))

        def bits(block, t):
            marks = F.transform(block, lambda u, i: F.when(u == t, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
            return F.aggregate(marks, F.lit(0).cast("bigint"), lambda acc, m: acc.bitwiseOR(m))
        shared = F.array_intersect(x, y)
        return let(blocks, lambda bl: F.map_from_entries(F.transform(shared, lambda t: F.struct(t, F.transform(bl, lambda one: bits(one, t))))))

    def step(v, mask):
        def add(state, i):
            old, on = F.get(v, i), F.get(mask, i)
            total = old + old.bitwiseAND(on) + state["carry"]
            kept = total.bitwiseAND(ones).bitwiseOR(old.bitwiseAND(F.bitwise_not(on)))
            return F.struct(F.shiftright(total, LCS_BITS).alias("carry"), F.concat(state["v"], F.array(kept)).alias("v"))
        start = F.struct(F.lit(0).cast("bigint").alias("carry"), none.alias("v"))
        return F.aggregate(F.sequence(F.lit(0), F.size(v) - 1), start, add, lambda s: s["v"])

    def length(x, y, at):
        v = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / LCS_BITS).cast("int")), lambda _: ones)
        known = F.filter(F.transform(y, lambda t: at[t]), lambda m: m.isNotNull())
        end = F.aggregate(known, v, step)
        return F.aggregate(end, F.lit(0).cast("bigint"), lambda acc, x: acc + LCS_BITS - F.bit_count(x))

    x, y = col_of(a), col_of(b)
    found = let(masks(x, y), lambda at: length(x, y, at))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), found).otherwise(F.lit(0).cast("bigint"))


def rouge_l(df: DataFrame, pair: str, pred: str, ref: str) -> DataFrame:
    """ROUGE-L F-measure per pair (LCS), inside the row."""
    return rouge_l_tokens(df.select(pair, rouge_tokens(pred).alias("tp"), rouge_tokens(ref).alias("tr")), pair, "tp", "tr")


def rouge_l_tokens(df: DataFrame, pair: str, pred: str, ref: str) -> DataFrame:
    """:func:`rouge_l` of token arrays."""
    d = df.select(pair, F.size(pred).alias("np"), F.size(ref).alias("nr"), lcs_length(pred, ref).alias("lcs"))
    out = d.withColumn("precision", _ratio("lcs", "np")).withColumn("recall", _ratio("lcs", "nr"))
    f = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("fmeasure", f).select(pair, "precision", "recall", "fmeasure")


def stemmed_tokens(df: DataFrame, key: str, cols: list, max_broadcast_words: int = 500_000) -> DataFrame:
    """``key`` (unique) and the token arrays ``cols`` with every word of more than
    three letters replaced by its stem.

    Words are stemmed once each: the distinct vocabulary goes through the stemmer
    and is joined back, by broadcast up to ``max_broadcast_words`` words."""
    side = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).alias("tokens")) for i, c in enumerate(cols)])).alias("s")
    t = df.select(F.col(key).alias("_key"), side).select("_key", "s.col", F.posexplode("s.tokens").alias("pos", "word")).checkpoint()
    words = t.select("word").filter(F.length("word") > 3).distinct()
    known = stems(words).checkpoint()  # a filter here would be pushed below the steps and copy them
    t = t.join(checked_broadcast(known, max_broadcast_words), "word", "left").withColumn("stem", F.coalesce("stem", "word"))
    lists = [F.array_sort(F.collect_list(F.when(F.col("col") == i, F.struct("pos", "stem")))).alias(c) for i, c in enumerate(cols)]
    back = t.groupBy("_key").agg(*lists)
    empty = F.array().cast("array<string>")
    out = df.select(F.col(key).alias("_key")).join(back, "_key", "left")
    return out.select(F.col("_key").alias(key), *[F.coalesce(F.transform(c, lambda x: x["stem"]), empty).alias(c) for c in cols])
