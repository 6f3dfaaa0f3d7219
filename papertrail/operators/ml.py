"""Text classification with Spark ML (M1, M2) and the majority baseline (M5);
:mod:`papertrail.operators.linear` trains many focal-loss models in one scan.

The encoder fine-tuning of the original workflow is replaced by a
distributed pipeline: word tokens → hashed term frequencies → IDF →
multinomial logistic regression with class weights (N / (K·count_c)).
Training, scoring and cross-validation are Spark ML jobs; nothing is
collected to the driver except model coefficients.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.operators import metrics as M


def text_pipeline(text: str = "text", label: str = "label", num_features: int = 1 << 18, reg: float = 0.0,
                  max_iter: int = 50, weight: str | None = "weight") -> Pipeline:
    tok = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+", toLowercase=True, minTokenLength=1)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol=label, family="multinomial", regParam=reg, maxIter=max_iter)
    if weight:
        lr.setWeightCol(weight)
    return Pipeline(stages=[tok, tf, idf, lr])


def with_class_weights(df: DataFrame, label: str, classes) -> DataFrame:
    w = M.class_weights(df, label, classes)
    # one row per class; a label outside ``classes`` keeps weight 1
    j = df.join(F.broadcast(w.select(F.col("label").alias("_l"), F.col("weight"))), F.col(label) == F.col("_l"), "left").drop("_l")
    return j.fillna(1.0, ["weight"])


def train_text_classifier(df: DataFrame, text: str, label: str, classes, weight: bool = True, reg: float = 0.0,
                          max_iter: int = 50) -> PipelineModel:
    """Fit the pipeline; class weights come from the training rows only (M1)."""
    d = df.filter(F.coalesce(F.length(strip_col(text)), F.lit(0)) > 0)  # training drops empty content
    if weight:
        d = with_class_weights(d, label, classes)
    return text_pipeline(text, label, reg=reg, max_iter=max_iter, weight="weight" if weight else None).fit(d)


def strip_col(c):
    from papertrail.functions.text import strip
    return strip(F.col(c))


def classify(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds probs (array), predicted_label (int, first max wins) and
    confidence (max probability) (M2)."""
    out = model.transform(df).withColumn("probs", vector_to_array(F.col("probability")))
    out = out.withColumn("confidence", F.array_max("probs"))
    out = out.withColumn("predicted_label", (F.array_position("probs", F.col("confidence")) - 1).cast("int"))
    return out.drop("_tokens", "_tf", "features", "rawPrediction", "probability", "prediction")


def evaluate(pred: DataFrame, y: str, p: str, classes) -> DataFrame:
    """One row: accuracy, macro precision/recall/F1, balanced accuracy, MCC, n."""
    return M.evaluation(pred, y, p, classes)


def baseline_predictions(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Majority-class scorer (M5): predicts the most frequent training
    class (ties → lowest class) for every test row."""
    maj = (train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
           .agg(F.max_by(label, F.struct("n", -F.col(label))).alias("m")))
    return test.withColumn("predicted_label", maj.select("m").scalar())
