"""Labelled sets, an exact stratified split, training, evaluation, saved models, the run log."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, HashingTF, IDF, RegexTokenizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siren import lexicons as L
from siren.functions.text import WORD_CHARS, _col, clean_text
from siren.operators.enrich import rule_classify
from siren.operators.lookup import lookup_join, spread, written

# Settings of a training run (fixed values).
SEED = 42
TEST_SHARE = 0.2


def labelled_set(*texts_by_label: DataFrame) -> DataFrame:
    """One labelled table from a table of texts per label, in label order."""
    parts = [df.select("text", F.lit(label).alias("label")) for label, df in enumerate(texts_by_label)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def label_id(category: str | Column) -> Column:
    """0, 1, 2 for the three categories."""
    return (F.array_position(F.array(*[F.lit(label) for label in L.LABELS]), _col(category)) - 1).cast("int")


def weak_labels(df: DataFrame, text: str = "content") -> DataFrame:
    """Label every text by the rules; a labelled set for data nobody has labelled."""
    labelled = rule_classify(df.withColumn("_clean", clean_text(text)), "_clean")
    return labelled.select(*df.columns, label_id("category").alias("label"))


def stratified_split(
    df: DataFrame, key: str, label: str = "label", share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add ``split``: exactly ``round(share * n)`` rows of each label are "test", the rest "train".

    Exactly where keys are unique: rows that repeat a key are always on the same side.

    The test rows are those with the smallest (md5 of seed and key, key). Ranking a label's rows in one window would
    put a whole label into one task. Instead, counts per hash bucket (at most 65,536 per label) give the bucket that
    holds the last test row, and only that bucket is ranked. Each label then has one threshold, which every row is
    compared with where it is.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    hashed = hashed.withColumn("_bucket", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))

    counts = hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("n"))
    per_label = Window.partitionBy(label)
    running = counts.select(
        label, "_bucket", "n",
        F.sum("n").over(per_label.orderBy("_bucket")).alias("upto"),
        F.round(F.sum("n").over(per_label) * share).cast("long").alias("wanted"),
    )
    cuts = running.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted"))).select(
        label, F.col("_bucket").alias("_cut"), (F.col("wanted") - F.col("upto") + F.col("n")).alias("_take")
    )
    at_cut = lookup_join(hashed, written(cuts, "split-buckets"), label, key, how="inner").where("_bucket = _cut")
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_hash", key))
    last = at_cut.withColumn("_rank", rank).where("_rank = _take").select(
        label, F.col("_hash").alias("_last_hash"), F.col(key).alias("_last_key")
    )
    marked = lookup_join(hashed, written(last, "split-thresholds"), label, key)
    is_test = F.struct(F.col("_hash"), F.col(key)) <= F.struct("_last_hash", "_last_key")
    # A label with nothing to take has no threshold: all of it is training data.
    split = F.when(F.col("_last_hash").isNotNull() & is_test, "test").otherwise("train")
    return marked.withColumn("split", split).select(*df.columns, "split")


def tokenize(text: str | Column, max_tokens: int | None = None) -> Column:
    """Lower-case word tokens; ``max_tokens`` keeps the first ones."""
    tokens = F.regexp_extract_all(F.lower(_col(text)), F.lit(f"([{WORD_CHARS}]+)"), F.lit(1))
    return tokens if max_tokens is None else F.slice(tokens, 1, max_tokens)


def build_pipeline(text: str = "text", label: str = "label", features: int = 1 << 16, max_iter: int = 20) -> Pipeline:
    """Tokens, hashed term weights, multinomial logistic regression."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="tokens", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, family="multinomial", maxIter=max_iter),
    ])


def train_classifier(
    df: DataFrame,
    text: str = "text",
    label: str = "label",
    reg_params: Sequence[float] = (0.001, 0.01, 0.1),
    features: int = 1 << 16,
    max_iter: int = 20,
    seed: int = SEED,
) -> PipelineModel:
    """Fit the candidate that does best, by weighted F1, on texts held out of its training; it is fitted on all texts.

    A fifth of each label's texts is held out by their digests (``stratified_split``), copies of a text together, so
    the choice is the same in every run. The first candidate wins a tie. Texts are cut into words once; all fits read the counts.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, F.col(label).cast("double").alias(label))
    rows = spread(written(rows, "labelled-texts"))
    tokens, counts, weights, regression = build_pipeline(text, label, features, max_iter).getStages()
    counted = counts.transform(tokens.transform(rows)).select(F.sha2(text, 256).alias("_digest"), label, counts.getOutputCol())
    counted = written(counted, "word-counts")

    def fitted(reg_param: float, counted: DataFrame) -> PipelineModel:
        return Pipeline(stages=[weights, regression.copy({regression.regParam: reg_param})]).fit(counted)

    best = reg_params[0]
    if len(reg_params) > 1:
        split = stratified_split(counted.select("_digest", label).distinct(), "_digest", label, seed=seed)
        marked = written(counted.join(split, ["_digest", label]), "split-counts")
        train, held = (marked.where(F.col("split") == part).drop("_digest", "split") for part in ("train", "test"))
        scores = [eval_metrics(fitted(reg_param, train).transform(held), label).first()["f1"] or 0.0 for reg_param in reg_params]
        best = reg_params[scores.index(max(scores))]
    return PipelineModel([tokens, counts, *fitted(best, counted).stages])


def fit_repeated(pipeline: Pipeline, df: DataFrame, text: str = "text", label: str = "label") -> PipelineModel:
    """What a pipeline of ``build_pipeline`` learns from ``df``, where each different (text, label) is one row of their weight.

    Equal rows add equal terms to the loss, and the term weights are of all rows' counts, as ``IDF`` gives them. Spark's
    variances of weighted rows are larger by one factor for all features, which the penalty, a square, is freed of.
    """
    tokens, counts, weights, regression = pipeline.getStages()
    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).groupBy(text, label).agg(F.count(F.lit(1)).alias("_n"))
    counted = written(counts.transform(tokens.transform(rows)).select(label, "_n", counts.getOutputCol()), "weighted-counts")
    held = F.udf(lambda vector: [int(index) for index in vector.indices], "array<int>")
    sums = counted.agg(F.sum("_n").alias("n"), F.sum(F.col("_n").cast("double") ** 2).alias("squares")).first()
    n, squares = sums["n"] or 0, sums["squares"] or 0.0
    penalty = regression.getRegParam() * ((n - squares / n) / (n - 1) if n > 1 else 1.0)
    terms = counted.select("_n", F.explode(held(counts.getOutputCol())).alias("term")).groupBy("term").agg(F.sum("_n").alias("n"))
    idf = np.full(counts.getNumFeatures(), np.log(n + 1.0))
    for row in terms.toLocalIterator():  # at most one row a feature
        idf[row.term] -= np.log(row.n + 1.0)
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=weights.getInputCol(), outputCol=weights.getOutputCol())
    model = regression.copy({regression.weightCol: "_n", regression.regParam: penalty}).fit(weigh.transform(counted))
    return PipelineModel([tokens, counts, weigh, model])


def eval_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; an undefined ratio counts as 0.

    The rows shrink to the confusion counts first; the rest works on classes squared.
    """
    confusion = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )
    none = F.lit(0).cast("long")
    hits = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(none)

    def side(cls: str, support: Column, predicted: Column, hits: Column) -> Column:
        return F.struct(
            F.col(cls).cast("double").alias("class"), support.alias("support"), predicted.alias("predicted"),
            hits.alias("hits"),
        )

    # One row as its label and one as its prediction, added up per class.
    sides = confusion.select(F.inline(F.array(
        side("label", F.col("n"), none, hits), side("prediction", none, F.col("n"), none)
    )))
    classes = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.col("hits") * 2, F.col("support") + F.col("predicted")), F.lit(0.0))
    support, total = F.col("support"), F.sum("support")
    return classes.agg(
        (F.sum("hits") / total).alias("accuracy"),
        (F.sum(f1 * support) / total).alias("f1"),
        (F.sum(precision * support) / total).alias("precision"),
        (F.sum(recall * support) / total).alias("recall"),
        total.alias("n"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    """Save the fitted pipeline, with the label names beside it."""
    model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.getActiveSession()
    rows = list(enumerate(L.LABELS))
    spark.createDataFrame(rows, "id int, label string").coalesce(1).write.mode("overwrite").json(f"{path}/labels")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/pipeline")


def run_log(
    spark: SparkSession, params: dict[str, object], metrics: DataFrame, path: str, run_id: str
) -> None:
    """Append one row to the runs table: the run's parameters and its metrics."""
    entries = [F.lit(text) for name, value in sorted(params.items()) for text in (name, str(value))]
    row = metrics.select(
        F.lit(run_id).alias("run_id"),
        F.current_timestamp().alias("logged_at"),
        F.create_map(*entries).alias("params"),
        *[F.col(name).alias(f"eval_{name}") for name in ("accuracy", "f1", "precision", "recall")],
    )
    row.write.mode("append").parquet(path)
