import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siren.operators import learn
from siren.operators.enrich import classify

SENTENCES = {
    0: ["shelter open at school", "roads reopening update", "volunteers hotline report"],
    1: ["urgent help trapped", "send rescue please help", "sos stranded dying"],
    2: ["bridge destroyed", "homes collapsed burning", "ruins and damage"],
}


def labelled(spark):
    parts = [spark.createDataFrame([(text,) for text in texts * 8], "text string") for texts in SENTENCES.values()]
    return learn.labelled_set(*parts)


@pytest.mark.parametrize("share, seed", [(0.2, 42), (0.5, 1), (0.0, 42), (0.001, 42)])
def test_split_is_exact_and_the_smallest_hashes(spark, share, seed):
    # One label holds most rows, one a single row.
    df = spark.range(6000).select(
        "id", F.when(F.col("id") == 17, 2).when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label")
    )
    split = learn.stratified_split(df, "id", share=share, seed=seed)
    rows = split.collect()
    assert len(rows) == 6000 and split.columns == ["id", "label", "split"]
    groups = defaultdict(list)
    for r in rows:
        groups[r.label].append((hashlib.md5(f"{seed}:{r.id}".encode()).hexdigest(), r.split))
    for members in groups.values():
        wanted = int(share * len(members) + 0.5)
        assert [part for _, part in sorted(members)] == ["test"] * wanted + ["train"] * (len(members) - wanted)


def test_split_compares_rows_where_they_are(spark):
    df = spark.range(100).select("id", F.lit(0).alias("label"))
    plan = learn.stratified_split(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_tokenize(spark):
    df = spark.createDataFrame([("Help! 3 l'été " + "x " * 200,)], "text string")
    row = df.select(learn.tokenize("text", 128).alias("cut"), learn.tokenize("text").alias("all")).first()
    assert row.cut[:4] == ["help", "3", "l", "été"] and len(row.cut) == 128 and len(row.all) == 204


def test_metrics_by_hand(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(1, 0)] * 2 + [(2, 0)]
    row = learn.eval_metrics(spark.createDataFrame(pairs, "label int, prediction int")).first()
    precision = (3 / 6 * 4 + 2 / 3 * 4 + 0) / 9
    recall = (3 / 4 * 4 + 2 / 4 * 4 + 0) / 9
    f1 = (0.6 * 4 + 4 / 7 * 4 + 0) / 9
    assert [row.accuracy, row.precision, row.recall, row.f1, row.n] == pytest.approx([5 / 9, precision, recall, f1, 9])


def test_weak_labels(spark):
    rows = learn.weak_labels(labelled(spark).withColumnRenamed("label", "given"), "text").collect()
    assert all(r.given == r.label for r in rows)


def test_train_save_load_classify(spark, tmp_path):
    model = learn.train_classifier(labelled(spark), reg_params=(0.01,), features=1 << 10, max_iter=10)
    learn.save_model(model, str(tmp_path / "m"))
    loaded = learn.load_model(str(tmp_path / "m"))
    texts = [(text, label) for label, texts in SENTENCES.items() for text in texts]
    df = spark.createDataFrame(texts, "clean_text string, label int")
    rows = classify(df, model=loaded).collect()
    assert [r.category for r in rows] == [learn.L.LABELS[r.label] for r in rows]
    assert all(r.model_mode == "model" and 0 <= r.urgency_score <= 100 for r in rows)
    assert all(abs(sum(r.all_probs.values()) - 1) < 1e-3 for r in rows)
    before, after = (classify(df, model=m).select("urgency_score").collect() for m in (model, loaded))
    assert before == after


def test_run_log_appends(spark, tmp_path):
    metrics = learn.eval_metrics(spark.createDataFrame([(0, 0)], "label int, prediction int"))
    for run in ("a", "b"):
        learn.run_log(spark, {"epochs": 3, "batch_size": 16}, metrics, str(tmp_path / "runs"), run)
    rows = spark.read.parquet(str(tmp_path / "runs")).orderBy("run_id").collect()
    assert [(r.run_id, r.params["epochs"], r.eval_f1) for r in rows] == [("a", "3", 1.0), ("b", "3", 1.0)]


def test_equal_rows_are_fitted_as_one(spark):
    """Weighted rows give the model that all rows give, and each different text is worked on once."""
    rows = labelled(spark).union(labelled(spark).where("label = 1")).withColumn("label", F.col("label").cast("double"))
    pipeline = learn.build_pipeline(features=1 << 10, max_iter=50)
    pipeline.getStages()[-1].setRegParam(0.01)
    once, each = learn.fit_repeated(pipeline, rows), pipeline.fit(rows)
    texts = [(text,) for texts in SENTENCES.values() for text in [*texts, "school bridge", "help open ruins"]]
    df = spark.createDataFrame(texts, "text string")
    for a, b in zip(once.transform(df).collect(), each.transform(df).collect(), strict=True):
        assert a.prediction == b.prediction and list(a.probability) == pytest.approx(list(b.probability), abs=1e-5)
        assert list(a.features) == pytest.approx(list(b.features))


def test_training_reads_texts_once(spark, monkeypatch):
    """All candidates are fitted on word counts made once; the model still starts at texts."""
    cut = []
    transform = learn.RegexTokenizer.transform
    monkeypatch.setattr(learn.RegexTokenizer, "transform", lambda self, *args: cut.append(1) or transform(self, *args))
    model = learn.train_classifier(labelled(spark), reg_params=(0.01, 0.1), features=1 << 10, max_iter=10)
    assert len(cut) == 1
    found = model.transform(labelled(spark))
    assert found.where("prediction = label").count() == 72 and len(model.stages) == 4
