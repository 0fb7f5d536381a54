"""Every query of the package: its SQL, and the pipeline's contract."""

import pytest

import corpus_pipeline
from siren.llm.oracles import ORACLES
from siren.llm.queries import QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_names():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES if name != "pipeline") == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_query_agrees_with_sql(spark, connection, name):
    assert compare(spark, connection, SF, QUERIES[name], ORACLES.get(name)) == ""


def test_pipeline(spark, tmp_path):
    """Each stage drops what its operator drops, nothing else, and returns the documents' columns."""
    from siren.llm import toxicity

    source = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(9001, None), (9002, "12 34"), (9003, "you stupid idiot moron scum, pathetic trash"), (None, "the and of it")],
        "doc_id long, text string",
    )
    (tmp_path / "sf").mkdir()
    source.unionByName(extra, allowMissingColumns=True).write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "sf/labels.parquet"))
    docs = start = spark.read.parquet(str(tmp_path / "sf/documents.parquet"))
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path / "sf"))
        path = str(tmp_path / name)
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packed":
            assert docs.columns == start.columns
    every = {r.doc_id for r in start.select("doc_id").collect()}
    assert every - ids["language"] == {9001, 9002}
    model = toxicity.train(
        spark.read.parquet(str(tmp_path / "language")), spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out())
    )
    scores = {r.doc_id: s for r, s in ((r, toxicity.Scorer(model).scores([r.text])[0]) for r in start.collect())}
    assert ids["harmless"] == {d for d in ids["language"] if scores[d] < 0.3}
    texts = {r.doc_id: r.text for r in start.collect()}
    best = {}
    for d in ids["harmless"]:
        key = texts[d].encode().lower()
        best[key] = max(best.get(key, -1), -1 if d is None else d)
    assert {-1 if d is None else d for d in ids["distinct_texts"]} == set(best.values())
    from tests.llm.test_dedup import brute_force

    classes = brute_force([(d, texts[d]) for d in ids["distinct_texts"]])
    assert {d for d in ids["distinct_sets"] if d is not None} == {c for _, _, c in classes if c is not None}
    assert None in ids["distinct_sets"] and ids["packed"] == ids["distinct_sets"]
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).count() == docs.count()
