"""The pipeline's stages, each held against its operator on the stage's own input."""

import corpus_pipeline
import public_tokenizers as P
from conftest import DATA

from densigrid.llm import bpe, decontaminate, quality
from test_search import brute_classes, brute_spans


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {"start": {r.doc_id: r.text for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert docs.columns == columns
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            model = quality.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert set(seen[name]) == {r.doc_id for r in quality.score(before, model, ["doc_id"]).where("score >= 0.7").collect()}
        if name == "near_duplicates":
            ids = sorted(seen["quality"])
            assert set(seen[name]) == set(brute_classes(ids, [seen["quality"][i] for i in ids]).values())
        if name == "decontamination":
            leaked = {r.doc_id for r in decontaminate.contamination(before, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").collect()}
            assert set(seen[name]) == set(seen["near_duplicates"]) - leaked
        if name == "personal_data":
            assert set(seen[name]) == set(seen["decontamination"])
            assert not any(brute_spans(t) for t in seen[name].values())
            assert all(seen[name][i] == t for i, t in seen["decontamination"].items() if not brute_spans(t))
    encoder = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert {r.doc_id: encoder.decode(r.ids).decode() for r in docs.collect()} == seen["personal_data"]


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and out.count() > 0


def test_stages_with_columns_of_any_name(spark, tmp_path):
    """Extra columns with names that stages use themselves, or that need quotes, pass unchanged."""
    from pyspark.sql import functions as F

    names = ["score", "Score_", "h1", "text_hash", "told_hash", "hash", "__hash", "__score", "sent", "a.b", "q`t", "email", "terms", "leader"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def test_stages_without_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_the_run_leaves_one_table(spark):
    import os

    from densigrid.llm.ship import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    known = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, DATA).count() > 0
    (new,) = [d for d in set(os.listdir(folder)) - known if d.startswith("pipeline-")]
    assert os.listdir(os.path.join(folder, new)) == ["personal_data"]
