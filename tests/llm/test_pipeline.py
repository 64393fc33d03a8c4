"""The pipeline: each stage's decisions take effect, on the stage's own input."""

import corpus_pipeline
from sensorloom.llm import decontaminate, mixing, neardup, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, spark.read.parquet(f"{SF}/benchmark.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    made = []
    for _, apply in corpus_pipeline.STAGES[:-1]:
        before = made[-1] if made else docs
        made.append(apply(spark, before, SF).cache())
        assert made[-1].columns == columns
    good, single, clean, mixed = made
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(good) == {r["doc_id"] for r in docs.collect() if model.score(r["text"]) >= quality.THRESHOLD}
    first = {r["doc_id"] for r in neardup.groups(good, size=5, percent=80).where("first").collect()}
    assert ids(single) == first
    assert ids(clean) == {r["doc_id"] for r in decontaminate.annotate(single, bench).where("size(leak.hits) = 0").collect()}
    assert mixed.count() == mixing.report(clean).groupBy().sum("copies").first()[0]
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, SF).collect()
    assert len(last) == mixed.count()
    ends = sorted((r["start"], r["n_tokens"]) for r in last)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
