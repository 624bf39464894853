import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_lines_mixing import brute_lines
from tests.llm.test_minhash import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage over a small table, written and read again."""
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, f) in enumerate(cp.STAGES):
        f(spark, docs, SF).write.parquet(f"{at}/{k}")
        done = spark.read.parquet(f"{at}/{k}")
        out.append((docs, done))
        docs = done
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "minhash near-dedup", "mixing", "sentencepiece"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_good(stages, spark):
    before, after = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = texts(after)
    assert all(kept.get(i, t) == t for i, t in texts(before).items())
    assert all((i in kept) == bool(q) for i, q in labels.items())


def test_lines(stages):
    before, after = stages[1]
    assert texts(after) == brute_lines(texts(before))
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_duplicates(stages):
    before, after = stages[2]
    _, comp = components(texts(before))
    assert set(texts(after)) == {i for i, c in comp.items() if i == c}


def test_mix(stages):
    before, after = stages[3]
    n = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.taken // max(1, r.size) for r in cp.mix_sources(before).collect()}
    assert n == {i: k for i, k in want.items() if k} and max(n.values()) <= 3


def test_encode(stages):
    before, after = stages[4]
    assert after.count() == before.count() and after.where("not lossless").count() == 0


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, columns of clashing names; then no documents at all."""
    good = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, None, "en", None, None), (10**9 + 1, "", None, "s", 0), (10**9 + 2, "so it goes\n" * 20_000, "en", "s", None), (10**9 + 3, "word " * 50, "en", "s", 250), (10**9 + 3, "word " * 50, "en", "s", 250)], good.schema)
    docs = good.unionByName(odd)
    for c in ("taken", "size", "score", "mix_id", "kept", "n_removed", "ids"):
        docs = docs.withColumn(c, F.lit("!"))
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/odd/labels.parquet")
    out = cp.run(spark, f"{tmp_path}/odd")
    assert out.columns == ["doc_id", "n_pieces", "ids", "ids_crc32", "lossless"] and out.where("not lossless").count() == 0
    assert out.select("doc_id").distinct().count() > 100
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert cp.run(spark, f"{tmp_path}/none").collect() == []


def test_run(spark, stages):
    assert cp.run(spark, SF).select("doc_id", "ids_crc32").exceptAll(stages[-1][1].select("doc_id", "ids_crc32")).count() == 0
