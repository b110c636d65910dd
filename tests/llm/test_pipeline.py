"""Each stage of the pipeline against a brute-force version, on the rows that it is given."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quire.llm import byte_bpe, quality
from tests.llm.test_operators import DOC, contained, corpus, frame, near_components, removed

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    return corpus(seed=8, n=40)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, [*rows, (None, "no id"), (0, rows[0][1])])


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-dedup", "suffix-dedup", "decontaminate", "byte-bpe"]


def test_quality_stage(spark, docs):
    out = STAGES["quality"](spark, docs, "")
    scores = {(r["doc_id"], r["text"]): r["_s"] for r in quality.scored(docs, quality.trained(docs), "_s").collect()}
    assert out.columns == docs.columns
    assert sorted(map(str, texts(out))) == sorted({str(i) for (i, _), s in scores.items() if s >= quality.LEAST})


def test_near_dedup_stage(spark, docs, rows):
    out = STAGES["near-dedup"](spark, docs, "")
    want = near_components(rows, 5, 80)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted([str(i) for i in want if want[i][1] == i] + ["None"])
    x, y = "one text of five words and more of them here", "some quite other text that nothing else is like at all"
    repeated = frame(spark, [(3, y), (5, y), (5, x), (9, x)]).withColumn("row", F.lit("own"))
    out = STAGES["near-dedup"](spark, repeated, "")
    assert out.dtypes == repeated.dtypes and sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(3, y), (5, x)]


def test_suffix_stage(spark, docs, rows):
    out = STAGES["suffix-dedup"](spark, docs, "")
    want = removed(rows, 50)
    got = texts(out.where("doc_id is not null"))
    assert out.dtypes == docs.dtypes
    assert {r["kept"] for r in out.collect()} == {"x"} and {r["score"] for r in out.collect()} == {0.5}  # the table's own columns
    assert got == {i: (t if len(want[i]) == len((t or "").encode()) else want[i].decode(errors="ignore")) for i, t in rows}
    assert out.where(F.col("n_chars") != F.length("text")).where("text is not null").count() == 0


def test_decontaminate_stage(spark, docs, rows, tmp_path):
    long = max((t for _, t in rows if t and " " in t), key=len)
    items = [(1, " ".join(long.split()[:30])), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = STAGES["decontaminate"](spark, docs, str(tmp_path))
    bad = {i for i, t in rows if contained(t, items[0][1])}
    assert bad and out.columns == docs.columns
    assert set(texts(out)) == {i for i, _ in rows if i not in bad} | {None}


def test_encode_stage(spark, docs, rows):
    got = {r["doc_id"]: r for r in STAGES["byte-bpe"](spark, docs, "").collect()}
    assert all(got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows)
    assert all((got[i]["n_tokens"] == 0) == (not t) for i, t in rows) and byte_bpe.PIECE > 0


def test_all_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
