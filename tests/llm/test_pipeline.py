import corpus_pipeline
import pytest
from conftest import ODD, make_docs
from tokenizers import Tokenizer

import public_tokenizers
from shelfwise.llm import near_dedup, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """ODD rows and documents, as tables of their own."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = make_docs(spark, [(None if i is None else 10_000 + i, t) for i, t in ODD]).select(docs.columns)
    docs.unionByName(extra).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_keep_columns_and_only_drop_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        rows = after.collect()
        assert {(r.doc_id, r.text) for r in rows} <= texts and len(rows) <= docs.count(), name
        docs = spark.createDataFrame(rows, docs.schema)
    assert docs.count() > 100
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = docs.join(labels, "doc_id").where("quality = 0").count()
    assert kept <= 0.2 * labels.where("quality = 0").count()
    assert docs.selectExpr("lower(text)").distinct().count() == docs.count()


def test_run_packs_what_the_stages_keep(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in rows) == sum(len(encode.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_of_a_document_leave_one(spark):
    words = [f"word{i % 97}x{i}" for i in range(400)]
    rows = [(i, " ".join(words)) for i in range(3)] + [(9, " ".join(reversed(words)))]
    assert {r.doc_id for r in near_dedup.drop_near_copies(make_docs(spark, rows)).collect()} == {0, 9}
    assert quality.THRESHOLD == 0.7
