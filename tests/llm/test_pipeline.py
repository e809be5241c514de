"""The pipeline's stages against plain versions."""

import corpus_pipeline as C
import pytest

from storelens.llm import pii
from storelens.llm.queries import tokenizer_path

SF001 = "/root/testdata/sf0.001"

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_and_order():
    assert [n for n, _ in C.STAGES] == ["quality rules", "n-gram Jaccard join", "PII", "mixing", "packing"]


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage returns for the small tables."""
    docs, out = spark.read.parquet(f"{SF001}/documents.parquet"), []
    for k, (_, f) in enumerate(C.STAGES):
        docs = C.keep(f(spark, docs, SF001))
        out.append(docs)
        assert k == 4 or docs.columns == C.COLUMNS
    return out


def test_quality_stage_keeps_clean_documents(spark, steps):
    from test_quality_mixing_url_shards import brute_counts
    kept = {r.doc_id for r in steps[0].collect()}
    for r in spark.read.parquet(f"{SF001}/documents.parquet").join(spark.read.parquet(f"{SF001}/labels.parquet"), "doc_id", "left").collect():
        n, _, _, _, repeat = brute_counts(r.text)
        if n < 10 or 100 * repeat > 20 * n:
            assert r.doc_id not in kept
        elif r.quality == 1:
            assert r.doc_id in kept


def test_one_document_of_each_group_stays(steps):
    from test_ngram_join import brute
    rows = [(r.doc_id, r.text) for r in steps[0].collect()]
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted(i for i, (_, c) in brute(rows).items() if i == c)


def test_personal_data_is_masked(steps):
    before, w = {r.doc_id: r.text for r in steps[1].collect()}, pii.train()
    after = steps[2].collect()
    assert len(after) == len(before)
    for r in after:
        base, added = pii.all_spans(before[r.doc_id], w)
        assert r.text == pii.masked(before[r.doc_id], base + added) and r.n_chars == len(r.text)


def test_mixed_copies_are_packed_whole(steps):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    size = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in steps[3].collect()}
    copies = {r.doc_id: r["count"] for r in steps[3].groupBy("doc_id").count().collect()}
    ids = {r.doc_id: r.n for r in steps[4].selectExpr("doc_id", "length").groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert ids == {i: size[i] * n for i, n in copies.items()}


def test_empty_and_odd_documents_pass_every_stage(spark):
    rows = [(None, None, None, None, None), (1, None, None, "s", 1), (2, "", "en", None, 0), (3, "the " + "word " * 3 + "and more of it is here to be kept today " * 2, "en", "s", 1)] * 2
    for docs in (spark.createDataFrame(rows, DOC), spark.createDataFrame([], DOC)):
        for _, f in C.STAGES:
            docs = f(spark, docs, SF001)
            docs.count()
        got = spark.createDataFrame(rows, DOC)
        for _, f in C.STAGES[1:]:  # without the rules, so that odd rows reach the other stages
            got = f(spark, got, SF001)
            got.count()
