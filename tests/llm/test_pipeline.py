"""The pipeline's stages against what they should keep and change."""

import re

import corpus_pipeline
import numpy as np
import pytest
from plumbline.llm.graph import local_components
from plumbline.llm.simhash import fingerprint
from pyspark.sql import functions as F
from test_models import plain_spans
from test_tokens import check_sequences

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    odd = [
        (10**6, None, "en", None, 0),
        (10**6 + 1, "", None, "s", 0),
        (10**6 + 2, "1234 !!", "en", "s", 7),
        (10**6 + 3, first.text, "en", "s", 1),
        (first.doc_id, first.text, first.lang, first.source, first.n_chars),
        (None, "the words of a document and without a number of its own", None, None, None),
        (first.doc_id, "other words of a text that has the same number and the rest", "en", "s", 1),
    ]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema))


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage_rejects_what_has_no_language(spark, documents):
    kept = corpus_pipeline.identify_language(spark, documents, TABLES)
    assert kept.columns == documents.columns
    rows = kept.collect()
    assert not {10**6, 10**6 + 1, 10**6 + 2} & {r.doc_id for r in rows}
    with_letters = [r for r in documents.collect() if r.text and re.search(r"[^\W\d_]", r.text)]
    assert len(rows) >= 0.97 * len(with_letters)
    assert None not in {r.lang for r in rows}


def test_one_document_of_each_group_stays(spark, documents):
    rows = documents.collect()
    kept = corpus_pipeline.drop_near_duplicates(spark, documents, TABLES)
    assert kept.columns == documents.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    prints = np.array([fingerprint(r.text) for r in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = local_components(len(rows), *np.nonzero(np.triu(near, 1)))
    groups = {}
    for row, group in zip(rows, label.tolist(), strict=True):
        groups.setdefault(group, []).append(row)
    assert len(got) == len(groups)
    smallest = {min((-1 if r.doc_id is None else r.doc_id) for r in members) for members in groups.values()}
    assert {-1 if doc_id is None else doc_id for doc_id, _ in got} == smallest


def test_personal_data_is_masked(spark, documents):
    masked = corpus_pipeline.mask_personal_data(spark, documents, TABLES)
    assert masked.columns == documents.columns
    before = sorted(map(repr, ((r.doc_id, r.lang, r.source) for r in documents.collect())))
    rows = masked.collect()
    assert sorted(map(repr, ((r.doc_id, r.lang, r.source) for r in rows))) == before
    assert not any(any(plain_spans(r.text or "").values()) for r in rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    clean = {r.doc_id: r.text for r in documents.collect() if r.text and not re.search("[0-9@]", r.text)}
    repeated = documents.groupBy("doc_id").count().where("count > 1").collect()
    for r in repeated:
        clean.pop(r.doc_id, None)
    assert clean and all(r.text == clean[r.doc_id] for r in rows if r.doc_id in clean)


def test_run_is_its_stages(spark):
    rows = corpus_pipeline.run(spark, TABLES).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r.piece)
    assert 100 < len(pieces) < 201
    assert all(sorted(p) == list(range(len(p))) for p in pieces.values())
    assert check_sequences(rows) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_columns_of_the_caller_keep_their_values(spark, documents):
    names = ["score", "lang_pred", "spans", "base_spans", "_row", "rest", "hash", "key", "fp", "row"]
    docs = documents.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, TABLES)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert len(rows) > 150
        for r in rows:
            owner = "" if r.doc_id is None else r.doc_id
            assert all(r[n] == f"{n} of {owner}" for n in names)
