"""Registered queries and the pipeline over the small tables, against plain Python."""

from __future__ import annotations

import pytest

import corpus_pipeline
from loanlens.llm import catalog
from tests.conftest import SMALL
from tests.llm import brute
from tools.check import connect, difference


@pytest.fixture(scope="module")
def documents(spark):
    rows = catalog.table(spark, SMALL, "documents").select("doc_id", "text").collect()
    return [tuple(r) for r in rows]


def answer(spark, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, SMALL).collect()]


def test_substring_dedup(spark, documents):
    wanted = [(k, n, g, brute.sha(t)) for k, n, g, t in brute.removed(documents, 20)]
    assert brute.multiset(answer(spark, "op10_substring_dedup")) == brute.multiset(wanted)


def test_jaccard_join(spark, documents):
    wanted = brute.components(documents, 4, 85)
    assert brute.multiset(answer(spark, "op2_ngram_jaccard_join")) == brute.multiset(wanted)


def test_decontamination(spark, documents):
    items = [tuple(r) for r in catalog.table(spark, SMALL, "benchmark").collect()]
    wanted = [
        (k, n, h, len(x), brute.sha(",".join(x)), h > 0 and 20 * h >= n)
        for k, n, h, x in brute.hits(documents, items, 13)
    ]
    assert brute.multiset(answer(spark, "op8_benchmark_decontamination")) == brute.multiset(wanted)


def test_secret_scans(spark, documents):
    found = {r[0]: r[1:5] for r in answer(spark, "op9_secret_scans")}
    for key, text in documents:
        own = brute.secrets(text or "")
        counts = [sum(x.startswith(k) for x in own) for k in ("assign", "access", "hex")]
        assert found[key] == (*counts, brute.sha(",".join(own)))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    frame = catalog.QUERIES[name](spark, SMALL)
    assert difference(frame, connect(SMALL), catalog.SQL[name]) is None


def test_every_query_is_registered():
    numbers = {int(name[2:].split("_")[0]) for name in catalog.QUERIES}
    assert numbers == set(range(1, 14))


def test_pipeline(spark, documents):
    docs = catalog.table(spark, SMALL, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL).cache()
        assert after.columns == columns
        kept = [tuple(r) for r in after.select("doc_id", "text").collect()]
        given = [tuple(r) for r in before.select("doc_id", "text").collect()]
        if name == "ngram_jaccard_join":
            wanted = [k for k, _, group in brute.components(given, 5, 80) if k == group]
            assert sorted(k for k, _ in kept) == sorted(wanted)
        if name == "benchmark_decontamination":
            items = [tuple(r) for r in catalog.table(spark, SMALL, "benchmark").collect()]
            wanted = [k for k, n, h, _ in brute.hits(given, items, 13) if not (h and 20 * h >= n)]
            assert sorted(k for k, _ in kept) == sorted(wanted)
        if name == "secret_scans":
            assert len(kept) == len(given)
            assert all(not brute.secrets(t) for _, t in kept)
            assert any(brute.secrets(t) for _, t in given)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SMALL).collect()
    texts = {r.doc_id: r.text for r in before.collect()}
    assert len(last) == len(texts)
    assert all(r.decoded_sha256 == brute.sha(texts[r.doc_id]) for r in last)
    assert all(r.n_tokens == len(r.ids) for r in last)


def test_pipeline_leaves_its_last_table_alone(spark):
    from pathlib import Path

    last = corpus_pipeline.run(spark, SMALL)
    [path] = {x.removeprefix("file:").rsplit("/", 2)[0] for x in last.inputFiles()}
    path = "/" + path.lstrip("/")
    assert [x.name for x in Path(path).iterdir()] == ["4-bpe_encode_decode"]
    assert last.count() > 0


def test_pipeline_keeps_good_documents(spark):
    from pyspark.sql import functions as F

    docs = catalog.table(spark, SMALL, "documents")
    labels = catalog.table(spark, SMALL, "labels")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    joined = labels.join(kept.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
    rates = {r.quality: r.share for r in joined.groupBy("quality").agg(
        F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()}
    assert rates[1] > 0.97 and rates[0] < 0.1
