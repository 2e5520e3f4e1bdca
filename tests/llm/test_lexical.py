"""Ranked search against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from loanlens.llm import catalog, lexical
from tests.llm import brute
from tests.llm.conftest import PASSAGE, odd_documents


def split(text):
    return brute.LETTERS.findall((text or "").translate(brute.LOWER))


def ranked(docs, items, top):
    """(item, rank, doc, score)"""
    found = [(key, Counter(split(text))) for key, text in docs]
    found = [(key, tf, tf.total()) for key, tf in found if tf]
    n_docs, n_terms = len(found), sum(n for *_, n in found)
    df = Counter(t for _, tf, _ in found for t in tf)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for key, tf, n in found:
            m, score = 25 + (75 * n * n_docs) // n_terms, 0
            for term in split(text):
                if tf[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((1_000_000_000 * tf[term]) // (1000 * tf[term] + 8 * m))
            if score > 0:
                scores.append((-score, key is not None, key or 0, key))
        scores.sort()
        out += [(item, k + 1, key, -s) for k, (s, _, _, key) in enumerate(scores[:top])]
    return out


ITEMS = [
    (1, PASSAGE), (2, "one two"), (3, None), (4, ""), (5, "a a a a x"), (6, "nowhere"),
    (7, "A x Released under the MIT License"), (2, "one two"), (2, "größe Größe two"), (None, "日本 text spaces"),
    (8, PASSAGE[:200] + " one two"), (9, "one two spaces nospace changed other"),
]


def rows(frame):
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()]


@pytest.mark.parametrize(("part", "group", "known"), [(16_384, 8 << 20, 1 << 20), (2, 40, 0)])
def test_odd_documents(spark, odd, empty, monkeypatch, part, group, known):
    """In one block and in many, with and without the items' terms in the tasks."""
    monkeypatch.setattr(lexical, "PART", part)
    monkeypatch.setattr(lexical, "GROUP", group)
    monkeypatch.setattr(lexical, "VOCABULARY", known)
    items = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, doc_id int")
    found = rows(lexical.search(odd, items, top=3))
    assert brute.multiset(found) == brute.multiset(ranked(odd_documents(), ITEMS, 3))
    assert lexical.search(empty, items).collect() == []
    assert lexical.search(odd, items.where("item_id < 0")).collect() == []


def test_ties_repeats_and_shared_terms(spark, monkeypatch):
    draw = random.Random(5)
    terms = [f"t{k}" for k in range(30)]
    docs = [(k // 2, " ".join(draw.choices(terms, k=draw.choice([3, 3, 60])))) for k in range(80)]
    docs += [(500 + k, "t1 t2 t3") for k in range(60)]
    common = terms[:5] * 2
    items = [(k, " ".join(common[: draw.randrange(10)] + draw.choices(terms, k=8))) for k in range(25)]
    monkeypatch.setattr(lexical, "SUMS", 1)  # the fewest documents at once
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = rows(lexical.search(frame, spark.createDataFrame(items, "item_id long, text string")))
    assert brute.multiset(found) == brute.multiset(ranked(docs, items, 10))


def test_common_beginnings_are_one_node(spark):
    uses = [(0, i, s, 1) for i in range(6) for s in (1, 2, 3)] + [(0, i, 10 + i, 2) for i in range(6)]
    uses = spark.createDataFrame(uses, "part int, item long, set long, k long")
    nodes = lexical.sharing_graph(uses).select("node", "parent", "depth").distinct().collect()
    assert len(nodes) == 3 + 6
    terms = [(i, t, 1) for i in range(4) for t in (7, 8)] + [(0, 9, 1), (1, 9, 2)]
    sets = lexical.shared_sets(spark.createDataFrame(terms, "item long, term long, k long")).collect()
    sets = {r.term: r["set"] for r in sets}
    assert sets[7] == sets[8] != sets[9]


def test_query_equals_plain_python(spark):
    from tests.conftest import SMALL

    docs = [tuple(r) for r in catalog.table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in catalog.table(spark, SMALL, "benchmark").collect()]
    found = rows(catalog.QUERIES["op13_ranked_search"](spark, SMALL))
    assert brute.multiset(found) == brute.multiset(ranked(docs, items, 10))
