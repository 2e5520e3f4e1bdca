"""SimHash near-duplicates against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loanlens.llm import catalog, neardup
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.conftest import odd_documents


def fingerprint(text, size):
    own = brute.PLAIN.findall((text or "").translate(brute.LOWER))
    grams = [own[k : k + size] for k in range(max(1, len(own) - size + 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(values, radius):
    """The component of each value, as the least position in it."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(k) for k in range(len(values))]


def wanted(docs, size, radius):
    values = [fingerprint(t, size) for _, t in docs]
    group = classes(values, radius)
    least = {}
    for (key, _), g in zip(docs, group, strict=True):
        if key is not None:
            least[g] = min(key, least.get(g, key))
    return [(k, v, least.get(g)) for (k, _), v, g in zip(docs, values, group, strict=True)]


def answer(frame):
    return brute.multiset((r[0], r[1] % (1 << 64), r[2]) for r in frame.collect())


@pytest.mark.parametrize(("size", "limit"), [(4, 4096), (5, 1)])
def test_odd_documents(odd, size, limit):
    found = neardup.near_duplicates(odd, shingle=size, limit=limit)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert answer(found) == brute.multiset(wanted(odd_documents(), size, 4))


def test_empty_table(empty):
    assert neardup.near_duplicates(empty).collect() == []


def test_query(spark):
    docs = [tuple(r) for r in catalog.table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    found = catalog.QUERIES["op12_simhash_near_dedup"](spark, SMALL).collect()
    expect = [(k, f"{v:016x}", g) for k, v, g in wanted(docs, 4, 4)]
    assert brute.multiset(map(tuple, found)) == brute.multiset(expect)


def crowd(draw, n, bits):
    """n distinct values around one."""
    centre, out = draw.getrandbits(64), set()
    while len(out) < n:
        value = centre
        for k in draw.sample(range(64), bits):
            value ^= 1 << k
        out.add(value)
    return out


@pytest.mark.parametrize(("limit", "most"), [(4096, 12), (20, 12), (1, 9), (1, 4)])
def test_links_connect_what_pairs_connect(spark, limit, most):
    """Crowds, chains and strangers, whether keys are compared in a task, go through finer tables or
    through middles."""
    from loanlens.llm.components import components

    draw = random.Random(7)
    values = {0, *crowd(draw, 150, 2), *crowd(draw, 120, 4), *crowd(draw, 60, 7)}
    step = draw.getrandbits(64)
    for k in range(15):  # a chain: each 4 bits from the one before
        values.add(step)
        for bit in range(4):
            step ^= 1 << (4 * k + bit)
    values |= {draw.getrandbits(64) for _ in range(200)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long").repartition(5)
    found = components(neardup.links(frame, 4, limit, most))
    found = {r.node: r.component for r in found.collect()}
    group = classes([v % (1 << 64) for v in signed], 4)
    assert [found.get(v, v) for v in signed] == [signed[g] for g in group]


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_every_close_pair_shares_a_key(blocks):
    draw = random.Random(blocks)
    tables = [m % (1 << 64) for m in neardup.masks(4, blocks)]
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for k in draw.sample(range(64), 4):
            b ^= 1 << k
        assert any(a & m == b & m for m in tables)


def test_blocks_grow_with_the_table():
    numbers = [neardup.blocks_for(n, 4) for n in (0, 10**3, 10**6, 10**9, 10**12)]
    assert numbers == sorted(numbers)
    assert numbers[0] == 5
    assert numbers[-1] > numbers[1]


def test_votes_of_a_text_in_several_parts(monkeypatch):
    texts = pa.array(["a b c d e f g h " * 40, None, "x", "", "k l m n o p q r s t u v w " * 9])
    whole = neardup.simhash(texts, 4)
    assert [int(x) for x in whole] == [fingerprint(t, 4) for t in texts.to_pylist()]
    monkeypatch.setattr(neardup, "PART", 7)
    assert neardup.simhash(texts, 4).tolist() == whole.tolist()


def test_a_very_long_word_and_text():
    texts = pa.array(["z" * 3_000_000, "w " * 300_000])
    assert [int(x) for x in neardup.simhash(texts, 4)] == [fingerprint(t, 4) for t in texts.to_pylist()]


def test_copies_of_one_text_split(spark):
    """Half of all rows are one text: both sides of the join that names them are stored tables, so
    Spark splits the key."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        texts = F.when(F.col("id") % 2 == 0, F.lit("one text")).otherwise(
            F.concat_ws(" ", F.lit("text"), F.sha2(F.col("id").cast("string"), 256))
        )
        docs = spark.range(6000).select(F.col("id").alias("doc_id"), texts.alias("text"))
        found = neardup.near_duplicates(docs.repartition(8))
        rows = found.collect()
        assert sum(r.component_id == 0 for r in rows) >= 3000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_unsigned_order_does_not_matter():
    values = np.array([-1, -2, 5], dtype=np.int64)
    assert [(int(r), o.tolist()) for r, o in neardup.tree(values, 1)] == [(-1, [-2])]


def test_an_odd_radius_is_refused(spark):
    with pytest.raises(ValueError, match="even"):
        neardup.links(spark.createDataFrame([], "fingerprint long"), 3)
