"""The conversation trie against plain Python."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from loanlens.llm import catalog, prefixtrie
from loanlens.llm.running import with_running_sums
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string, depth int, g1 string"


def digest(role, text):
    return brute.sha(f"{len(role.encode())}:{role}{text}")


def rebuilt(rows):
    """Turns (role, text) of each rebuilt conversation."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(t[1], t[2])))
    turns = {conv: [t[1:] for t in x] for conv, x in own.items()}
    out = {}
    for conv, x in turns.items():
        h = zlib.crc32(str(conv).encode()) % 9
        lender = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        out[conv] = turns.get(lender, [])[:h] + x[h:]
    return out


def wanted(rows):
    turns = rebuilt(rows)
    members = {}
    for conv, x in turns.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(conv)
    children, saved, leaves = {}, {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, convs in members.items():
        own = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] = saved.get(node[:d], 0) + own
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in children)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(x) for x in sorted(convs) if len(turns[x]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        counts = (len(convs), children.get(node, 0), leaves[node], saved[node])
        out.append((min(convs), len(node), parent, *counts, brute.sha(ends)))
    return out


def answer(spark, monkeypatch, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(catalog, "table", lambda *_: frame)
    found = catalog.QUERIES["op11_conversation_prefix_trie"](spark, "")
    return [tuple(r) for r in found.collect()]


def conversations(seed):
    """Common beginnings, copies, lengths around a block's, nulls, ties, repeats, negative ids."""
    draw = random.Random(seed)
    rows = []
    for conv in [*range(40), -3, -5, -7, 2**62]:
        size = draw.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 26])
        for turn in range(size):
            text = draw.choice(["a", "é日", "", None]) if turn % 3 else "same"
            rows.append((conv, turn, draw.choice(["user", None]) if turn % 4 == 1 else "bot", text))
    copied = [r for r in rows if r[0] == 5]
    for conv in range(100, 130):  # copies of one, not borrowed from
        rows += [(conv, *r[1:]) for r in copied]
    rows += [(200, None, "user", "null first"), (200, 0, "a", "b"), (200, 0, "a", "b"), (200, 0, "ab", "")]
    rows += [(None, 0, "user", "nobody's"), (301, 0, "", ""), (303, 0, "", "")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, monkeypatch, seed):
    rows = conversations(seed)
    assert brute.multiset(answer(spark, monkeypatch, rows)) == brute.multiset(wanted(rows))


def test_one_very_long_conversation(spark, monkeypatch):
    rows = [(7, k, "user", f"t{k % 50}") for k in range(1500)]
    rows += [(8, k, "user", f"t{k % 50}") for k in range(1300)]
    rows += [(9, 0, "user", "t0")]
    assert brute.multiset(answer(spark, monkeypatch, rows)) == brute.multiset(wanted(rows))


def test_empty_table_and_turnless_conversation(spark, monkeypatch):
    assert answer(spark, monkeypatch, []) == []
    conv = next(x for x in range(1, 100) if x % 5 and zlib.crc32(str(x).encode()) % 9 > 1)
    rows = [(conv, 0, "user", "gone")]
    assert answer(spark, monkeypatch, rows) == wanted(rows) == [
        (conv, 0, None, 1, 0, 1, 0, brute.sha(str(conv)))
    ]


def test_digests_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 100)
    ends = spark.range(5000).select(
        F.lit(3).cast("long").alias("depth"), (F.col("id") % 2 * F.col("id") % 7).alias("g1"),
        F.lit(0).cast("long").alias("g2"), (F.col("id") - 100).alias("conv_id"),
    )
    found = {r.g1: r.ends_sha256 for r in prefixtrie.ends_digests(ends.repartition(5)).collect()}
    ids = {}
    for row in ends.collect():
        ids.setdefault(row.g1, []).append(row.conv_id)
    assert found == {k: brute.sha(",".join(map(str, sorted(x)))) for k, x in ids.items()}


def test_running_sums_of_a_group_in_many_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the few rows are put together
    try:
        _running_sums(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def _running_sums(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).cast("long").alias("g"),
        F.col("id").alias("x"),
    )
    found = with_running_sums(
        rows.repartition(7), "g", [F.col("x").asc()], {"n": F.lit(1).cast("long"), "s": F.col("x")}
    )
    for r in found.collect():
        alone = r.g != 0
        assert (r.n, r.s) == ((1, r.x) if alone else (r.x + 1, r.x * (r.x + 1) // 2))
    where = found.select(F.spark_partition_id().alias("p"), "g").where("g = 0").distinct().count()
    assert where > 1
