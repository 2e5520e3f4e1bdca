"""Prefix trie of conversations: Spark SQL ROLLUP over positional turn columns.

A turn is known by 128 bits of the SHA-256 of its role and text; texts go no further. A conversation's
turns are cut into blocks of `SLOTS`, each a row with its turns in positional columns. GROUP BY block
key, ROLLUP (t1 .. t8) with grouping_id aggregates every prefix inside a block at once: a level stands
for the prefix of as many turns. A longer conversation goes on in a further block, keyed by the node
that the block before ends in: the sums of hashes of (position, turn) up to there, 128 bits, which are
running sums and need no earlier block's result. So blocks of all depths are rolled up together.

Sums over subtrees: a second ROLLUP, over the nodes of each block, adds up what lies below a node in
its block. Blocks below are added first, by pointer doubling along the tree of blocks: each step adds
what blocks twice as far below have, so a conversation of n turns takes log2(n / 8) steps.

Nothing is gathered per conversation or node: turns are numbered over ranges (`running`), a node's
members are counted map-side, and its ending members are rows of a table of their own (`ends`).

Cases: conversations are the distinct conv_ids; rows without one belong to none. Turns are ordered by
turn, null first, then by the digest of role and text, so repeated rows are turns after each other.
Null role or text is empty. Ids are cast to bigint. Other columns are not read. An empty table has no
node; a conversation that is rebuilt without turns is a member of the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.running import with_running_sums
from loanlens.llm.storage import cut

c = F.col

SLOTS = 8
#: Bytes of ids that are digested at once.
CHUNK = 1 << 20
LANES = ("l1", "l2", "l3", "l4")
WORD = 0xFFFFFFFF


@dataclass(frozen=True)
class Trie:
    """`nodes`: node (depth, g1, g2), conv_id, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens. `ends`: (depth, g1, g2, conv_id) of each conversation's last node."""

    nodes: DataFrame
    ends: DataFrame


def lanes(position: Column, turn: Column) -> list[Column]:
    """Four 32-bit values of a turn at its position; their sums tell sequences apart."""
    one, two = F.xxhash64(position, turn), F.xxhash64(turn, F.lit("second"), position)
    word = F.lit(WORD).cast("long")
    return [half for h in (one, two) for half in (h.bitwiseAND(word), F.shiftrightunsigned(h, 32))]


def packed(sums: list[Column]) -> list[Column]:
    """Two bigints from the lower halves of four sums."""
    low = [x.bitwiseAND(F.lit(WORD).cast("long")) for x in sums]
    return [F.shiftleft(low[k], 32).bitwiseOR(low[k + 1]) for k in (0, 2)]


def unpacked(first: Column, second: Column) -> list[Column]:
    word = F.lit(WORD).cast("long")
    return [
        half for x in (first, second) for half in (F.shiftrightunsigned(x, 32), x.bitwiseAND(word))
    ]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, id, bytes): numbered turns, from 1."""
    role = F.coalesce(c("role").cast("string"), F.lit(""))
    text = F.coalesce(c("text").cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        c("conv_id").cast("long").alias("conv_id"),
        c("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("id"),
        F.octet_length(text).alias("bytes"),
    )
    order = [c("turn").asc_nulls_first(), c("id").asc()]
    numbered = with_running_sums(rows, "conv_id", order, {"n": F.lit(1).cast("long")})
    return numbered.select("conv_id", "n", "id", "bytes")


def rebuilt(turns: DataFrame, shared: Column, borrowed: Column) -> DataFrame:
    """(conv_id, n, id, bytes, length) of conversations whose first `shared` turns are those of the
    conversation `borrowed`, and one row with n null for a conversation without turns.

    `shared` and `borrowed` are columns over conv_id; `shared` is `SLOTS` at most. A conversation
    that borrows from itself stays.
    """
    sizes = cut(turns.groupBy("conv_id").agg(F.max("n").alias("own")))
    lender = sizes.select(c("conv_id").alias("lender"), c("own").alias("theirs"))
    plan = sizes.select("conv_id", "own", shared.cast("long").alias("h"), borrowed.alias("from"))
    plan = plan.join(lender, c("from") == c("lender"), "left").withColumn(
        "head", F.least("h", F.coalesce("theirs", F.lit(0).cast("long")))
    )
    length = c("head") + F.greatest(F.lit(0).cast("long"), c("own") - c("h"))
    plan = cut(plan.select("conv_id", "from", "h", "head", length.alias("length")))
    name = plan.withColumnRenamed("conv_id", "c")
    rest = turns.join(name, turns["conv_id"] == name["c"]).where("n > h")
    rest = rest.select("conv_id", (c("n") - c("h") + c("head")).alias("n"), "id", "bytes", "length")
    first = turns.where(c("n") <= SLOTS).select(c("conv_id").alias("lender"), "n", "id", "bytes")
    head = first.join(plan, c("lender") == c("from")).where("n <= head")
    head = head.select("conv_id", "n", "id", "bytes", "length")
    none = plan.where("length = 0").select(
        "conv_id",
        *[F.lit(None).cast(t).alias(n) for n, t in (("n", "long"), ("id", "binary"), ("bytes", "int"))],
        "length",
    )
    return head.unionByName(rest).unionByName(none)


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, length, block, k1, k2, t1.., b1.., e1, e2): the block's key, its turns, their bytes,
    and the node that the conversation has reached at its end."""
    block = F.floor((c("n") - 1) / SLOTS).cast("long")
    slot = F.pmod(c("n") - 1, F.lit(SLOTS))
    own = turns.where("n is not null").select(
        "conv_id", "length", block.alias("block"), slot.alias("slot"), "id", "bytes",
        *[x.alias(n) for n, x in zip(LANES, lanes(c("n"), c("id")), strict=True)],
    )
    rows = own.groupBy("conv_id", "length", "block").agg(
        *[F.max(F.when(c("slot") == k, c("id"))).alias(f"t{k + 1}") for k in range(SLOTS)],
        *[F.max(F.when(c("slot") == k, c("bytes"))).alias(f"b{k + 1}") for k in range(SLOTS)],
        *[F.sum(n).alias(n) for n in LANES],
    )
    upto = {f"s{n}": c(n) for n in LANES}
    rows = with_running_sums(rows, "conv_id", [c("block").asc()], upto)
    before = packed([c(f"s{n}") - c(n) for n in LANES])
    after = packed([c(f"s{n}") for n in LANES])
    return rows.withColumns(
        {"k1": before[0], "k2": before[1], "e1": after[0], "e2": after[1]}
    ).drop(*LANES, *upto)


KEY = ["block", "k1", "k2"]
TURNS = [f"t{k + 1}" for k in range(SLOTS)]


def _rollup(frame: DataFrame, aggregates: str) -> DataFrame:
    """Every prefix inside each block; `level` is its number of turns there, from 1.

    A row is in no level beyond its own turns: there its turn column is null.
    """
    reached = " ".join(f"WHEN {k + 1} THEN t{k + 1} IS NOT NULL" for k in range(SLOTS))
    grouped = frame.sparkSession.sql(
        f"""SELECT {', '.join(KEY + TURNS)}, {SLOTS} - bit_count(grouping_id()) AS level, {aggregates}
        FROM {{rows}} GROUP BY {', '.join(KEY)}, ROLLUP ({', '.join(TURNS)})""",
        rows=frame,
    )
    return grouped.where(F.expr(f"CASE level {reached} ELSE false END"))


def _nodes(blocks: DataFrame) -> DataFrame:
    """Nodes below the root: (depth, g1, g2), parent (p1, p2), conv_id, n_convs, bytes, block key and
    turns."""
    found = _rollup(
        blocks,
        "min(conv_id) AS conv_id, count(*) AS n_convs, array("
        + ", ".join(f"max(b{k + 1})" for k in range(SLOTS))
        + ") AS sizes",
    )
    start, sums, before = unpacked(c("k1"), c("k2")), [], []
    each = [lanes(c("block") * SLOTS + (k + 1), c(t)) for k, t in enumerate(TURNS)]
    for lane in range(len(LANES)):
        values = [start[lane]]
        for k in range(SLOTS):
            values.append(values[-1] + F.when(c("level") > k, each[k][lane]).otherwise(0))
        sums.append(values[-1])
        last = F.lit(0).cast("long")
        for k in range(SLOTS):
            last = F.when(c("level") == k + 1, each[k][lane]).otherwise(last)
        before.append(values[-1] - last)
    (g1, g2), (p1, p2) = packed(sums), packed(before)
    return found.withColumns(
        {
            "depth": c("block") * SLOTS + c("level"),
            "g1": g1,
            "g2": g2,
            "p1": p1,
            "p2": p2,
            "bytes": F.element_at("sizes", c("level")).cast("long"),
        }
    ).drop("sizes")


def _below(nodes: DataFrame) -> DataFrame:
    """(block, k1, k2, leaves, saved): sums over each block and all blocks below it."""
    own = nodes.groupBy(*KEY).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    above = nodes.where(c("level") == SLOTS).select(
        (c("block") + 1).alias("block"), c("g1").alias("k1"), c("g2").alias("k2"),
        F.struct(*KEY).alias("up"),
    )
    now = cut(own.join(above, KEY, "left"))
    while not now.where("up is not null").isEmpty():
        there = now.where("up is not null")
        gained = there.groupBy(*[c("up")[k].alias(k) for k in KEY]).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        next_up = now.select(*[c(k).alias(f"u_{k}") for k in KEY], c("up").alias("next"))
        same = [c("up")[k] == c(f"u_{k}") for k in KEY]
        zero = F.lit(0).cast("long")
        now = cut(
            now.join(gained, KEY, "left")
            .join(next_up, same[0] & same[1] & same[2], "left")
            .select(
                *KEY,
                (c("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"),
                (c("saved") + F.coalesce("more_saved", zero)).alias("saved"),
                c("next").alias("up"),
            )
        )
    return now.drop("up")


def build(turns: DataFrame) -> Trie:
    """The trie of rebuilt turns (conv_id, n, id, bytes, length)."""
    blocks = cut(_blocks(turns))
    nodes = cut(_nodes(blocks))
    kids = nodes.groupBy((c("depth") - 1).alias("d"), c("p1").alias("q1"), c("p2").alias("q2"))
    kids = cut(kids.agg(F.count(F.lit(1)).alias("n_children")))
    mine = (c("depth") == c("d")) & (c("g1") == c("q1")) & (c("g2") == c("q2"))
    zero = F.lit(0).cast("long")
    nodes = nodes.join(kids, mine, "left").withColumns(
        {
            "n_children": F.coalesce("n_children", zero),
            "leaf": F.when(c("n_children").isNull(), 1).otherwise(0).cast("long"),
            "saved": (c("n_convs") - 1) * c("bytes"),
        }
    )
    nodes = cut(nodes.drop("d", "q1", "q2"))
    below = cut(_below(nodes))
    under = below.select(
        (c("block") * SLOTS).alias("d"), c("k1").alias("q1"), c("k2").alias("q2"),
        c("leaves").alias("under_leaves"), c("saved").alias("under_saved"),
    )
    whole = nodes.join(under, mine & (c("level") == SLOTS), "left").withColumns(
        {
            "leaf": c("leaf") + F.coalesce("under_leaves", zero),
            "saved": c("saved") + F.coalesce("under_saved", zero),
        }
    )
    # The node itself is the shallowest row of its own group.
    rolled = cut(
        _rollup(
            whole.withColumn("at", c("level")),
            "min(struct(at, depth, g1, g2, p1, p2, conv_id, n_convs, n_children)) AS own, "
            "sum(leaf) AS n_leaves, sum(saved) AS saved_tokens",
        ).select("own.*", "n_leaves", "saved_tokens")
    )
    members = turns.groupBy("conv_id").agg(F.max("length").alias("length"))
    everyone = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    children = nodes.agg(F.count(F.when(c("depth") == 1, 1)).alias("n_children"))
    total = below.where("block = 0").select("leaves", "saved")
    root = (
        everyone.where("n_convs > 0")
        .join(children)
        .join(total, F.lit(True), "left")
        .select(
            zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), "conv_id",
            F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
            F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
            F.coalesce("saved", zero).alias("saved_tokens"),
        )
    )
    root = cut(root)
    parents = rolled.unionByName(root, allowMissingColumns=True).select(
        c("depth").alias("d"), c("g1").alias("q1"), c("g2").alias("q2"),
        c("conv_id").alias("parent_conv_id"),
    )
    at = (c("depth") - 1 == c("d")) & (c("p1") == c("q1")) & (c("p2") == c("q2"))
    nodes = rolled.join(parents, at).select(root.columns).unionByName(root)
    last = blocks.where(F.floor((c("length") - 1) / SLOTS) == c("block"))
    ends = last.select(c("length").alias("depth"), c("e1").alias("g1"), c("e2").alias("g2"), "conv_id")
    rootless = turns.where("n is null").select(
        zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), "conv_id"
    )
    return Trie(nodes, ends.unionByName(rootless))


NODE = ["depth", "g1", "g2"]


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, g1, g2, ends_sha256): the SHA-256 of a node's ending conv_ids, ascending, with commas.

    Ids are sorted over ranges and joined into pieces of `CHUNK` bytes where they lie; only pieces
    meet, in order, and are digested one after another.
    """
    order = [*NODE, "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = "depth long, g1 long, g2 long"
    pieces = pieces.mapInArrow(_pieces, f"{kinds}, first long, piece string")
    met = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return met.mapInArrow(_digests, f"{kinds}, ends_sha256 string")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """(node, rows) of consecutive rows of a batch with one node."""
    for batch in batches:
        columns = [x.to_pylist() for x in batch.columns]
        node, held = None, []
        for d, g1, g2, *rest in zip(*columns, strict=True):
            if (d, g1, g2) != node:
                if held:
                    yield node, held
                node, held = (d, g1, g2), []
            held.append(rest)
        if held:
            yield node, held


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = [*NODE, "first", "piece"], [pa.int64()] * 4 + [pa.string()]
    out, size, node, ids = [], 0, None, []

    def close() -> None:
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))

    for own, rows in _runs(batches):
        if own != node or 20 * len(ids) > CHUNK:
            close()
            node, ids = own, []
        ids = ids + [x[0] for x in rows]
        size += len(rows)
        if size > CHUNK // 20:
            if out:
                yield _batch(out, names, kinds)
            out, size = [], len(ids)
    close()
    if out:
        yield _batch(out, names, kinds)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = [*NODE, "ends_sha256"], [pa.int64()] * 3 + [pa.string()]
    out, node, digest = [], None, None
    for own, rows in _runs(batches):
        if own == node:
            digest.update(b",")
        else:
            if digest:
                out.append((*node, digest.hexdigest()))
            node, digest = own, hashlib.sha256()
        digest.update(",".join(piece for _, piece in rows).encode())
        if len(out) >= 10_000:
            yield _batch(out, names, kinds)
            out = []
    if digest:
        out.append((*node, digest.hexdigest()))
    if out:
        yield _batch(out, names, kinds)
