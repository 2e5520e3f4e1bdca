"""Document fingerprints: SimHash with DataFrame functions only.

Each distinct term of a text votes with its weight on the 64 bits of its hash; a bit of the
fingerprint is set where the set votes outweigh the others. Two bits share one bigint sum (32 bits
apart), so a text needs 32 sums, which are taken while the terms are unfolded: no term is shuffled.
The weight grows with a term's length, since short words are the common ones.

Fingerprints within a Hamming radius are found by permuted block tables: the 64 bits are cut into
`radius + 3` blocks, and each choice of three blocks is a table keyed by their bits. Fingerprints
that differ in at most `radius` bits agree on some three blocks, so they meet in a table; they are
reported only from the first one in which they meet. Equal fingerprints are one row of a table.

Cases: null is the empty text; a text without words has the fingerprint 0. Null ids sort first,
equal ids by their text. The document after the last is the first; a table of one row is its own
next. Repeated rows stay rows of their own. The input's other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.blocks import Blocks

c = F.col

BITS = 64
LANES = 0x0000000100000001
HALF = 0xFFFFFFFF
#: Texts are cut into words at these characters (fixed values: space and 09 to 0D).
BETWEEN = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), BETWEEN)), "")


def weight(term: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.length(term), F.lit(10)) - 2).cast("long")


def votes(term: Column) -> list[Column]:
    """The sums to take over the terms: total weight, and the set votes of bits k and k + 32."""
    value = F.xxhash64(term)
    own = F.when(term.isNotNull(), weight(term)).otherwise(F.lit(0).cast("long"))
    lanes = [
        F.sum(F.shiftrightunsigned(value, k).bitwiseAND(F.lit(LANES)) * own).alias(f"v{k}")
        for k in range(32)
    ]
    return [F.sum(own).alias("total"), *lanes]


def fingerprint(prefix: str = "") -> Column:
    """The fingerprint (bigint) from the sums of `votes`."""
    total, out = c(f"{prefix}total"), F.lit(0).cast("long")
    for k in range(32):
        lane = c(f"{prefix}v{k}")
        for shift, set_votes in (
            (k, lane.bitwiseAND(F.lit(HALF))),
            (k + 32, F.shiftrightunsigned(lane, 32)),
        ):
            bit = F.when(2 * set_votes > total, F.lit(1)).otherwise(F.lit(0)).cast("long")
            out = out.bitwiseOR(F.shiftleft(bit, shift))
    return out


def as_text(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def likeness(one: Column, other: Column) -> Column:
    """1 for equal fingerprints, 0 where all bits differ."""
    return F.lit(1.0) - F.bit_count(one.bitwiseXOR(other)) / F.lit(float(BITS))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id and the fingerprint of its text."""
    rows = docs.select(
        c(key).cast("long").alias("doc_id"),
        F.coalesce(c(text).cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    found = rows.select("doc_id", "row", F.explode_outer(terms(c("text"))).alias("term"))
    sums = found.groupBy("row", "doc_id").agg(*votes(c("term")))
    return sums.select("doc_id", fingerprint().alias("fingerprint"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, fingerprint, the edited text (its last half replaced by the start of the next
    document) and its fingerprint, and the next document's fingerprint.

    Documents are cut into blocks by id. The first document of each block is also put, marked, at
    the end of the block before, so that a block knows what follows each of its documents; from
    there on nothing is shuffled again.
    """
    blocks = Blocks(docs, key, text)
    rows = docs.select(
        c(key).cast("long").alias("doc_id"),
        F.coalesce(c(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select("doc_id", "text", blocks.of(c("doc_id")).alias("block"))
    first = Window.partitionBy("block").orderBy("doc_id", "text")
    heads = rows.withColumn("at", F.row_number().over(first)).where("at = 1").drop("at")
    every = rows.withColumn("borrowed", F.lit(False))
    if blocks.rows:
        every = every.unionByName(
            _before(rows, heads, blocks).withColumn("borrowed", F.lit(True))
        )
    order = Window.partitionBy("block").orderBy("borrowed", "doc_id", "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    ready = (
        every.withColumn("at", F.row_number().over(order))
        .withColumn("follows", F.lead("text").over(order))
        .withColumn(
            "edited",
            F.concat(
                c("text").substr(F.lit(1), n - half),
                F.coalesce(c("follows"), F.lit("")).substr(F.lit(1), half),
            ),
        )
    )
    carried = ["block", "at", "borrowed", "doc_id", "n_chars", "edited_sha256"]
    kinds = ready.select(
        "block",
        "at",
        "borrowed",
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), c("text").alias("body")),
                F.struct(F.lit(1).alias("kind"), c("edited").alias("body")),
            )
        ).alias("z"),
    )
    unfolded = kinds.select(*carried, "z.kind", terms(c("z.body")).alias("terms")).select(
        *carried, "kind", F.explode_outer("terms").alias("term")
    )
    sums = unfolded.groupBy(*carried, "kind").agg(*votes(c("term")))
    both = sums.select(*carried, "kind", fingerprint().alias("f")).groupBy(*carried).agg(
        F.max(F.when(c("kind") == 0, c("f"))).alias("fingerprint"),
        F.max(F.when(c("kind") == 1, c("f"))).alias("edited_fingerprint"),
    )
    return (
        both.withColumn(
            "next_fingerprint",
            F.lead("fingerprint").over(Window.partitionBy("block").orderBy("at")),
        )
        .where(~c("borrowed"))
        .drop("block", "at", "borrowed")
    )


def _before(rows: DataFrame, heads: DataFrame, blocks: Blocks) -> DataFrame:
    """The first document of each block, with the number of the block before it that has rows.

    Only a finer cut can leave a block empty: the blocks of one edge are looked at together, and
    the first of an edge always has rows.
    """
    edge = F.floor(c("block") / blocks.finer).cast("long")
    there = rows.select("block").distinct().withColumn("edge", edge)
    previous = there.withColumn(
        "previous", F.lag("block").over(Window.partitionBy("edge").orderBy("block"))
    )
    last = there.groupBy("edge").agg(F.max("block").alias("last"))
    last = last.withColumn("edge", F.pmod(c("edge") + 1, F.lit(len(blocks.edges))))
    before = previous.join(last, "edge").select(
        "block", F.coalesce("previous", "last").alias("before")
    )
    return heads.join(before, "block").select("doc_id", "text", c("before").alias("block"))


def masks(radius: int) -> list[int]:
    """The bits that each table is keyed by: three of radius + 3 blocks, as signed 64-bit."""
    n = radius + 3
    edges = [BITS * i // n for i in range(n + 1)]
    block = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:], strict=False)]
    out = []
    for chosen in combinations(block, 3):
        mask = sum(chosen)
        out.append(mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask)
    return out


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """(fingerprint, near) for each fingerprint of `queries` and each of `index` that differs in at
    most `radius` bits, itself included. Both have a column `fingerprint`."""
    tables = masks(radius)

    def keyed(frame: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[c("fingerprint").bitwiseAND(F.lit(m)) for m in tables])
        return (
            frame.where(c("fingerprint").isNotNull())
            .select("fingerprint")
            .distinct()
            .select(c("fingerprint").alias(name), F.posexplode(keys).alias("number", "key"))
        )

    differ = c("fingerprint").bitwiseXOR(c("near"))
    agree = F.array(*[differ.bitwiseAND(F.lit(m)) for m in tables])
    return (
        keyed(queries, "fingerprint")
        .join(keyed(index, "near"), ["number", "key"])
        .where(F.bit_count(differ) <= radius)
        .where(F.array_position(agree, F.lit(0).cast("long")) == c("number") + 1)
        .select("fingerprint", "near")
    )
