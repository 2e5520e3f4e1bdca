"""SimHash near-duplicates: pigeonhole blocks of fingerprints, joined and verified by Hamming distance.

Fingerprint of a text: the XXH64 (UTF-8, seed 42) of each of its word shingles, repeats included,
votes on 64 bits; a bit is 1 where more than half of them have it. Texts are read where they lie and
only (id, fingerprint) goes on.

Links: the 64 bits are cut into `n` blocks. Two fingerprints that differ in at most `radius` bits
agree on n - radius whole blocks, so each choice of that many blocks is a table keyed by their bits,
and every close pair shares a key of some table. `n` grows with the number of distinct fingerprints,
so that unlike fingerprints seldom share a key; any `n` finds the same links.

Distinct fingerprints that share a key are compared where they meet: from one of them outwards, each
against those that nothing has reached yet. What comes out is a tree for each set of linked ones, not
their pairs. Keys that more than `LIMIT` distinct fingerprints share are found first by counts; what
has such a key goes through tables of two blocks more, whose keys are longer and hold fewer, and so
on. What is still crowded at `MOST_BLOCKS` takes another exact way: two fingerprints are within
2 * r bits if and only if some value is within r bits of both, so each is written beside all values
around it, and those beside one value are linked with the least of them. That costs the same for each
fingerprint, however many are close.

Components are those of `components`; a component is known by its smallest document id.

Cases: words are what lies between space and 09-0D, A-Z lower-cased. A text of fewer words than a
shingle votes once, with all its words; null, empty and blank texts have the fingerprint 0 and link
like any other. Rows that repeat an id are documents of their own. A row without an id has a
fingerprint; its component is the smallest id it reaches, null if there is none. Ids are cast to
bigint. Equal texts, a third of all or more, are one fingerprint. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm import words as w
from loanlens.llm.components import components
from loanlens.llm.rows import Compute, add_column
from loanlens.llm.storage import cut

c = F.col

BITS = 64
SEED = 42
#: Distinct fingerprints of one key that are compared in one task.
LIMIT = 4096
#: Blocks of the finest tables.
MOST_BLOCKS = 12
#: Unlike fingerprints that should share a key at most, on average.
CROWD = 4
#: Hashes whose votes are summed at once.
PART = 1 << 20

_U = np.uint64
_LANES = _U(0x0000000100000001)


def joined(words: w.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins and ends."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    data = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, dtype=np.uint8)
    inside = np.ones(len(data), dtype=bool)
    inside[end] = False
    data[inside] = words.bytes[w.PLAIN[words.bytes]]
    return data.tobytes(), end - size, end


def shingles(words: w.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and last word of every shingle, and the number of shingles of each text."""
    count = words.counts()
    number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    length = np.minimum(np.repeat(count, number), size)
    before = np.repeat(np.cumsum(number) - number, number)
    first = np.repeat(words.first[:-1], number) + np.arange(int(number.sum())) - before
    return first, first + length - 1, number


def votes(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from the hashes of its shingles, which lie in a row."""
    some = np.flatnonzero(number)
    starts = (np.cumsum(number) - number)[some]
    out = np.zeros(len(number), dtype=_U)
    found = np.zeros(len(some), dtype=_U)
    for k in range(32):
        lane = np.zeros(len(some), dtype=_U)
        for at in range(0, len(hashes), PART):  # a text may lie in several parts
            part = (hashes[at : at + PART] >> _U(k)) & _LANES
            low = np.searchsorted(starts, at, side="right") - 1
            high = np.searchsorted(starts, at + len(part), side="left")
            cuts = np.maximum(starts[low:high] - at, 0)
            lane[low:high] += np.add.reduceat(part, cuts)
        for shift, ones in ((k, lane & _U(0xFFFFFFFF)), (k + 32, lane >> _U(32))):
            found |= (_U(2) * ones > number[some].astype(_U)).astype(_U) << _U(shift)
    out[some] = found
    return out


def simhash(texts: pa.Array, size: int) -> np.ndarray:
    """Unsigned fingerprints of texts."""
    words = w.Words(texts, w.PLAIN, lower=True)
    data, begin, end = joined(words)
    first, last, number = shingles(words, size)
    hashed = xxhash.xxh64_intdigest
    spans = zip(begin[first].tolist(), end[last].tolist(), strict=True)
    hashes = np.fromiter((hashed(data[s:e], SEED) for s, e in spans), _U, len(first))
    return votes(hashes, number)


def fingerprints(
    docs: DataFrame, shingle: int = 5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint) of each row; the fingerprint's bits are a bigint's."""

    def start() -> Compute:
        def compute(part: pa.RecordBatch) -> pa.Array:
            return pa.array(simhash(part.column("text"), shingle).view(np.int64))

        return compute

    rows = docs.select(c(key).cast("long").alias("doc_id"), c(text).cast("string").alias("text"))
    return add_column(rows, "fingerprint", "long", "text", start).drop("text")


def masks(radius: int, blocks: int) -> list[int]:
    """The bits that each table is keyed by: blocks - radius of the blocks, as signed 64-bit."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    each = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:], strict=False)]
    out = []
    for chosen in combinations(each, blocks - radius):
        mask = sum(chosen)
        out.append(mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask)
    return out


def blocks_for(distinct: int, radius: int) -> int:
    """The least number of blocks whose keys tell so many unlike fingerprints apart."""
    blocks = radius + 1
    while distinct > CROWD << (BITS * (blocks - radius) // blocks) and blocks < 2 * radius + 1:
        blocks += 1
    return blocks


def differing(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The number of differing bits; of signed values numpy would count those of the amount."""
    return np.bitwise_count((one ^ other).view(_U))


def tree(values: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """(first, others) of each set of distinct values that links of at most `radius` bits connect,
    for sets of two and more."""
    out = []
    while len(values) > 1:
        root, values, found = values[0], values[1:], []
        ask = [root]
        while ask and len(values):
            near = differing(values, ask.pop()) <= radius
            if near.any():
                reached = values[near]
                found.append(reached)
                ask.extend(reached)
                values = values[~near]
        if found:
            out.append((root, np.concatenate(found)))
    return out


def _linked(number: np.ndarray, key: np.ndarray, value: np.ndarray, radius: int) -> list:
    """Edges among the values of each (number, key); rows are sorted by both."""
    if not len(key):
        return []
    new = np.ones(len(key), dtype=bool)
    new[1:] = (number[1:] != number[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(key)))
    pairs = starts[sizes == 2]
    near = differing(value[pairs], value[pairs + 1]) <= radius
    out = [(value[pairs[near]], value[pairs[near] + 1])]
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        for root, others in tree(value[s : s + n], radius):
            out.append((np.full(len(others), root), others))
    return out


_EDGE = "a long, b long"


def _edges(radius: int):
    """From rows sorted by (number, key), whole keys in a partition, to edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 3
        for batch in [*_arrays(batches), None]:
            rows, whole = kept, len(kept[0])
            if batch is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(kept, batch, strict=True)]
                last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
                whole = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            kept = [x[whole:] for x in rows]
            for a, b in _linked(*(x[:whole] for x in rows), radius):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield [x.to_numpy(zero_copy_only=False) for x in batch.columns]


def _around(radius: int):
    """(near, value) for each value: all values within radius / 2 bits of it."""
    flips = [0]
    for n in range(1, radius // 2 + 1):
        flips += [sum(1 << k for k in chosen) for chosen in combinations(range(BITS), n)]
    flips = np.array(flips, dtype=_U).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (values,) in _arrays(batches):
            for at in range(0, len(values), 64):
                own = values[at : at + 64]
                near = (own[:, None] ^ flips).ravel()
                both = [pa.array(near), pa.array(np.repeat(own, len(flips)))]
                yield pa.RecordBatch.from_arrays(both, names=["near", "value"])

    return run


def _keyed(values: DataFrame, radius: int, blocks: int) -> DataFrame:
    keys = F.array(*[c("fingerprint").bitwiseAND(F.lit(m)) for m in masks(radius, blocks)])
    return values.select(F.posexplode(keys).alias("number", "key"), "fingerprint")


def _through_middles(values: DataFrame, radius: int) -> DataFrame:
    """Edges of the least value around each middle and the others around it."""
    beside = values.mapInArrow(_around(radius), "near long, value long")
    least = beside.groupBy("near").agg(F.min("value").alias("a"), F.count(F.lit(1)).alias("n"))
    least = cut(least.where("n > 1").drop("n"))
    edges = beside.join(least, "near").where("value != a")
    return edges.select("a", c("value").alias("b")).distinct()


def links(
    values: DataFrame, radius: int = 4, limit: int = LIMIT, most_blocks: int = MOST_BLOCKS
) -> DataFrame:
    """Edges (a, b) between values that differ in at most `radius` bits; they connect exactly what
    all such pairs connect. `values` has one column `fingerprint` of distinct values. The radius is
    even, since the last way goes through the value in the middle."""
    if radius % 2:
        raise ValueError(f"the radius must be even, not {radius}")
    found = []
    for blocks in range(blocks_for(values.count(), radius), most_blocks + 1, 2):
        keyed = _keyed(values, radius, blocks)
        heavy = keyed.groupBy("number", "key").agg(F.count(F.lit(1)).alias("n"))
        heavy = cut(heavy.where(c("n") > limit).drop("n"))
        crowded = not heavy.isEmpty()
        light = keyed.join(heavy, ["number", "key"], "left_anti") if crowded else keyed
        light = light.select(c("number").cast("long").alias("number"), "key", "fingerprint")
        light = light.repartition("number", "key")
        met = light.sortWithinPartitions("number", "key", "fingerprint")
        found.append(met.mapInArrow(_edges(radius), _EDGE))
        if not crowded:
            break
        values = keyed.join(heavy, ["number", "key"], "left_semi").select("fingerprint")
        values = cut(values.distinct())
    else:
        found.append(_through_middles(values, radius))
    return reduce(DataFrame.unionByName, found)


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    radius: int = 4,
    key: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """One row per document: doc_id, fingerprint (bigint), component_id."""
    found = cut(fingerprints(docs, shingle, key, text))
    nodes = cut(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    joined_to = cut(components(links(nodes.select("fingerprint"), radius, limit)))
    named = nodes.join(joined_to, nodes["fingerprint"] == joined_to["node"], "left")
    named = named.select("fingerprint", "least", "component")
    lowest = named.where("component is not null").groupBy("component")
    lowest = cut(lowest.agg(F.min("least").alias("lowest")))
    # Both sides of a join are stored, so that Spark can split a heavy key.
    named = named.join(lowest, "component", "left").select(
        c("fingerprint").alias("own"), F.when(c("component").isNull(), c("least")).otherwise(
            c("lowest")).alias("component_id")
    )
    named = cut(named)
    out = found.join(named, found["fingerprint"] == named["own"])
    return out.select("doc_id", "fingerprint", "component_id")
