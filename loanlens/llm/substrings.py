"""Substring dedup: every window of `size` words that occurred earlier is removed.

Rabin-Karp hashes of all windows are counted in Spark: each block of documents sends its distinct
window hashes to hash buckets, a bucket tells each block which of its windows an earlier block
holds too, and the block finds repeats of its own. Blocks ascend by id, so the first occurrence in
(id, start) order is the one that stays. Repeated windows of a text merge into maximal intervals.

Two independent window hashes tell windows apart. Inside a block both are compared, 128 bits.
Between blocks the sent value is the first one and the bucket comes from the second, so about 70
bits count at 10**8 windows (75 buckets), and more where there are more buckets.

Cases: null and empty texts and texts shorter than a window lose nothing. Null ids sort first.
Rows with equal ids keep an order fixed by their texts. The input's other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm import words as w
from loanlens.llm.blocks import Blocks, on_table, on_tables

REPEATS = (
    "doc_id long, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, "
    "kept string"
)


def _windows(block: pa.Table, size: int):
    """(slice, its words, window hashes, second window hashes, window starts), in id order."""
    block = block.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    nulls = block["doc_id"].null_count  # sort_by puts nulls last
    if nulls:
        n = block.num_rows - nulls
        block = pa.concat_tables([block.slice(n), block.slice(0, n)])
    for part in w.slices(block.combine_chunks(), "text"):
        words = w.Words(part.column("text"), w.PLAIN, lower=False)
        name, starts = w.windows(words.hashes(11), words.first, size, 13, False)
        second, _ = w.windows(words.hashes(15), words.first, size, 17, False)
        yield part, words, name, second, starts


def _send(block: pa.Table, size: int, n_buckets: int) -> pa.Table:
    """The block's distinct windows, one packed row for each bucket."""
    number = block["block"][0].as_py()
    names, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for _, _, name, second, _ in _windows(block, size):
        names.append(name)
        at.append(w.buckets(second, n_buckets))
    names, at = np.concatenate(names), np.concatenate(at)
    order = np.lexsort((names, at))
    names, at = names[order], at[order]
    new = np.ones(len(names), dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | (at[1:] != at[:-1])
    names, at = names[new], at[new]
    cut, ends = w.runs(at)
    return pa.table(
        {
            "bucket": pa.array(at[cut], pa.int64()),
            "block": pa.array([number] * len(cut), pa.int64()),
            "names": pa.array(
                [w.pack(names[s:e]) for s, e in zip(cut, ends, strict=True)], pa.binary()
            ),
        }
    )


def _earlier(bucket: pa.Table) -> pa.Table:
    """For each block, those of its windows that a block before it has."""
    blocks = bucket["block"].to_numpy()
    order = np.argsort(blocks, kind="stable")
    data = bucket["names"].combine_chunks()
    parts = [w.unpack(data[int(i)].as_buffer(), np.uint64) for i in order]
    names = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    by_name = np.argsort(names, kind="stable")  # within a name, the blocks ascend
    again = np.zeros(len(names), dtype=bool)
    ranked = names[by_name]
    again[by_name[1:]] = ranked[1:] == ranked[:-1]
    hit, of = names[again], owner[again]
    cut, ends = w.runs(of)
    return pa.table(
        {
            "bucket": pa.array([bucket["bucket"][0].as_py()] * len(cut), pa.int64()),
            "block": pa.array(blocks[order][of[cut]], pa.int64()),
            "names": pa.array(
                [w.pack(hit[s:e]) for s, e in zip(cut, ends, strict=True)], pa.binary()
            ),
        }
    )


def _remove(block: pa.Table, earlier: pa.Table, size: int, n_buckets: int) -> pa.Table:
    """Each document's repeated words, as intervals and as the text without them."""
    data = earlier["names"].combine_chunks() if earlier.num_rows else []
    known = [w.unpack(data[i].as_buffer(), np.uint64) for i in range(len(data))]
    at = np.repeat(earlier["bucket"].to_numpy(), [len(x) for x in known])
    known = np.concatenate(known) if known else np.empty(0, np.uint64)
    every = np.unique(known)
    # A name and its bucket as one number.
    keys = np.sort(np.searchsorted(every, known) * n_buckets + at)
    out = []
    if not block.num_rows:
        return pa.Table.from_batches([], schema=_ARROW)
    parts = list(_first_here(block, size))
    for part, words, names, second, starts, fresh in parts:
        seen = np.zeros(len(names), bool)
        if len(keys):
            at = np.minimum(np.searchsorted(every, names), len(every) - 1)
            own = at * n_buckets + w.buckets(second, n_buckets)
            to = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            seen = (every[at] == names) & (keys[to] == own)
        bad = starts[seen | ~fresh]
        step = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(step, bad, 1)
        np.add.at(step, bad + size, -1)
        gone = np.cumsum(step[:-1]) > 0
        out.append(_result(part, words, gone))
    return pa.concat_tables(out)


def _first_here(block: pa.Table, size: int):
    """Adds whether a window is the first of its name in the block. Words are found twice, so that
    only window hashes are held for the whole block."""
    names, others = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for _, _, name, second, _ in _windows(block, size):
        names.append(name)
        others.append(second)
    names, others = np.concatenate(names), np.concatenate(others)
    order = np.lexsort((others, names))  # stable
    names, others = names[order], others[order]
    fresh = np.ones(len(names), dtype=bool)
    fresh[order[1:]] = (names[1:] != names[:-1]) | (others[1:] != others[:-1])
    at = 0
    for part, words, name, second, starts in _windows(block, size):
        yield part, words, name, second, starts, fresh[at : at + len(name)]
        at += len(name)


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.string()),
    ]
)


def _result(part: pa.RecordBatch, words: w.Words, gone: np.ndarray) -> pa.Table:
    n = part.num_rows
    count = words.counts()
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[words.first[1:]] - total[words.first[:-1]]
    # Intervals: runs of removed words, cut at the ends of texts.
    text_of = np.repeat(np.arange(n), count)
    begins = gone.copy()
    begins[1:] &= ~(gone[:-1] & (text_of[1:] == text_of[:-1]))
    ends = gone.copy()
    ends[:-1] &= ~(gone[1:] & (text_of[1:] == text_of[:-1]))
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = text_of[start]
    base = words.first[:-1][owner]
    lists = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    spans = pa.StructArray.from_arrays(
        [pa.array(start - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"]
    )
    # Kept text: each kept word with a space behind it, the last space of a text left out.
    keep = np.flatnonzero(~gone)
    length = words.end[keep] - words.start[keep] + 1
    total = np.concatenate([[0], np.cumsum(length)])
    source = np.repeat(words.start[keep] - total[:-1], length) + np.arange(total[-1])
    padded = np.append(words.bytes, np.uint8(32))
    data = padded[np.minimum(source, len(words.bytes))]
    data[total[1:] - 1] = 32
    left = np.searchsorted(keep, words.first)
    edge = total[left]
    filled = np.diff(edge) > 0
    mask = np.ones(len(data), dtype=bool)
    mask[edge[1:][filled] - 1] = False
    offsets = np.concatenate([[0], np.cumsum(np.diff(edge) - filled)]).astype(np.int64)
    kept = pa.LargeStringArray.from_buffers(
        n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[mask].tobytes())
    )
    return pa.table(
        [
            part.column("doc_id").cast(pa.int64()),
            pa.array(count, pa.int64()),
            pa.array(removed, pa.int64()),
            pa.ListArray.from_arrays(pa.array(lists), spans),
            kept.cast(pa.string()),
        ],
        schema=_ARROW,
    )


def remove_repeats(
    docs: DataFrame, size: int = 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, intervals of removed words [start, end)
    and kept, the other words joined by one space."""
    blocks = Blocks(docs, key, text)
    cut = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).withColumn("block", blocks.of(F.col("doc_id")))
    sent = cut.groupBy("block").applyInArrow(
        on_table(_send, size=size, n_buckets=blocks.count),
        "bucket long, block long, names binary",
    )
    earlier = sent.groupBy("bucket").applyInArrow(
        on_table(_earlier), "bucket long, block long, names binary"
    )
    return (
        cut.groupBy("block")
        .cogroup(earlier.groupBy("block"))
        .applyInArrow(on_tables(_remove, size=size, n_buckets=blocks.count), REPEATS)
    )
