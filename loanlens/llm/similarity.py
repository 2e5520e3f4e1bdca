"""N-gram Jaccard join by a token-group matrix: documents that share enough of their shingles.

1. Blocks of documents send shingle hashes with counts, packed, to hash buckets (exact copies count
   once); a shingle, or a class of equal sets, that very many documents have is sent once for each
   block. A bucket answers with the shingles that several documents hold and a band of their count.
   Equal shingle sets become one class; its smallest id stands for it.
2. All shingles have one global order: those of one document only, then by count band and hash.
   Two sets that reach the threshold share at least `ell` shingles among the first
   n - ceil(threshold * n) + ell of each. A document whose prefix has fewer shared shingles is
   linked with nothing and goes no further.
3. Similar documents are partitioned into groups: documents that share a min-hash are compared
   with the most central one of them; what links forms a star, stars that meet form a label. A
   label, and the rest by min-hash, is dealt into groups of about `GROUP` shingles.
4. The token-group matrix holds the union of each group's prefix shingles. A document's overlap
   with a group's union bounds its overlap with every member, so groups with less than `ell`, or
   out of the range of sizes, stay closed. Groups of the document's own label stay closed too.
5. Opened groups are compared exactly, all members at once, with documents of about `QUERIES`
   shingles in a task.

Every pair that reaches the threshold is either inside one label or opened, so none is lost.
A large set of copies costs one comparison each with its centre.

Cases: null or empty text, or text without words, has no shingles and is its own component. A text
of fewer words than a shingle has one shingle, the whole sequence. A null id is left out of
linking and has a null component. Rows with the same id are in one component: texts of one id are
nodes of their own, named by a hash of id and text, and linked with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm import words as w
from loanlens.llm.blocks import Blocks, on_table, on_tables
from loanlens.llm.components import components
from loanlens.llm.rows import own_name
from loanlens.llm.storage import cut

c = F.col

#: Shingles of the members of a group, and of the documents compared with it in one task.
GROUP = 200_000
QUERIES = 200_000
ELL = 4

TOKENS, CLASSES = 0, 1
PACKED = "bucket long, block long, kind int, names binary, extra binary"
ROWS = (
    "doc_id long, n long, rep long, ell int, rare long, key long, "
    "prefix array<long>, tokens array<long>"
)


class Sets:
    """The distinct shingle hashes of some texts, sorted within each text."""

    def __init__(self, texts: pa.Array, size: int) -> None:
        words = w.Words(texts, w.PLAIN, lower=True)
        n = len(texts)
        names, starts = w.windows(words.hashes(21), words.first, size, 23, True)
        owner = np.searchsorted(words.first, starts, side="right") - 1
        order = np.lexsort((names, owner))
        names, owner = names[order], owner[order]
        new = np.ones(len(names), dtype=bool)
        new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
        self.names, self.owner = names[new], owner[new]
        self.counts = np.bincount(self.owner, minlength=n).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each set."""
        both = []
        for salt in (0x2545F4914F6CDD1D, 0x6C62272E07BB0142):
            total = np.concatenate(
                [[np.uint64(0)], np.cumsum(w.mix(self.names ^ np.uint64(salt)), dtype=np.uint64)]
            )
            both.append(w.mix(total[self.first[1:]] - total[self.first[:-1]]))
        return tuple(both)


def _packed(bucket, block, kind, names, extra) -> pa.Table:
    return pa.table(
        {
            "bucket": pa.array(bucket, pa.int64()),
            "block": pa.array(block, pa.int64()),
            "kind": pa.array([kind] * len(bucket), pa.int32()),
            "names": pa.array(names, pa.binary()),
            "extra": pa.array(extra, pa.binary()),
        }
    )


def _send(block: pa.Table, copies: pa.Table, size: int, n_buckets: int) -> pa.Table:
    number = block["block"][0].as_py()
    again = np.unique(copies["copy_id"].to_numpy())
    names, classes = [], []
    for part in w.slices(block, "text"):
        sets = Sets(part.column("text"), size)
        ids = part.column("doc_id")
        valid = ids.is_valid().to_numpy(False)
        some = (sets.counts > 0) & valid
        one, two = sets.digests()
        ids = ids.fill_null(0).to_numpy(False)
        counted = ~(valid & np.isin(ids, again))
        names.append(sets.names[counted[sets.owner]])
        classes.append(
            np.stack([one[some], two[some], ids[some].astype(np.int64).view(np.uint64)], axis=1)
        )
    names = np.concatenate(names) if names else np.empty(0, np.uint64)
    names, times = np.unique(names, return_counts=True)  # ascending, so buckets ascend too
    at = w.buckets(names, n_buckets)
    low = (names & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    starts, ends = w.runs(at)
    spans = list(zip(starts, ends, strict=True))
    out = [
        _packed(
            at[starts],
            [number] * len(starts),
            TOKENS,
            [w.pack(low[s:e]) for s, e in spans],
            [w.pack(np.minimum(times[s:e], 0xFFFFFFFF).astype(np.uint32)) for s, e in spans],
        )
    ]
    classes = np.concatenate(classes) if classes else np.empty((0, 3), np.uint64)
    classes = _first_of_class(np.column_stack([classes, np.ones(len(classes), np.uint64)]))
    at = w.buckets(classes[:, 0], n_buckets)
    order = np.argsort(at, kind="stable")
    classes, at = classes[order], at[order]
    starts, ends = w.runs(at)
    out.append(
        _packed(
            at[starts],
            [number] * len(starts),
            CLASSES,
            [w.pack(classes[s:e]) for s, e in zip(starts, ends, strict=True)],
            [None] * len(starts),
        )
    )
    return pa.concat_tables(out)


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (digest, digest, id, number) by class and id, and where each class begins."""
    order = np.lexsort((rows[:, 2].view(np.int64), rows[:, 1], rows[:, 0]))
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[order][1:, :2] != rows[order][:-1, :2]).any(axis=1)
    return order, np.flatnonzero(new)


def _first_of_class(rows: np.ndarray) -> np.ndarray:
    """One row for each class: its smallest id and its number of members."""
    if not len(rows):
        return rows
    order, starts = _classes(rows)
    out = rows[order][starts]
    out[:, 3] = np.add.reduceat(rows[order][:, 3], starts)
    return out


def _bands(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, 1 + np.floor(2 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def _answer(bucket: pa.Table) -> pa.Table:
    """Shared shingles and their bands, and members of classes, back to each block."""
    number = bucket["bucket"][0].as_py()
    rows = list(
        zip(
            bucket["block"].to_pylist(),
            bucket["kind"].to_pylist(),
            bucket["names"].to_pylist(),
            bucket["extra"].to_pylist(),
            strict=True,
        )
    )
    blocks, names, extra = [], [], []
    sent = [(b, w.unpack(x, np.uint32)) for b, k, x, _ in rows if k == TOKENS]
    if sent:
        times = np.concatenate([w.unpack(n, np.uint32) for _, k, _, n in rows if k == TOKENS])
        every, at = np.unique(np.concatenate([x for _, x in sent]), return_inverse=True)
        counts = np.bincount(at, weights=times)
        shared, bands = every[counts > 1], _bands(counts[counts > 1])
        for block, own in sent:
            mine = np.isin(shared, own)
            if mine.any():
                blocks.append(block)
                names.append(w.pack(shared[mine]))
                extra.append(w.pack(bands[mine]))
    out = [_packed([number] * len(blocks), blocks, TOKENS, names, extra)]
    sent = [(b, w.unpack(x, np.uint64).reshape(-1, 4)) for b, k, x, _ in rows if k == CLASSES]
    if sent:
        every = np.concatenate([x for _, x in sent])
        owner = np.repeat([b for b, _ in sent], [len(x) for _, x in sent])
        order, starts = _classes(every)
        every, owner = every[order], owner[order]
        sizes = np.diff(np.append(starts, len(every)))
        rep = np.repeat(every[starts, 2], sizes)
        several = np.repeat(np.add.reduceat(every[:, 3], starts) > 1, sizes)
        order = np.argsort(owner[several], kind="stable")
        owner, every, rep = (x[several][order] for x in (owner, every, rep))
        starts, ends = w.runs(owner)
        spans = list(zip(starts, ends, strict=True))
        out.append(
            _packed(
                [number] * len(starts),
                owner[starts],
                CLASSES,
                [w.pack(every[s:e, :2]) for s, e in spans],
                [w.pack(rep[s:e]) for s, e in spans],
            )
        )
    return pa.concat_tables(out)


def _prefixes(
    block: pa.Table, answers: pa.Table, size: int, percent: int, n_buckets: int
) -> pa.Table:
    """A row for each document; those that may have links bring their prefix and their set."""
    keys, bands, classes = [], [], {}
    for bucket, kind, names, extra in zip(
        *(answers[k].to_pylist() for k in ("bucket", "kind", "names", "extra")), strict=True
    ):
        if kind == TOKENS:
            keys.append(w.unpack(names, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
            bands.append(w.unpack(extra, np.uint8))
        else:
            own = w.unpack(names, np.uint64).reshape(-1, 2)
            reps = w.unpack(extra, np.int64).tolist()
            classes.update(zip(map(tuple, own.tolist()), reps, strict=True))
    keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    bands = np.concatenate(bands) if bands else np.empty(0, np.uint8)
    order = np.argsort(keys)
    keys, bands = keys[order], bands[order]
    out = [_rows(part, keys, bands, classes, size, percent, n_buckets)
           for part in w.slices(block, "text")]
    return pa.concat_tables(out) if out else _SCHEMA.empty_table()


_LISTS = pa.list_(pa.int64())
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("rep", pa.int64()), ("ell", pa.int32())]
    + [(k, pa.int64()) for k in ("rare", "key")]
    + [("prefix", _LISTS), ("tokens", _LISTS)]
)


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(values.view(np.int64), pa.int64())
    )


def _least(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The smallest value of each owner; values come sorted by owner."""
    out = np.zeros(n, dtype=np.uint64)
    starts, _ = w.runs(owner)
    if len(starts):
        out[owner[starts]] = np.minimum.reduceat(values, starts)
    return out


def _rows(part, keys, bands, classes, size, percent, n_buckets) -> pa.Table:
    sets = Sets(part.column("text"), size)
    n = part.num_rows
    ids = part.column("doc_id")
    plain = ids.to_pylist()
    digests = zip(*(x.tolist() for x in sets.digests()), strict=True)
    some = zip(plain, digests, sets.counts.tolist(), strict=True)
    rep = [i if i is None or not k else classes.get(d, i) for i, d, k in some]
    names, owner, counts = sets.names, sets.owner, sets.counts
    own = (w.buckets(names, n_buckets).astype(np.uint64) << np.uint64(32)) | (
        names & np.uint64(0xFFFFFFFF)
    )
    band = np.zeros(len(names), np.uint8)
    if len(keys):
        at = np.searchsorted(keys, own)
        at[at == len(keys)] = 0
        band = np.where(keys[at] == own, bands[at], 0)
    least = -(-percent * counts // 100)
    partner = -(-percent * least // 100)
    ell = np.minimum(ELL, partner) if percent >= 80 else np.minimum(1, counts)
    reach = counts - least + ell
    order = np.lexsort((names, band, owner))
    rank = np.arange(len(names)) - sets.first[owner]
    taken = order[(rank < reach[owner]) & (band[order] > 0)]  # owners keep their order
    found = np.bincount(owner[taken], minlength=n)
    live = (found >= np.maximum(ell, 1)) & np.array(
        [r is not None and r == i for r, i in zip(rep, plain, strict=True)], dtype=bool
    )
    taken = taken[live[owner[taken]]]
    shared = np.flatnonzero((band > 0) & live[owner])
    rare = counts - np.bincount(owner[shared], minlength=n)
    key = _least(w.mix(names[shared] ^ np.uint64(0xA5A5A5A5)), owner[shared], n)
    every = np.flatnonzero(live[owner])
    dead = ~live

    def some(values: np.ndarray) -> pa.Array:
        return pa.array(values.view(np.int64), pa.int64(), mask=dead)

    return pa.table(
        [
            ids.cast(pa.int64()),
            pa.array(counts, pa.int64()),
            pa.array(rep, pa.int64()),
            pa.array(ell, pa.int32()),
            some(rare.astype(np.int64)),
            some(key),
            _lists(owner[taken], names[taken], n),
            _lists(owner[every], names[every], n),
        ],
        schema=_SCHEMA,
    )


def _verify(queries: pa.Table, members: pa.Table, percent: int) -> pa.Table:
    """Links between some documents and the members of a group, at most one for each pair of a
    document and a label."""
    left, right = [], []
    if queries.num_rows and members.num_rows:
        tokens = members["m_tokens"].combine_chunks()
        lengths = tokens.value_lengths().to_numpy(False)
        values = tokens.flatten().to_numpy(False)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        m_ids = members["m_doc_id"].to_numpy()
        m_label = members["m_label"].to_numpy()
        sizes = members["m_n"].to_numpy()
        for chunk in range(0, queries.num_rows, 32):
            part = queries.slice(chunk, 32)
            tokens = part["tokens"].combine_chunks()
            counts = tokens.value_lengths().to_numpy(False)
            asked = tokens.flatten().to_numpy(False)
            who = np.repeat(np.arange(len(counts)), counts)
            low = np.searchsorted(values, asked, side="left")
            high = np.searchsorted(values, asked, side="right")
            times = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
            at = at + np.arange(len(at))
            pair = np.repeat(who, times) * len(sizes) + owner[at]
            both = np.bincount(pair, minlength=len(counts) * len(sizes))
            both = both.reshape(len(counts), len(sizes))
            n = part["n"].to_numpy()[:, None]
            linked = 100 * both >= percent * (n + sizes[None, :] - both)
            q_ids = part["doc_id"].to_numpy()
            linked &= q_ids[:, None] != m_ids[None, :]
            q, m = np.nonzero(linked)
            _, one = np.unique(np.stack([q, m_label[m]], axis=1), axis=0, return_index=True)
            left.append(q_ids[q[one]])
            right.append(m_ids[m[one]])
    return pa.table(
        {
            "a": pa.array(np.concatenate(left) if left else [], pa.int64()),
            "b": pa.array(np.concatenate(right) if right else [], pa.int64()),
        }
    )


def similar_documents(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest linked id)."""
    blocks = Blocks(docs, key, text)
    dealt = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).withColumn("block", blocks.of(c("doc_id")))
    n_buckets = blocks.count
    # Shingles of exact copies count once, for the copy with the smallest id.
    exact = dealt.where("doc_id is not null").select(
        "block", "doc_id", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(7), "text").alias("y")
    )
    several = _several(exact)
    if several is not None:
        dealt = _apart(dealt, several)
        exact = dealt.where("doc_id is not null").select(
            "block", "doc_id", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(7), "text").alias("y")
        )
        own = dealt.where("own is not null").select(c("doc_id").alias("node_"), "own").distinct()
        dealt = dealt.drop("own")
    least = exact.groupBy("x", "y").agg(
        F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("k")
    )
    # Stored first, so that Spark can split the join at a text that very many rows have.
    copies = (
        exact.join(cut(least.where("k > 1").drop("k")), ["x", "y"])
        .where(c("doc_id") != c("kept"))
        .select(c("block").alias("at"), c("doc_id").alias("copy_id"))
    )
    sent = (
        dealt.groupBy("block")
        .cogroup(copies.groupBy("at"))
        .applyInArrow(on_tables(_send, size=shingle, n_buckets=n_buckets), PACKED)
    )
    answers = sent.groupBy("bucket").applyInArrow(on_table(_answer), PACKED)
    rows = cut(
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            on_tables(_prefixes, size=shingle, percent=percent, n_buckets=n_buckets), ROWS
        )
    )
    links = _links(rows.where("key is not null"), percent)
    if several is not None:
        return _by_id(rows, links, own)
    found = cut(components(links))
    return (
        rows.select("doc_id", c("n").alias("n_shingles"), "rep")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    )


def one_of_each_group(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of the documents that stand for their group, those with the smallest id.

    Documents without an id are in no group and stay. Of rows that repeat an id one stays, by the
    digest of its text and then by its other columns.
    """
    found = similar_documents(docs, shingle=shingle, percent=percent)
    drop = found.where("component_id != doc_id").select(c("doc_id").alias("gone")).distinct()
    kept = docs.join(drop, docs["doc_id"] == drop["gone"], "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    again = cut(again.select(c("doc_id").alias("again")))
    if again.isEmpty():
        return kept
    # The smallest row of each such id is found before the shuffle, so an id may hold many rows.
    first = own_name(docs.columns, "digest")
    row = F.struct(F.sha2("text", 256).alias(first), *docs.columns)
    repeated = kept.join(again, kept["doc_id"] == again["again"], "left_semi")
    one = repeated.groupBy("doc_id").agg(F.min(row).alias("row"))
    return kept.join(again, kept["doc_id"] == again["again"], "left_anti").unionByName(
        one.select(*(c("row")[x].alias(x) for x in docs.columns))
    )


def _several(exact: DataFrame) -> DataFrame | None:
    """The ids that have more than one text, or None where there are none."""
    found = exact.groupBy("doc_id").agg(
        *(f(k).alias(f"{n}_{k}") for k in "xy" for n, f in (("low", F.min), ("high", F.max)))
    )
    found = found.where("low_x != high_x or low_y != high_y").select(c("doc_id").alias("several"))
    return None if found.isEmpty() else found


def _apart(dealt: DataFrame, several: DataFrame) -> DataFrame:
    """Each text of an id with several has a doc_id of its own; `own` is the id that it had."""
    node = F.xxhash64("doc_id", "text", F.xxhash64(F.lit(7), "text"))
    joined = dealt.join(several, c("doc_id") == c("several"), "left")
    return joined.select(
        F.when(c("several").isNotNull(), node).otherwise(c("doc_id")).alias("doc_id"),
        "text",
        "block",
        c("several").alias("own"),
    )


def _by_id(rows: DataFrame, links: DataFrame, own: DataFrame) -> DataFrame:
    """Components where texts of one id meet, named by the smallest id."""
    rows = rows.select("doc_id", "n", "rep").join(own, c("doc_id") == c("node_"), "left")
    meet = rows.where("own is not null").select("own", c("rep").alias("a")).distinct()
    meet = cut(meet)
    first = cut(meet.groupBy("own").agg(F.min("a").alias("b")))
    found = cut(components(links.unionByName(meet.join(first, "own").select("a", "b"))))
    rows = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.coalesce("own", "doc_id").alias("doc_id"),
        c("n").alias("n_shingles"),
        F.coalesce("component", "rep").alias("whole"),
    )
    rows = cut(rows)
    least = cut(rows.groupBy("whole").agg(F.min("doc_id").alias("component_id")))
    return rows.join(least, "whole", "left").select("doc_id", "n_shingles", "component_id")


def _links(some: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect every component; not each pair of a component."""
    # Stars around the most central document of each min-hash.
    thin = some.select("doc_id", "n", "ell", "rare", "key")
    tokens = some.select(c("doc_id").alias("id"), "tokens")
    centre = thin.groupBy("key").agg(
        F.min(F.struct("rare", "doc_id", "n")).alias("z"), F.count(F.lit(1)).alias("k")
    )
    centre = (
        centre.where("k > 1")
        .select("key", c("z.doc_id").alias("z_id"), c("z.n").alias("z_n"))
        .join(tokens.withColumnsRenamed({"id": "z_id", "tokens": "z_tokens"}), "z_id")
    )
    stars = (
        some.select("doc_id", "n", "key", "tokens")
        .join(centre, "key")
        .where(c("doc_id") != c("z_id"))
        .withColumn("both", F.size(F.array_intersect("tokens", "z_tokens")))
        .where(100 * c("both") >= percent * (c("n") + c("z_n") - c("both")))
        .select(c("doc_id").alias("a"), c("z_id").alias("b"))
    )
    stars = cut(components(stars).select(c("node").alias("a"), c("component").alias("b")))

    # Groups: each label, and the rest by min-hash, in pieces of about GROUP shingles.
    labelled = (
        thin.join(stars.withColumnRenamed("a", "doc_id"), "doc_id", "left")
        .withColumn("linked", c("b").isNotNull())
        .withColumn("family", F.when(c("linked"), F.xxhash64("b")).otherwise(c("key")))
        .withColumn("label", F.coalesce("b", "doc_id"))
    )
    sizes = labelled.groupBy("family").agg(F.sum("n").alias("k"))
    piece = F.pmod(F.xxhash64("doc_id"), F.ceil(c("k") / F.lit(GROUP)))
    members = cut(
        labelled.join(sizes, "family")
        .withColumn("group", F.xxhash64("linked", "family", piece))
        .select("doc_id", "n", "ell", "label", "linked", "group")
    )

    # The matrix, and what opens.
    probe = (
        some.select(c("doc_id").alias("id"), "prefix")
        .join(members, c("id") == c("doc_id"))
        .select(
            "doc_id", "n", "ell", "label", "linked", "group", F.explode("prefix").alias("token")
        )
    )
    matrix = probe.groupBy("token", c("group").alias("g")).agg(
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.min("ell").alias("g_ell"),
        F.first("linked").alias("g_linked"),
        F.min("label").alias("g_label"),
        F.count(F.lit(1)).alias("holders"),
    )
    # Each pair of documents is looked at from one side: the unlinked, or the higher one.
    side = (
        F.when(c("linked") & c("g_linked"), c("label") > c("g_label"))
        .when(c("g_linked"), F.lit(True))
        .when(c("linked"), F.lit(False))
        .when(c("group") == c("g"), c("holders") > 1)
        .otherwise(c("group") > c("g"))
    )
    opened = cut(
        probe.join(matrix, "token")
        .where(side)
        .where((100 * c("high") >= percent * c("n")) & (100 * c("n") >= percent * c("low")))
        .groupBy("doc_id", c("g").alias("group"))
        .agg(
            F.count(F.lit(1)).alias("hits"),
            F.min(F.least("ell", "g_ell")).alias("need"),
            F.min("n").alias("size"),
        )
        .where("hits >= need")
        .select("doc_id", "group", "size")
    )
    asked = opened.groupBy("group").agg(F.ceil(F.sum("size") / F.lit(QUERIES)).alias("deals"))
    asking = (
        opened.join(asked, "group")
        .withColumn("deal", F.pmod(F.xxhash64("doc_id"), c("deals")))
        .join(some.select("doc_id", "n", "tokens"), "doc_id")
        .select("group", "deal", "doc_id", "n", "tokens")
    )
    there = (
        members.join(asked, "group")
        .join(tokens, c("id") == c("doc_id"))
        .withColumn("deal", F.explode(F.sequence(F.lit(0), c("deals") - 1)))
        .select(*[c(x).alias(f"m_{x}") for x in ("group", "deal", "doc_id", "n", "label", "tokens")])
    )
    more = (
        asking.groupBy("group", "deal")
        .cogroup(there.groupBy("m_group", "m_deal"))
        .applyInArrow(on_tables(_verify, percent=percent), "a long, b long")
    )
    return stars.unionByName(more)
