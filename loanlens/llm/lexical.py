"""Ranked lexical search of many items at once, sharing what the items have in common.

1. Postings. One pass over the documents keeps, for each, its number of terms and how often each term
   of any item occurs; no text goes on. The number of documents, of all their terms, and of documents
   that hold a term are sums over these rows.
2. Sharing. Terms that occur in the same items, equally often, are one set (told by their count and
   two hashes of their items, so no list is gathered). An item is a sequence of sets, the most shared
   first; items that begin with the same sets share a node for it. Nodes, sets and terms form a
   graph in which each shared partial sum stands once, whatever number of items use it.
3. Scores. Documents and items are dealt into blocks, and each block of documents meets each block of
   items in one task: the sums of sets are taken once for each document, then added up along the
   graph from shared nodes to items. A task gives the `top` best documents of each item, and the best
   of these are taken per item, with a limit before the shuffle.

Scores are whole numbers, as the query's contract states them: a term weighs
floor(1000 * ln((2 * N + 2) / (2 * df + 1))), the only step in doubles.

Bounds: a block of items has about `PART` uses of sets (and one item at least), a block of documents
`GROUP` bytes of postings or four times its items' bytes. The items' terms go to tasks as 64-bit
hashes, to leave out other terms at once, while there are at most `VOCABULARY` of them; beyond that
all terms of a document become postings. Terms are told apart by 64-bit hashes.

Cases: null has no terms; documents without terms are in no count. Items without terms, or of whose
terms no document has one, have no rows. Items that are equal in id and text are one item; items
that share an id only are ranked apart, under it. Repeated documents are documents of their own.
Equal scores are ranked by id, null first; ids are cast to bigint. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm import words as w
from loanlens.llm.blocks import on_tables
from loanlens.llm.storage import cut

c = F.col

SEED = 61
PART = 16_384
GROUP = 8 << 20
VOCABULARY = 1 << 20
#: Bytes of partial sums that a task holds.
SUMS = 64 << 20

_I = np.int64


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) of each distinct term of each text, and terms with repeats."""
    words = w.Words(texts, w.LETTERS, lower=True)
    term = words.hashes(SEED).view(_I)
    number = words.counts()
    text = np.repeat(np.arange(len(number)), number)
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    new = np.ones(len(term), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return text[at], term[at], np.diff(np.append(at, len(term))), number


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, k) from (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                text, term, k, _ = counted(part.column("text"))
                item = part.column("item").to_numpy()[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item), pa.array(term), pa.array(k)], names=["item", "term", "k"]
                )

    return items.mapInArrow(run, "item long, term long, k long")


def postings(docs: DataFrame, known: np.ndarray | None) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document: its number of terms, and packed the terms that are
    known (all, if None) with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                text, term, tf, number = counted(part.column("text"))
                if known is not None:
                    at = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
                    kept = known[at] == term if len(known) else np.zeros(len(term), bool)
                    text, term, tf = text[kept], term[kept], tf[kept]
                cuts = np.searchsorted(text, np.arange(len(number) + 1))
                rows = list(zip(cuts, cuts[1:], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(number.astype(_I)),
                        pa.array([w.pack(term[a:b]) for a, b in rows], pa.binary()),
                        pa.array([w.pack(tf[a:b].astype(np.uint32)) for a, b in rows], pa.binary()),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def _whole(column: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    return w.unpack(b"".join(column.to_pylist()), kind)


def document_counts(found: DataFrame) -> DataFrame:
    """(term, df) from postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, n = np.unique(_whole(batch.column("terms"), _I), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=["term", "n"])

    rows = found.select("terms").mapInArrow(run, "term long, n long")
    return rows.groupBy("term").agg(F.sum("n").alias("df"))


def shared_sets(terms: DataFrame) -> DataFrame:
    """(term, set) where terms of one set occur in the same items, equally often."""
    one, two = F.xxhash64("item", "k"), F.xxhash64("k", F.lit("second"), "item")
    named = F.xxhash64(F.count(F.lit(1)), F.bit_xor(one), F.bit_xor(two))
    return terms.groupBy("term").agg(named.alias("set"))


def sharing_graph(uses: DataFrame) -> DataFrame:
    """(part, item, node, parent, set, k, depth) of each item's path, from (part, item, set, k).

    An item's sets are ordered by the number of items that use them, so that items meet in long
    common beginnings. A node is known by the sets up to it.
    """
    often = uses.groupBy("part", "set", "k").agg(F.count(F.lit(1)).alias("items"))
    path = Window.partitionBy("part", "item").orderBy(F.desc("items"), "set", "k")
    until = path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    node = F.bit_xor(F.xxhash64("set", "k"))
    return (
        uses.join(often, ["part", "set", "k"])
        .withColumn("node", node.over(until))
        .withColumn("depth", F.row_number().over(path))
        .withColumn("parent", F.lag("node").over(path))
    )


PACKED = {
    "terms": _I,  # ascending
    "set_of": np.int32,  # of each term
    "weights": _I,
    "sets": np.int32,  # one: how many
    "node_set": np.int32,  # nodes in depth-first order
    "node_k": _I,
    "node_depth": np.int32,
    "items": _I,
    "item_node": np.int32,
}


def _pack(group: pa.Table) -> pa.Table:
    """The graph of one part as arrays, in one row."""
    kind = group["kind"].to_numpy()
    a, b, x, k, depth = (group[name].to_numpy() for name in ("a", "b", "x", "k", "depth"))
    term, node, item = (np.flatnonzero(kind == n) for n in range(3))
    term = term[np.argsort(a[term])]
    sets, set_of = np.unique(b[term], return_inverse=True)
    order = _depth_first(a[node], b[node], depth[node])
    node = node[order]
    names = np.argsort(a[node])
    packed = {
        "terms": a[term],
        "set_of": set_of,
        "weights": x[term],
        "sets": np.array([len(sets)]),
        "node_set": np.searchsorted(sets, x[node]),
        "node_k": k[node],
        "node_depth": depth[node],
        "items": a[item],
        "item_node": names[np.searchsorted(a[node], b[item], sorter=names)],
    }
    row = {n: pa.array([w.pack(packed[n].astype(t))]) for n, t in PACKED.items()}
    return pa.table({"part": group["part"].combine_chunks()[:1], **row})


def _depth_first(node: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> list[int]:
    below: dict[int, list[int]] = {}
    for i in np.argsort(node):
        below.setdefault(int(parent[i]) if depth[i] > 1 else None, []).append(int(i))
    out, stack = [], below.get(None, [])[::-1]
    while stack:
        i = stack.pop()
        out.append(i)
        stack.extend(below.get(int(node[i]), ())[::-1])
    return out


def _score(docs: pa.Table, graph: pa.Table, n_docs: int, n_terms: int, top: int) -> pa.Table:
    """The best documents of a block for each item of a part: (item, doc_id, score)."""
    out = {"item": [], "doc_id": [], "score": []}
    if docs.num_rows and graph.num_rows:
        g = {n: w.unpack(graph[n][0].as_py(), t) for n, t in PACKED.items()}
        docs = docs.sort_by("doc_id") if docs["doc_id"].null_count == 0 else _null_first(docs)
        best = [(np.empty(0, _I), np.empty(0, _I)) for _ in g["items"]]
        held = int(g["sets"][0]) + int(g["node_depth"].max(initial=0)) + 1
        step = int(np.clip(SUMS // (8 * held), 64, 4096))
        for at in range(0, docs.num_rows, step):
            _add(docs.slice(at, step), at, g, n_docs, n_terms, top, best)
        ids = docs["doc_id"].combine_chunks()
        for item, (score, row) in zip(g["items"], best, strict=True):
            out["item"].append(np.full(len(row), item, dtype=_I))
            out["doc_id"].append(row)
            out["score"].append(score)
        out = {n: np.concatenate(x) if x else np.empty(0, _I) for n, x in out.items()}
        out["doc_id"] = ids.take(pa.array(out["doc_id"]))
    return pa.table({n: pa.array(x, pa.int64()) for n, x in out.items()})


def _null_first(docs: pa.Table) -> pa.Table:
    import pyarrow.compute as pc

    return docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))


def _add(
    docs: pa.Table, offset: int, g: dict, n_docs: int, n_terms: int, top: int, best: list
) -> None:
    """Scores some documents, in ascending id order, and keeps each item's best so far."""
    rows = docs.num_rows
    term, tf = _whole(docs["terms"], _I), _whole(docs["tfs"], np.uint32).astype(_I)
    sizes = np.array([len(x) // 8 for x in docs["terms"].to_pylist()])
    doc = np.repeat(np.arange(rows), sizes)
    at = np.minimum(np.searchsorted(g["terms"], term), len(g["terms"]) - 1)
    asked = g["terms"][at] == term
    at, tf, doc = at[asked], tf[asked], doc[asked]
    # n * N stays below 2**63 for texts of 10**8 terms among 10**9 documents.
    m = 25 + (75 * docs["n"].to_numpy() * n_docs) // n_terms
    value = g["weights"][at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    sums = np.zeros((int(g["sets"][0]), rows), dtype=_I)
    np.add.at(sums, (g["set_of"][at], doc), value)
    along = np.zeros((int(g["node_depth"].max()) + 1, rows), dtype=_I)
    ends: dict[int, list[int]] = {}
    for item, node in enumerate(g["item_node"].tolist()):
        ends.setdefault(node, []).append(item)
    nodes = zip(g["node_set"].tolist(), g["node_k"].tolist(), g["node_depth"].tolist(), strict=True)
    for node, (own, k, depth) in enumerate(nodes):
        here = along[depth]
        np.multiply(sums[own], k, out=here)
        here += along[depth - 1]
        for item in ends.get(node, ()):
            score, row = best[item]
            floor = score[-1] if len(score) == top else 0
            better = np.flatnonzero(here > floor)
            if len(better):
                score = np.concatenate([score, here[better]])
                row = np.concatenate([row, better + offset])
                keep = np.argsort(-score, kind="stable")[:top]
                best[item] = score[keep], row[keep]


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item, from rank 1."""
    asked = items.select(c(item_key).alias("item_id"), c(item_text).cast("string").alias("text"))
    asked = cut(asked.distinct().withColumn("item", F.monotonically_increasing_id()))
    terms = cut(item_terms(asked.select("item", "text")))
    distinct = terms.select("term").distinct()
    known = None
    if distinct.count() <= VOCABULARY:
        known = np.sort(np.array([r.term for r in distinct.collect()], dtype=_I))
    rows = docs.select(c(key).cast("long").alias("doc_id"), c(text).cast("string").alias("text"))
    found = cut(postings(rows, known))
    # Documents without terms have no place in the counts.
    total = found.agg(
        F.count(F.when(c("n") > 0, 1)).alias("docs"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("terms"),
        F.coalesce(F.sum(F.octet_length("terms")), F.lit(0)).alias("bytes"),
    ).first()
    n_docs = total["docs"]
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * c("df") + 1))).cast("long")
    weighed = terms.join(document_counts(found), "term").withColumn("x", weight).where("x > 0")
    weighed = cut(weighed.join(shared_sets(terms), "term"))
    uses = weighed.select("item", "set", "k").distinct()
    n_uses = uses.count()
    parts = max(1, math.ceil(n_uses / PART))
    part = F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int").alias("part")
    paths = cut(sharing_graph(uses.select(part, "*")))
    none = F.lit(0).cast("long")

    def as_rows(frame: DataFrame, kind: int, a: str, b, x, k, depth) -> DataFrame:
        named = {"b": b, "x": x, "k": k, "depth": depth}
        columns = [v.cast("long").alias(n) for n, v in named.items()]
        return frame.select("part", F.lit(kind).alias("kind"), c(a).alias("a"), *columns).distinct()

    last = Window.partitionBy("part", "item").orderBy(F.desc("depth"))
    ends = paths.withColumn("last", F.row_number().over(last)).where("last = 1")
    parent = F.coalesce("parent", none)
    graph = as_rows(weighed.select(part, "*"), 0, "term", c("set"), c("x"), none, none)
    graph = graph.unionByName(as_rows(paths, 1, "node", parent, c("set"), c("k"), c("depth")))
    graph = graph.unionByName(as_rows(ends, 2, "item", c("node"), none, none, none))
    kinds = "part int, " + ", ".join(f"{n} binary" for n in PACKED)
    graph = cut(graph.groupBy("part").applyInArrow(_pack, kinds))
    size = graph.agg(F.max(sum(F.octet_length(n) for n in PACKED))).first()[0] or 0
    blocks = max(1, math.ceil(total["bytes"] / max(GROUP, 4 * size)))
    dealt = found.where("octet_length(terms) > 0").select(
        "*", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).alias("block")
    )
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    copies = F.explode(F.sequence(none, F.lit(blocks - 1).cast("long"))).alias("block")
    score = on_tables(_score, n_docs=n_docs, n_terms=total["terms"], top=top)
    met = dealt.groupBy("block", "part").cogroup(
        graph.select("*", copies).groupBy("block", "part")
    )
    scored = met.applyInArrow(score, "item long, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(c("rank") <= top)
    return ranked.join(asked.select("item", "item_id"), "item").select(
        "item_id", c("rank").cast("int").alias("rank"), "doc_id", "score"
    )
