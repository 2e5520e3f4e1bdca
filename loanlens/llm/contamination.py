"""Benchmark decontamination by a positional inverted index that is distributed by documents.

Every slice of documents is a shard: it stores, for each term of the benchmark, the sorted list of
the positions where the slice holds it. A benchmark window is looked up from its rarest term in the
shard: that list, moved by the term's offset, gives the possible starts, which are intersected with
the moved lists of the next rarest terms until one of them is empty or all agree. What is left are
exact phrases. With `slop`, the same lists give proximity matches: a run of `window + slop` words of
one text that holds every term of a window as often as the window does, in any order.

Postings are those of the benchmark's terms in one slice of about 2 MB of text. They are made for
the search and not kept, and the rarest term is the rarest of the slice; matches do not depend on
how the texts are sliced.

The corpus is not shuffled: only matches leave a shard. The benchmark travels to the shards in
parts of about `PART` bytes of text (a bound, not a limit), as arrays of term numbers. One part's
matches are put beside the rows; with more parts, each makes a pass of its own over the texts, from
which only matched texts come, and these are joined back by digest. Distinct (item, text) rows are
dealt by a hash of both, so an id that many rows share is spread over the parts.

Cases: null or empty text has no words; an item of fewer words than a window, but not none, is one
window; an item without words matches nothing. Items with equal ids count once. An item without an
id has hits, but is in no list of items. A table without items gives every document no hits. Rows with equal or null document ids stay rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm import words as w
from loanlens.llm.rows import add_column, own_name
from loanlens.llm.storage import cut

c = F.col

PART = 4 << 20
SEED = 31

#: Words as SQL has them; their letters' case makes no difference.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

INTERVALS = "array<struct<start:bigint,end:bigint>>"
_HIT = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
STATE = (
    "struct<n_words:bigint,n_hit:bigint,hits:array<struct<start:bigint,end:bigint>>,"
    "items:array<string>,near_items:array<string>>"
)
_STATE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("hits", _HIT),
        ("items", pa.list_(pa.string())),
        ("near_items", pa.list_(pa.string())),
    ]
)


class Phrases:
    """The windows of some benchmark items, as offsets of their terms."""

    def __init__(
        self, ids: list[str | None], texts: list[str | None], window: int
    ) -> None:
        words = w.Words(pa.array(texts, pa.large_string()), w.LETTERS, lower=True)
        hashes = words.hashes(SEED)
        self.terms, term = np.unique(hashes, return_inverse=True)
        count = words.counts()
        size = np.minimum(count, window)
        number = np.where(count > 0, count - size + 1, 0)
        item = np.repeat(np.arange(len(ids)), number)
        before = np.repeat(np.cumsum(number) - number, number)
        start = words.first[:-1][item] + np.arange(len(item)) - before
        rows = np.full((len(item), window), -1, dtype=np.int32)
        for at in range(window):
            some = at < size[item]
            rows[some, at] = term[start[some] + at]
        self.phrases, phrase = np.unique(rows, axis=0, return_inverse=True)
        self.sizes = (self.phrases >= 0).sum(axis=1)
        # Which items have a phrase: pairs by phrase, and where those of each begin.
        self.names = sorted({x for x in ids if x is not None})
        name = {x: k for k, x in enumerate(self.names)}
        of_item = np.array([-1 if x is None else name[x] for x in ids], dtype=np.int64)
        pairs = np.stack([phrase.ravel(), of_item[item]], axis=1)
        pairs = np.unique(pairs[pairs[:, 1] >= 0], axis=0)
        self.item = pairs[:, 1].astype(np.int32)
        self.first_item = np.searchsorted(pairs[:, 0], np.arange(len(self.phrases) + 1))
        # How often a phrase has each of its terms.
        self.times = np.zeros(self.phrases.shape, dtype=np.int16)
        for at in range(window):
            self.times += self.phrases == self.phrases[:, at : at + 1]
        # A small table of hash prefixes that turns most other words away.
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[self.terms >> np.uint64(44)] = True

    def items(self, phrase: int) -> list[str]:
        """The ids of the items that have a phrase."""
        first, last = self.first_item[phrase : phrase + 2]
        return [self.names[k] for k in self.item[first:last]]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The term number of each word, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        if not len(self.terms):
            return out
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
        at = np.searchsorted(self.terms, hashes[maybe])
        at[at == len(self.terms)] = 0
        same = self.terms[at] == hashes[maybe]
        out[maybe[same]] = at[same]
        return out


class Shard:
    """Postings of the benchmark's terms in a slice of documents."""

    def __init__(self, words: w.Words, phrases: Phrases) -> None:
        self.words, self.phrases = words, phrases
        term = phrases.of(words.hashes(SEED))
        self.positions = np.flatnonzero(term >= 0)
        terms = term[self.positions]
        order = np.argsort(terms, kind="stable")
        self.positions = self.positions[order]
        self.first = np.searchsorted(terms[order], np.arange(len(phrases.terms) + 1))
        # Postings as one sorted key, so that a moved list is probed by binary search.
        self.span = len(words) + 1
        self.keys = terms[order] * self.span + self.positions
        self.text = np.repeat(np.arange(len(words.first) - 1), words.counts())

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the term's list holds the position."""
        key = term * self.span + position
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return (self.keys[at] == key) & (position >= 0) & (position < self.span - 1)

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase: its offsets from the rarest term on, and its rarest list's length."""
        frequency = np.append(np.diff(self.first), np.iinfo(np.int64).max)  # -1: no term
        frequency = frequency[self.phrases.phrases]
        order = np.argsort(frequency, axis=1, kind="stable")
        least = np.take_along_axis(frequency, order[:, :1], axis=1)[:, 0]
        return order, least

    def exact(self) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every occurrence inside one text."""
        if not len(self.keys) or not len(self.phrases.sizes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        order, least = self.ranked()
        live = np.flatnonzero(least)
        offset = order[live, 0]
        term = self.phrases.phrases[live, offset]
        times = self.first[term + 1] - self.first[term]
        phrase = np.repeat(live, times)
        at = np.repeat(self.first[term] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
        start = self.positions[at + np.arange(len(at))] - np.repeat(offset, times)
        ok = (start >= 0) & (start + self.phrases.sizes[phrase] < self.span)
        phrase, start = phrase[ok], start[ok]
        ok = self.text[start] == self.text[start + self.phrases.sizes[phrase] - 1]
        phrase, start = phrase[ok], start[ok]
        for rank in range(1, order.shape[1]):
            if not len(phrase):
                break
            offset = order[phrase, rank]
            term = self.phrases.phrases[phrase, offset]
            ok = (term < 0) | self.has(term, start + offset)
            phrase, start = phrase[ok], start[ok]
        return phrase, start

    def near(self, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of runs of words that hold all terms of the phrase."""
        if not len(self.keys) or not len(self.phrases.sizes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        order, least = self.ranked()
        live = np.flatnonzero(least)
        term = self.phrases.phrases[live, order[live, 0]]
        times = self.first[term + 1] - self.first[term]
        phrase = np.repeat(live, times)
        at = np.repeat(self.first[term] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
        position = self.positions[at + np.arange(len(at))]
        # First all terms within reach of the rarest one, on both sides; then each run that holds it.
        reach = self.phrases.sizes[phrase] + slop - 1
        ok = self.hold(order, phrase, position, position - reach, position + reach)
        phrase, position, reach = phrase[ok], position[ok], reach[ok]
        found, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for back in range(int(reach.max(initial=-1)) + 1):
            start = position - back
            some = np.flatnonzero(back <= reach)
            some = some[
                self.hold(order, phrase[some], position[some], start[some], (start + reach)[some])
            ]
            # A run that begins before the text holds what it holds from its first word on.
            begin = np.maximum(self.words.first[self.text[position[some]]], start[some])
            found.append(phrase[some])
            starts.append(begin)
            left = np.ones(len(phrase), dtype=bool)  # one run for each position is enough
            left[some] = False
            phrase, position, reach = phrase[left], position[left], reach[left]
        return np.concatenate(found), np.concatenate(starts)

    def hold(
        self,
        order: np.ndarray,
        phrase: np.ndarray,
        position: np.ndarray,
        low: np.ndarray,
        high: np.ndarray,
    ) -> np.ndarray:
        """Numbers of the rows whose words low to high, cut at the ends of the text of `position`,
        hold every term of the phrase as often as the phrase does."""
        text = self.text[position]
        low = np.maximum(self.words.first[text], low)
        high = np.minimum(self.words.first[text + 1] - 1, high)
        row = np.arange(len(phrase))
        for rank in range(order.shape[1]):
            if not len(row):
                break
            offset = order[phrase[row], rank]
            term = self.phrases.phrases[phrase[row], offset]
            count = np.searchsorted(self.keys, term * self.span + high[row], side="right")
            count -= np.searchsorted(self.keys, term * self.span + low[row], side="left")
            row = row[(term < 0) | (count >= self.phrases.times[phrase[row], offset])]
        return row


def _spans(covered: np.ndarray, words: w.Words, n: int) -> pa.Array:
    """Runs of covered words inside each text."""
    text_of = np.repeat(np.arange(n), words.counts())
    begins, ends = covered.copy(), covered.copy()
    begins[1:] &= ~(covered[:-1] & (text_of[1:] == text_of[:-1]))
    ends[:-1] &= ~(covered[1:] & (text_of[1:] == text_of[:-1]))
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = text_of[start]
    base = words.first[:-1][owner]
    lists = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays(
        [pa.array(start - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"]
    )
    return pa.ListArray.from_arrays(pa.array(lists), pairs)


def _items(phrase: np.ndarray, text: np.ndarray, phrases: Phrases, n: int) -> list[list[str]]:
    found: list[set[str]] = [set() for _ in range(n)]
    pairs = np.unique(np.stack([text, phrase], axis=1), axis=0) if len(phrase) else ()
    for k, p in pairs:
        found[k].update(phrases.items(p))
    return [sorted(x) for x in found]


def _covered(words: w.Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def _look_up(texts: pa.Array, phrases: Phrases, slop: int | None) -> pa.StructArray:
    """The state of some texts."""
    n = len(texts)
    words = w.Words(texts, w.LETTERS, lower=True)
    shard = Shard(words, phrases)
    phrase, start = shard.exact()
    covered = _covered(words, start, start + phrases.sizes[phrase])
    total = np.concatenate([[0], np.cumsum(covered)])
    near = [[] for _ in range(n)]
    if slop is not None:
        close, position = shard.near(slop)
        near = _items(close, shard.text[position], phrases, n)
    columns = [
        pa.array(words.counts()),
        pa.array(total[words.first[1:]] - total[words.first[:-1]]),
        _spans(covered, words, n),
        pa.array(_items(phrase, shard.text[start], phrases, n), pa.list_(pa.string())),
        pa.array(near, pa.list_(pa.string())),
    ]
    return pa.StructArray.from_arrays(
        [x.cast(f.type) for x, f in zip(columns, _STATE, strict=True)], fields=list(_STATE)
    )


def search_rows(
    docs: DataFrame,
    items: DataFrame,
    name: str,
    window: int = 13,
    slop: int | None = None,
    item_key: str = "item_id",
    text: str = "text",
    item_text: str = "text",
) -> DataFrame:
    """The rows with a struct column `name`: n_words, n_hit (words inside an occurrence), hits
    (their intervals), items (ids of items with an occurrence, sorted as text) and near_items (the
    same for proximity matches; empty without `slop`)."""
    items = items.select(
        c(item_key).cast("string").alias("item"), c(item_text).cast("string").alias("text")
    )
    items = items.distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = 1 + size // PART
    number = F.pmod(F.xxhash64("item", "text"), F.lit(n_parts))
    parts = []
    for part in range(n_parts):
        rows = items.where(number == part).collect()  # about PART bytes of text
        parts.append(Phrases([r["item"] for r in rows], [r["text"] for r in rows], window))
    if n_parts == 1:
        return add_column(docs, name, STATE, text, _starter(parts[0], text, slop))
    return _of_parts(docs, name, text, parts, slop)


def _of_parts(
    docs: DataFrame, name: str, text: str, parts: list[Phrases], slop: int | None
) -> DataFrame:
    """The state after several parts of the benchmark. Each part goes over the texts by itself, in
    tasks of its own, and only texts that it matches come out, known by their digest; they are put
    together and joined back."""
    content = F.coalesce(c(text).cast("string"), F.lit(""))
    texts = docs.select(F.sha2(content, 256).alias("digest"), content.alias("text"))
    found = [
        add_column(texts, "state", STATE, "text", _starter(phrases, "text", slop))
        .where("size(state.items) + size(state.near_items) + size(state.hits) > 0")
        .select("digest", F.lit(k).alias("part"), "state.hits", "state.items", "state.near_items")
        for k, phrases in enumerate(parts)
    ]
    once = reduce(DataFrame.unionByName, found).dropDuplicates(["digest", "part"])
    lists = [F.flatten(F.collect_list(x)).alias(x) for x in ("hits", "items", "near_items")]
    digest = own_name(docs.columns, "digest")
    whole = once.groupBy(c("digest").alias(digest)).agg(*lists)
    state = own_name([*docs.columns, digest], name)
    merged = F.struct(
        _merged(c("hits")).alias("hits"),
        F.array_sort(F.array_distinct("items")).alias("items"),
        F.array_sort(F.array_distinct("near_items")).alias("near_items"),
    )
    whole = cut(whole.select(digest, merged.alias("_found")))
    joined = docs.withColumn(digest, F.sha2(content, 256)).join(
        whole.withColumnRenamed("_found", state), digest, "left"
    )
    words = F.regexp_count(content, F.lit(WORDS)).cast("bigint")
    hits = c(state)["hits"]
    n_hit = F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    nothing = F.expr("cast(array() as array<string>)")
    value = F.struct(
        words.alias("n_words"),
        F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(hits, F.expr(f"cast(array() as {INTERVALS})")).alias("hits"),
        F.coalesce(c(state)["items"], nothing).alias("items"),
        F.coalesce(c(state)["near_items"], nothing).alias("near_items"),
    )
    return joined.select(*docs.columns, value.alias(name))


def _merged(hits: Column) -> Column:
    """Intervals in order, those that touch put together."""

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")
        )
        touches = (F.size(out) > 0) & (x["start"] <= last["end"])
        return F.when(
            touches, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))
        ).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(hits), F.expr(f"cast(array() as {INTERVALS})"), step)


def _starter(
    phrases: Phrases, text: str, slop: int | None
) -> Callable[[], Callable[[pa.RecordBatch], pa.Array]]:
    def start() -> Callable[[pa.RecordBatch], pa.Array]:
        return lambda part: _look_up(part.column(text), phrases, slop)

    return start


def search(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    slop: int | None = None,
    key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: its key, text and the fields of `search_rows`."""
    own = docs.select(c(key).alias("doc_id"), c(text).cast("string").alias("text"))
    found = search_rows(own, items, "found", window, slop, item_key, item_text=text)
    return found.select("doc_id", "text", "found.*")


def contaminated(percent: int = 5, prefix: str = "") -> Column:
    """Whether at least `percent` of a document's words, and one word, are hit."""
    hit, words = c(f"{prefix}n_hit"), c(f"{prefix}n_words")
    return (hit > 0) & (100 * hit >= percent * words)
