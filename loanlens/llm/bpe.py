"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

Texts are cut into pieces, and each distinct piece is encoded once for each cache. New pieces are cut
into words by the kinds of neighbouring characters, all of a slice at once, and the symbols of these
words lie in one flat array. A round finds the lowest rank of each word and merges all places of
that pair in the word from left to right; then only the pairs beside a merged place are ranked
again, by a hash table of the pairs. Words without a pair leave; a word of more than `LONG` bytes
takes rounds of its own, which touch only the places of their pair. A merged symbol is made by one
pair only, so its later pairs rank higher and the order of merges is that of the plain algorithm.

The vocabulary file (tokenizers' JSON form, byte-level BPE) is a parameter; each task reads what
the driver has read. Special tokens inside a text become their id, as the library has it by default.

Cases: null is the empty text, which has no tokens. Any text decodes to itself; ids that make no
valid UTF-8 decode with U+FFFD as the library does. Rows with equal or null ids stay rows of their
own. A file with other rules (a normalizer, a prefix space, another pre-tokenizer) is refused.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from collections import defaultdict
from collections.abc import Callable
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm import words as w
from loanlens.llm.pieces import cut
from loanlens.llm.rows import add_column

c = F.col

#: Unicode's white space, and the kinds of characters that make byte-level BPE words:
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
KINDS = {1: rf"[{SPACE}]+", 2: r"\p{L}+", 3: r"\p{N}+"}
#: Letters after an apostrophe that are a word with it.
SHORT_FORMS = ("s", "t", "m", "d", "re", "ve", "ll")

#: Bytes of a word above which it is merged on its own.
LONG = 1024
#: Bytes of a word above which it is merged once for all its occurrences in a call.
ONCE = 32

TOKENS = "struct<n_tokens:bigint,ids:array<int>,decoded:string>"


def byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file: visible Latin-1
    characters stand for themselves, the rest for 256 and on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


def other_rules(data: dict) -> list[str]:
    """Parts of a vocabulary file by which texts are cut or merged in another way than here."""
    before, model = data.get("pre_tokenizer") or {}, data.get("model") or {}
    plain = {
        "normalizer": data.get("normalizer") is None,
        "pre_tokenizer": before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space", True)
        and before.get("use_regex", True),
        "decoder": (data.get("decoder") or {}).get("type") == "ByteLevel",
        "model": model.get("type", "BPE") == "BPE"
        and not any(
            model.get(x)
            for x in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix",
                      "end_of_word_suffix")
        ),
        "added_tokens": not any(
            token.get(x)
            for token in data.get("added_tokens", ())
            for x in ("single_word", "lstrip", "rstrip")
        ),
    }
    return [name for name, ok in plain.items() if not ok]


def character_kinds() -> np.ndarray:
    """The kind of each code point; 0 is what is no white space, letter or number."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    kinds = np.zeros(len(every), dtype=np.uint8)
    for kind, pattern in KINDS.items():
        for found in regex.finditer(pattern, every):
            kinds[found.start() : found.end()] = kind
    return kinds


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of some spans, one after the other."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)


class Vocabulary:
    """Tables of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        if odd := other_rules(data):
            raise ValueError(f"{path} is no plain byte-level BPE: {', '.join(odd)}")
        letters = byte_letters()
        ids = data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        content = [b""] * size
        for token, number in ids.items():
            content[number] = bytes(letters[x] for x in token)
        for token, number in self.special.items():
            content[number] = token.encode()
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for letter, byte in letters.items():
            self.byte_ids[byte] = ids[letter]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in data["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        self.size = size
        self.table_pairs(left * size + right)
        self.kinds = character_kinds()
        # Contents of all tokens in a row, for decoding.
        self.lengths = np.array([len(x) for x in content], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.content = np.frombuffer(b"".join(content), dtype=np.uint8)

    # --- encoding -------------------------------------------------------------------------------

    def table_pairs(self, keys: np.ndarray) -> None:
        """A hash table of the pairs: a key lies in its slot or in the next free one."""
        bits = max(int(2 * len(keys)).bit_length(), 4)
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, len(keys), dtype=np.int32)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            own = self.keys[slot] == keys[left]
            self.ranks[slot[own]] = left[own]
            left, slot = left[~own], (slot[~own] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Where the search for a key begins."""
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of ranks for what is no pair."""
        key = left.astype(np.int64) * self.size + right
        slot = self.slot(key)
        there = self.keys[slot]
        rank = self.ranks[slot]
        other = np.flatnonzero(there != key)
        rank[other] = len(self.merged)
        other = other[there[other] >= 0]
        slot, key = slot[other], key[other]
        while len(other):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            found = there == key
            rank[other[found]] = self.ranks[slot[found]]
            go_on = ~found & (there >= 0)
            other, slot, key = other[go_on], slot[go_on], key[go_on]
        return rank

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and n + 1 offsets."""
        return self.merge_bytes(b"".join(words), np.array([len(x) for x in words], dtype=np.int64))

    def merge_bytes(self, data: bytes, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and n + 1 offsets. The words lie in `data`, one after another,
        with `counts` bytes each."""
        n, ends = len(counts), np.cumsum(counts)
        # The words that stand for themselves: of equal long ones, the first.
        own, known = np.arange(n), {}
        for k in np.flatnonzero(counts > ONCE).tolist():
            own[k] = known.setdefault(data[ends[k] - counts[k] : ends[k]], k)
        symbols = self.byte_ids[np.frombuffer(data, dtype=np.uint8)]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for word, k in known.items():
            if len(word) > LONG:
                ids = self.merge_long(word)
                done.append((ids, np.array([k]), np.array([len(ids)])))
        once = (own == np.arange(n)) & (counts <= LONG) & (counts > 0)
        if not once.all():
            symbols = symbols[np.repeat(once, counts)]
        which = np.flatnonzero(once)
        if len(which):
            done.extend(self._rounds(symbols, which, counts[which]))
        ids = np.concatenate([x for x, _, _ in done]) if done else symbols[:0]
        at, size = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        if done:
            which = np.concatenate([x for _, x, _ in done])
            sizes = np.concatenate([x for _, _, x in done])
            at[which], size[which] = np.cumsum(sizes) - sizes, sizes
        at, size = at[own], size[own]
        return ids[places(at, size)], np.concatenate([[0], np.cumsum(size)])

    def _rounds(
        self, symbols: np.ndarray, which: np.ndarray, counts: np.ndarray
    ) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merges words, none of them empty. Gives (ids, words, number of ids of each word)."""
        none = len(self.merged)
        end = none + 1  # the rank of a word's last symbol, which begins no pair
        done = []
        starts = np.cumsum(counts) - counts
        rank = np.full(len(symbols), end, dtype=np.int32)
        inner = np.ones(len(symbols), dtype=bool)
        inner[starts + counts - 1] = False
        inner = np.flatnonzero(inner)
        rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while True:
            best = np.minimum.reduceat(rank, starts)
            live = best < none
            if not live.all():
                stay = np.repeat(live, counts)
                done.append((symbols[~stay], which[~live], counts[~live]))
                symbols, rank = symbols[stay], rank[stay]
                which, counts, best = which[live], counts[live], best[live]
                if not len(which):
                    return done
                starts = np.cumsum(counts) - counts
            hit = np.flatnonzero(rank == np.repeat(best, counts))
            # In a run of overlapping places (x x x), every second one merges.
            first = np.ones(len(hit), dtype=bool)
            first[1:] = hit[1:] != hit[:-1] + 1
            if not first.all():
                begin = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            last = rank[hit + 1] == end
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            symbols, rank = symbols[keep], rank[keep]
            counts = np.add.reduceat(keep, starts, dtype=np.int64)
            starts = np.cumsum(counts) - counts
            # Only the pairs of the merged symbols have changed.
            hit = hit - np.arange(len(hit))
            rank[hit[last]] = end
            ahead = hit[hit > 0] - 1
            changed = np.concatenate([hit[~last], ahead[rank[ahead] != end]])
            rank[changed] = self.rank(symbols[changed], symbols[changed + 1])

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word, by rounds that only touch the places of their pair.

        Symbols are chained, and places wait under the rank of the pair that begins there. A round
        takes the lowest rank, merges its places from left to right, and ranks the new neighbours.
        So a word costs its merges, and not rounds times its length.
        """
        symbols = self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        n, none = len(symbols), len(self.merged)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, none, dtype=np.int32)
        rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        alive = np.ones(n, dtype=bool)
        waiting: dict[int, list] = {}
        order = np.argsort(rank, kind="stable")
        starts, ends = w.runs(rank[order])
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            waiting[int(rank[order[s]])] = order[s:e].tolist()
        waiting.pop(none, None)
        queue = sorted(waiting)
        while queue:
            lowest = heapq.heappop(queue)
            hit = np.unique(np.array(waiting.pop(lowest), dtype=np.int64))
            hit = hit[rank[hit] == lowest]
            if not len(hit):
                continue
            if len(hit) > 1:  # in a run of overlapping places, every second one merges
                first = np.ones(len(hit), dtype=bool)
                first[1:] = after[hit[:-1]] != hit[1:]
                begin = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            gone = after[hit]
            symbols[hit] = self.merged[lowest]
            alive[gone], rank[gone] = False, none
            after[hit] = after[gone]
            inner = hit[after[hit] < n]
            before[after[inner]] = inner
            ahead = before[hit]
            changed = np.concatenate([hit, ahead[ahead >= 0]])
            behind = after[changed]
            inside = behind < n
            rank[changed] = none
            changed, behind = changed[inside], behind[inside]
            rank[changed] = self.rank(symbols[changed], symbols[behind])
            for place, value in zip(changed.tolist(), rank[changed].tolist(), strict=True):
                if value < none:
                    if value not in waiting:
                        waiting[value] = []
                        heapq.heappush(queue, value)
                    waiting[value].append(place)
        return symbols[alive]

    def word_starts(self, points: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Flags of the code points at which a word begins. `begin` flags the points at which a
        piece does."""
        kind = self.kinds[points]
        space = kind == 1
        start = begin.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last white space before another character begins a word; a space begins that of the
        # character.
        last = space[:-1] & ~space[1:] & ~begin[1:]
        start[:-1] |= last
        start[1:] &= ~(last & (points[:-1] == 0x20))
        quote = np.flatnonzero(start & (points == 0x27))
        if len(quote):
            behind = np.append(points, [0, 0])
            inside = np.append(~begin, [False, False])
            for form in SHORT_FORMS:
                at = quote
                for k, letter in enumerate(form, 1):
                    at = at[(behind[at + k] == ord(letter)) & inside[at + k]]
                start[at + 1] = False
                at = at + 1 + len(form)
                start[at[at < len(start)]] = True
        return start

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the number of ids of each."""
        text = "".join(pieces)
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(sizes)
        begin = np.zeros(len(points), dtype=bool)
        begin[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(self.word_starts(points, begin))
        bounds = np.append(starts, len(points))
        if not text.isascii():
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            bounds = np.concatenate([[0], np.cumsum(width)])[bounds]
        ids, first = self.merge_bytes(text.encode("utf-8", "replace"), np.diff(bounds))
        first = first[np.searchsorted(starts, np.append(0, ends))]
        return ids, np.diff(first)

    # --- decoding -------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        return self.content[places(self.starts[ids], self.lengths[ids])]


class Encoder:
    """A vocabulary with a cache of what distinct pieces encode to. It is emptied when it holds
    `limit` pieces, which bounds the memory and changes no result."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 1 << 18) -> None:
        self.vocabulary, self.limit = vocabulary, limit
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.empty()

    def empty(self) -> None:
        """The cache as it is at first: special tokens have the first numbers."""
        self.names = {name: k for k, name in enumerate(self.vocabulary.special)}
        self.ids = np.array(list(self.vocabulary.special.values()), dtype=np.int32)
        self.sizes = np.ones(len(self.ids), dtype=np.int64)
        # Pieces in the order of their numbers; the first of a text is a tuple, as it has no space
        # before it. A piece that is looked up for the first time gets the next number.
        self.known: dict = defaultdict(count(len(self.sizes)).__next__)

    def encode_new(self) -> None:
        """Encodes the pieces that have no ids yet, which are the last ones."""
        n = len(self.names) + len(self.known) - len(self.sizes)
        new = [x[0] if isinstance(x, tuple) else " " + x for x in islice(reversed(self.known), n)]
        if new:
            ids, sizes = self.vocabulary.encode_pieces(new[::-1])
            self.ids = np.concatenate([self.ids, ids])
            self.sizes = np.concatenate([self.sizes, sizes])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and n + 1 offsets."""
        if len(self.sizes) > self.limit:
            self.empty()
        numbers: list[int] = []
        ends = [0]
        for text in texts:
            parts, names = [text], []
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                names = self.special.findall(text)
            for k, part in enumerate(parts):
                if k:
                    numbers.append(self.names[names[k - 1]])
                pieces = cut(part)
                numbers.append(self.known[(pieces[0],)])
                numbers.extend(map(self.known.__getitem__, islice(pieces, 1, None)))
            ends.append(len(numbers))
        self.encode_new()
        used = np.array(numbers, dtype=np.int64)
        sizes = self.sizes[used]
        ids = self.ids[places((np.cumsum(self.sizes) - self.sizes)[used], sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes)])[ends]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, offsets = self.encode_all(texts)
        return [ids[s:e] for s, e in zip(offsets, offsets[1:], strict=False)]


def _encode(texts: pa.Array, encoder: Encoder) -> pa.Array:
    vocabulary = encoder.vocabulary
    ids, offsets = encoder.encode_all([x or "" for x in texts.to_pylist()])
    ends = np.concatenate([[0], np.cumsum(vocabulary.lengths[ids])])[offsets]
    data = vocabulary.decode(ids).tobytes()
    decoded = [data[s:e].decode("utf-8", "replace") for s, e in zip(ends, ends[1:], strict=False)]
    return pa.StructArray.from_arrays(
        [
            pa.array(np.diff(offsets)),
            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32())),
            pa.array(decoded, pa.string()),
        ],
        names=["n_tokens", "ids", "decoded"],
    )


def encode_rows(docs: DataFrame, path: str, name: str, text: str = "text") -> DataFrame:
    """The rows with a struct column `name`: n_tokens, ids and the text decoded from the ids."""
    vocabulary = Vocabulary(path)

    def start() -> Callable[[pa.RecordBatch], pa.Array]:
        encoder = Encoder(vocabulary)
        return lambda part: _encode(part.column(text), encoder)

    return add_column(docs, name, TOKENS, text, start, limit=1 << 20)


def encode_decode(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: the key, n_tokens, ids and the text decoded from the ids."""
    own = docs.select(c(key).alias("doc_id"), c(text).cast("string").alias("text"))
    return encode_rows(own, path, "found").select("doc_id", "found.*")


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
