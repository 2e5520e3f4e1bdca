"""Words of Arrow string columns as numpy arrays: positions, hashes and window hashes.

Everything works on the UTF-8 bytes of a slice of texts, so a word costs a few vector operations
and no Python object. Slices hold `SLICE` bytes (one longer text makes a longer slice).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20
#: Bytes of a word above which a word is hashed on its own.
LONG = 256

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    steps = np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    return mix(steps + _U(seed * 0xD1342543DE82EF95 % (1 << 64)))


def byte_class(member) -> np.ndarray:
    """256 flags, from a test on a byte value."""
    return np.array([member(b) for b in range(256)], dtype=bool)


#: Bytes between words of kind `plain` are space and 09-0D; a word of kind `letters`
#: holds digits, ASCII letters and all bytes of non-ASCII characters.
PLAIN = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LETTERS = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


class Kept(dict):
    """A cache of one process; it travels empty."""

    def __reduce__(self):
        return Kept, ()


_POWERS = Kept()


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of an odd multiplier and of its inverse modulo 2**64."""
    if seed not in _POWERS or len(_POWERS[seed][0]) < n:
        size = max(SLICE + 1, 1 << int(n).bit_length())
        base = int(numbers(1, seed)[0]) | 1
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, factor, dtype=_U)
            row[0] = 1
            both.append(np.cumprod(row, dtype=_U))
        _POWERS[seed] = tuple(both)
    up, down = _POWERS[seed]
    return up[:n], down[:n]


class Words:
    """The words of some texts. Word i of the slice is bytes[start[i]:end[i]]; text k has the words
    first[k] to first[k + 1]."""

    def __init__(self, texts: pa.Array, kind: np.ndarray, lower: bool) -> None:
        self.bytes, self.offsets = text_bytes(texts)
        if lower:
            self.bytes = LOWER[self.bytes]
        inside = kind[self.bytes]
        n = len(inside)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word's bytes, eight bytes after another.

        Words of one length up to 8 bytes have different hashes. Words of more than `LONG` bytes
        are hashed by blake2b.
        """
        size = self.end - self.start
        value = mix(size.astype(_U) + numbers(1, seed)[0])
        if not len(size):
            return value
        padded = np.concatenate([self.bytes, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray(len(self.bytes) + 1, "<u8", padded, strides=(1,))
        often = size <= LONG
        which, at = np.flatnonzero(often), 0
        while len(which):
            left = size[which] - at
            keep = _U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * np.minimum(left, 8).astype(_U))
            value[which] = mix(value[which] * _U(0x9E3779B97F4A7C15) ^ (eight[self.start[which] + at] & keep))
            which, at = which[left > 8], at + 8
        key = int(seed).to_bytes(8, "little")
        for k in np.flatnonzero(~often):
            data = self.bytes[self.start[k] : self.end[k]]
            value[k] = int.from_bytes(hashlib.blake2b(data, digest_size=8, key=key).digest(), "little")
        return value

    def strings(self, which: np.ndarray) -> list[bytes]:
        data = self.bytes.tobytes()
        return [data[s:e] for s, e in zip(self.start[which], self.end[which], strict=True)]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n + 1 offsets into them. Null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + n + 1]
    offsets = offsets.astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(data: pa.Table | pa.RecordBatch, text: str, limit: int = SLICE) -> Iterator:
    """Record batches of about `limit` text bytes each."""
    batches = data.to_batches() if isinstance(data, pa.Table) else [data]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(False)
        total = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < n:
            before = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def windows(values: np.ndarray, first: np.ndarray, size: int, seed: int, short: bool):
    """Rabin-Karp hashes of `size` consecutive words of one text.

    Gives (hashes, starts): starts are word numbers of the slice. With `short`, a text of fewer
    words, but not none, has one window of all of them.
    """
    n = len(values)
    up, down = powers(seed, n + 1)
    total = np.empty(n + 1, dtype=_U)
    total[0] = 0
    np.cumsum(values * up[:n], dtype=_U, out=total[1:])
    last = np.repeat(first[1:], np.diff(first))  # for each word, the end of its text
    starts = np.flatnonzero(np.arange(n) + size <= last)
    hashes = mix((total[starts + size] - total[starts]) * down[starts])
    if short:
        count = np.diff(first)
        few = np.flatnonzero((count > 0) & (count < size))
        if len(few):
            begin, end = first[few], first[few + 1]
            own = mix((total[end] - total[begin]) * down[begin] + _U(seed) * count[few].astype(_U))
            starts = np.concatenate([starts, begin])
            hashes = np.concatenate([hashes, own])
            order = np.argsort(starts, kind="stable")
            starts, hashes = starts[order], hashes[order]
    return hashes, starts


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unpack(data: bytes | None, kind) -> np.ndarray:
    return np.frombuffer(data or b"", dtype=kind)


def buckets(values: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each hash, from its upper half."""
    return ((values >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def runs(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(ranked):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
    return starts, np.append(starts[1:], len(ranked))
