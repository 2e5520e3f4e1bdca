from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loanlens.llm import words as w
from tests.llm import brute

TEXTS = st.lists(st.one_of(st.none(), st.text("aB \t\n9é.日", max_size=30)), max_size=8)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_words_are_the_pattern_s(texts):
    for kind, lower, pattern in (
        (w.PLAIN, False, brute.PLAIN),
        (w.LETTERS, True, brute.LETTERS),
    ):
        words = w.Words(pa.array(texts, pa.string()), kind, lower)
        found = [x.decode() for x in words.strings(np.arange(len(words)))]
        wanted = [(t or "").translate(brute.LOWER) if lower else t or "" for t in texts]
        wanted = [pattern.findall(t) for t in wanted]
        assert [found[s:e] for s, e in zip(words.first, words.first[1:], strict=False)] == wanted
        hashes = words.hashes(1)
        assert len(set(hashes.tolist())) == len(set(found))


def test_window_hashes_depend_on_the_words_alone():
    words = w.Words(pa.array(["a b c d", None, "x a b c", "c b a"]), w.PLAIN, False)
    names, starts = w.windows(words.hashes(1), words.first, 3, 9, False)
    assert starts.tolist() == [0, 1, 4, 5, 8]
    assert names[0] == names[3]
    assert len(set(names.tolist())) == 4
    names, starts = w.windows(words.hashes(1), words.first, 4, 9, True)
    assert starts.tolist() == [0, 4, 8]


def test_slices_hold_all_rows():
    table = pa.table({"text": ["x" * n for n in (5, 0, 90, 3, 3)] + [None], "n": range(6)})
    parts = list(w.slices(table, "text", limit=10))
    assert [x for p in parts for x in p.column("n").to_pylist()] == list(range(6))
    assert all(p.num_rows == 1 or p.get_total_buffer_size() for p in parts)


def thue_morse(n: int) -> tuple[str, str]:
    """A word of 2**n letters on which every polynomial hash modulo 2**64 fails, and its partner."""
    first, other = "a", "b"
    for _ in range(n):
        first, other = first + other, other + first
    return first, other


def test_hashes_tell_patterned_words_apart():
    for n in range(1, 15):
        words = w.Words(pa.array([" ".join(thue_morse(n))]), w.PLAIN, False)
        for seed in (1, 11, 15, 21, 31, 51):
            assert len(set(words.hashes(seed).tolist())) == 2


def test_hashes_of_words_of_every_length():
    texts = ["x" * n for n in range(1, 700)] + ["x" * n + "y" for n in range(1, 700)]
    texts += ["\0" * n for n in range(1, 30)] + ["x" * 700_000, "x" * 700_001]
    words = w.Words(pa.array([" ".join(texts), " ".join(reversed(texts))]), w.PLAIN, False)
    hashes = words.hashes(5)
    half = len(hashes) // 2
    assert hashes[:half].tolist() == hashes[half:][::-1].tolist()
    assert len(set(hashes.tolist())) == len(set(texts))
