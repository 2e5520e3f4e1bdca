"""Document fingerprints against plain Python."""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import functions as F

from loanlens.llm import catalog, fingerprints
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.conftest import odd_documents

BETWEEN = re.compile(r"[\x20\x09-\x0D]+")


def fingerprint(text):
    terms = {x for x in BETWEEN.split((text or "").lower()) if x}
    total, votes = 0, [0] * 64
    for term in terms:
        weight = max(1, min(len(term), 10) - 2)
        total += weight
        value = xxhash.xxh64_intdigest(term.encode(), 42)
        for k in range(64):
            votes[k] += weight * (value >> k & 1)
    return sum(1 << k for k in range(64) if 2 * votes[k] > total)


def wanted(docs):
    """(id, n_chars, sha of the edited text, fingerprint, edited fingerprint, likeness of both, and
    of the fingerprint to the next document's)"""
    docs = [(k, t or "") for k, t in brute.ordered(docs)]
    out = []
    for (key, text), (_, follows) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        own, other, next_one = (fingerprint(x) for x in (text, edited, follows))
        near = [1 - (own ^ x).bit_count() / 64 for x in (other, next_one)]
        row = (len(text), brute.sha(edited), f"{own:016x}", f"{other:016x}", *near)
        out.append((key, *row))
    return out


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]


def test_odd_documents(odd):
    c = F.col
    found = fingerprints.with_next(odd).select(
        *COLUMNS[:3],
        fingerprints.as_text(c("fingerprint")),
        fingerprints.as_text(c("edited_fingerprint")),
        fingerprints.likeness(c("fingerprint"), c("edited_fingerprint")),
        fingerprints.likeness(c("fingerprint"), c("next_fingerprint")),
    )
    assert brute.multiset(map(tuple, found.collect())) == brute.multiset(wanted(odd_documents()))


def test_query(spark):
    docs = catalog.table(spark, SMALL, "documents").select("doc_id", "text").collect()
    found = catalog.QUERIES["op1_document_fingerprints"](spark, SMALL)
    found = found.select(*COLUMNS, "near_edited", "near_next").collect()
    assert brute.multiset(map(tuple, found)) == brute.multiset(wanted([tuple(r) for r in docs]))
