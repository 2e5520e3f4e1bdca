"""URL filters: prefix rules, and for the rest a character language-model ratio.

URLs that a rule decides are the examples: two variable-order Markov models, of the allowed and of
the blocked ones, predict each character from up to `ORDER` characters before it. An order is
smoothed with the next lower one and counts for little where its context is rare. A URL's score is
the mean over its characters of the difference of log-likelihoods. One example in `HELD_OUT` is
left out of the counts at first: its scores calibrate the score to a probability (a logistic curve,
both classes weighted alike); from one half on a URL is allowed. Then it is counted too, so the
other URLs are scored with the counts of all examples.

Counts are a table with one row for each gram of the examples, named by a 64-bit hash; it grows
with the examples, and no task or driver holds it. Distinct URLs without a rule are cut into blocks
of about `BLOCK` bytes. A block sends each of its grams once, packed, to hash buckets, where the
table's rows are; the counts of those that the table has come back. Digits count as one character.

Cases: a null URL, and one without ://, has an empty host and path, no rule, and the score of its
characters. Without examples of both classes the method allows everything that no rule blocks.
Repeated rows and equal ids stay rows of their own; an example counts once for each of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm import words as w
from loanlens.llm.blocks import on_table, on_tables
from loanlens.llm.storage import new_path

c = F.col

ORDER = 5
#: Bytes of distinct URLs in a block.
BLOCK = 1 << 18
#: The name of the empty context, which every character has.
EMPTY = np.uint64(0)
STRENGTH = 2.0
#: Of the examples, one in so many calibrates before it is counted.
HELD_OUT = 5
BINS = 400
RANGE = 4.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The name and verdict of the longest rule that fits, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is tested first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _grams(urls: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the 1- to (ORDER + 1)-grams that end at each character, the same of their contexts,
    and the URL of each character."""
    data, offsets = w.text_bytes(urls)
    n = len(urls)
    size = np.diff(offsets) + ORDER + 1
    first = np.concatenate([[0], np.cumsum(size)])
    text = np.full(first[-1], 2, dtype=np.uint8)  # begin marks
    owner = np.repeat(np.arange(n), np.diff(offsets))
    at = np.arange(len(data)) - offsets[owner] + first[owner] + ORDER
    plain = w.LOWER[data]
    text[at] = np.where((plain >= 48) & (plain <= 57), 48, plain)
    text[first[1:] - 1] = 3  # end mark
    own = np.repeat(np.arange(n), size)
    place = np.arange(len(text)) - first[own]
    ends = np.flatnonzero(place >= ORDER)
    total = np.zeros(len(ends), dtype=np.uint64)
    names = np.empty((ORDER + 1, len(ends)), dtype=np.uint64)
    back = np.zeros(len(ends), dtype=np.uint64)
    contexts = np.empty((ORDER + 1, len(ends)), dtype=np.uint64)
    contexts[0] = EMPTY
    for k in range(ORDER + 1):
        total = total + w.numbers(256, 100 + k)[text[ends - k]]
        names[k] = w.mix(total)
        if k:
            back = back + w.numbers(256, 99 + k)[text[ends - k]]
            contexts[k] = w.mix(back)
    return names, contexts, own[ends]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from w.slices(batch, "url", limit=1 << 18)


KINDS = ("allowed", "blocked", "held_allowed", "held_blocked")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of each slice, and how often the examples of each kind hold them."""
    for part in _slices(batches):
        names, contexts, owner = _grams(part.column("url"))
        grams, at = np.unique(np.concatenate([contexts[0], names.ravel()]), return_inverse=True)
        owner = np.tile(owner, ORDER + 2)
        times, kind = part.column("n").to_numpy(), part.column("kind").to_numpy()
        counts = [
            np.bincount(at, np.where(kind == k, times, 0)[owner], minlength=len(grams))
            for k in range(len(KINDS))
        ]
        yield pa.record_batch(
            [pa.array(grams.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in counts)],
            names=["gram", *KINDS],
        )


def _ask(block: pa.Table, n_buckets: int) -> pa.Table:
    """The block's distinct grams and contexts, one packed row for each bucket."""
    number = block["block"][0].as_py()
    found = [np.empty(0, np.uint64)]
    for part in _slices(iter(block.to_batches())):
        names, contexts, _ = _grams(part.column("url"))
        found.append(np.unique(np.concatenate([names.ravel(), contexts.ravel()])))
    names = np.unique(np.concatenate(found))
    at = w.buckets(names, n_buckets)  # ascends with the names
    starts, ends = w.runs(at)
    return pa.table(
        {
            "bucket": pa.array(at[starts], pa.int64()),
            "block": pa.array([number] * len(starts), pa.int64()),
            "names": pa.array(
                [w.pack(names[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary()
            ),
        }
    )


def _known(names: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each name is in a sorted list, and whether it is there."""
    if not len(ranked):
        return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    at = np.minimum(np.searchsorted(ranked, names), len(ranked) - 1)
    return at, ranked[at] == names


def _answer(asked: pa.Table, counted: pa.Table) -> pa.Table:
    """For each block, those of its grams that are counted, with their counts."""
    grams = counted["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    grams = grams[order]
    counts = np.stack([counted[x].to_numpy()[order] for x in KINDS[:2]], axis=1)
    blocks, names, numbers = [], [], []
    for block, sent in zip(asked["block"].to_pylist(), asked["names"].to_pylist(), strict=True):
        sent = w.unpack(sent, np.uint64)
        at, there = _known(sent, grams)
        if there.any():
            blocks.append(block)
            names.append(w.pack(sent[there]))
            numbers.append(w.pack(counts[at[there]]))
    return pa.table(
        {
            "block": pa.array(blocks, pa.int64()),
            "names": pa.array(names, pa.binary()),
            "counts": pa.array(numbers, pa.binary()),
        }
    )


def _score(block: pa.Table, answers: pa.Table) -> pa.Table:
    grams = [np.empty(0, np.uint64), *(w.unpack(x, np.uint64) for x in answers["names"].to_pylist())]
    grams = np.concatenate(grams)
    counts = [np.empty(0, np.int64), *(w.unpack(x, np.int64) for x in answers["counts"].to_pylist())]
    counts = np.concatenate(counts).reshape(-1, 2)
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order].astype(np.float64)
    urls, scores = [], []
    for part in _slices(iter(block.to_batches())):
        urls.append(part.column("url"))
        scores.append(_scores(part.column("url"), grams, counts))
    return pa.table(
        {
            "url": pa.chunked_array(urls, pa.string()),
            "score": pa.array(np.concatenate(scores) if scores else np.empty(0)),
        }
    )


def _scores(urls: pa.Array, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Scores from sorted grams and their counts in both classes."""
    names, contexts, owner = _grams(urls)
    p = np.full((2, names.shape[1]), 1 / 256)
    for order in range(ORDER + 1):
        (at, gram), (before, context) = _known(names[order], grams), _known(contexts[order], grams)
        for k in range(2):
            seen = np.where(context, counts[before, k], 0) if len(counts) else np.zeros(p.shape[1])
            found = np.where(gram, counts[at, k], 0) if len(counts) else seen
            # Begin marks alone are a context, but no gram that is counted.
            found = np.minimum(found, seen)
            p[k] = (found + STRENGTH * p[k]) / (seen + STRENGTH)
    logs = np.log(p)
    n = len(urls)
    count = np.bincount(owner, minlength=n)
    return np.bincount(owner, logs[0] - logs[1], minlength=n) / np.maximum(count, 1)


def score_urls(urls: DataFrame, counted: DataFrame, n: int) -> DataFrame:
    """(url, score) of distinct URLs, in n blocks, from a table of gram, allowed and blocked."""
    cut = urls.select("url", F.pmod(F.xxhash64("url"), F.lit(n)).alias("block"))
    asked = cut.groupBy("block").applyInArrow(
        on_table(_ask, n_buckets=n), "bucket long, block long, names binary"
    )
    # The bucket of words.buckets.
    bucket = F.shiftrightunsigned(F.shiftrightunsigned(c("gram"), 32) * F.lit(n), 32)
    answers = (
        asked.groupBy("bucket")
        .cogroup(counted.withColumn("bucket", bucket).groupBy("bucket"))
        .applyInArrow(_answer, "block long, names binary, counts binary")
    )
    return (
        cut.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_score, "url string, score double")
    )


class Model:
    """The table of gram counts, and the curve from a score to a probability."""

    def __init__(self, table: DataFrame, n: int) -> None:
        self.table, self.n = table, n
        self.a, self.b = 1.0, 0.0

    def score_rows(self, urls: DataFrame) -> DataFrame:
        """(url, score) of distinct URLs, by the counts of all examples."""
        every = self.table.select(
            "gram", *((c(x) + c(f"held_{x}")).alias(x) for x in KINDS[:2])
        )
        return score_urls(urls, every, self.n)

    def scores(self, urls: pa.Array) -> np.ndarray:
        """The same of a few URLs on the driver."""
        asked = [x or "" for x in urls.to_pylist()]
        rows = self.table.sparkSession.createDataFrame([(x,) for x in set(asked)], "url string")
        found = {r["url"]: r["score"] for r in self.score_rows(rows).collect()}
        return np.array([found[x] for x in asked])

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * scores + self.b, -50, 50)))

    def probability_of(self, score: Column) -> Column:
        x = F.least(F.greatest(F.lit(self.a) * score + F.lit(self.b), F.lit(-50.0)), F.lit(50.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _kept(frame: DataFrame, name: str) -> DataFrame:
    """The frame, computed once and written to the shared folder."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def _distinct(urls: DataFrame) -> DataFrame:
    """url, verdict and the number n of their rows; a null URL is an empty one."""
    url = F.coalesce("url", F.lit("")).alias("url")
    found = urls.groupBy(url, "verdict").agg(F.count(F.lit(1)).alias("n"))
    return _kept(found, "urls")


def train(examples: DataFrame) -> Model | None:
    """The model of (url, verdict) examples, or None where a class has none."""
    return _train(_distinct(examples))


def _train(urls: DataFrame) -> Model | None:
    """The model of distinct URLs; those without a verdict only add to the number of blocks."""
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    blocked = c("verdict") == "block"
    kind = F.when(blocked, 1).otherwise(0) + F.when(held, 2).otherwise(0)
    row = urls.agg(
        F.sum(F.octet_length("url") + 1).alias("bytes"),
        *(F.count_if(c("verdict").isNotNull() & (kind == k)).alias(x) for k, x in enumerate(KINDS)),
    ).first()
    some = [row[x] > 0 for x in KINDS]
    if not (some[0] or some[2]) or not (some[1] or some[3]):
        return None
    examples = urls.where("verdict is not null").withColumn("kind", kind)
    counts = examples.select("url", "n", "kind").mapInArrow(
        _count, "gram long, " + ", ".join(f"{x} long" for x in KINDS)
    )
    table = _kept(counts.groupBy("gram").agg(*(F.sum(x).alias(x) for x in KINDS)), "grams")
    model = Model(table, math.ceil(row["bytes"] / BLOCK))
    if not all(some):  # nothing to calibrate by
        return model
    held_out = examples.where(held).select("url", "verdict", "n")
    scored = score_urls(held_out.select("url").distinct(), table, model.n)
    at = F.round(F.least(F.greatest(c("score") / RANGE, F.lit(-1.0)), F.lit(1.0)) * BINS)
    bins = (
        held_out.join(scored, "url")
        .groupBy(at.cast("long").alias("bin"), "verdict")
        .agg(F.sum("n").alias("count"))
        .toPandas()  # at most 4 * BINS rows
    )
    model.a, model.b = logistic(
        bins["bin"].to_numpy() * RANGE / BINS,
        (bins["verdict"] == "allow").to_numpy().astype(float),
        bins["count"].to_numpy().astype(float),
    )
    return model


def logistic(x: np.ndarray, y: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps, both classes weighted alike."""
    weight = np.where(y > 0, count / count[y > 0].sum(), count / count[y == 0].sum())
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        slack = weight * (p - y)
        curve = weight * p * (1 - p) + 1e-9
        gradient = np.array([(slack * x).sum() + 1e-3 * a, slack.sum()])
        cross = (curve * x).sum()
        step = np.linalg.solve(
            np.array([[(curve * x * x).sum() + 1e-3, cross], [cross, curve.sum()]]), gradient
        )
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def judge(
    pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per input row: the key, url, host, path, rule, verdict, score and probability; the
    last two are null where a rule decides."""
    host, path = host_and_path(c("url"))
    own = pages.select(c(key).alias("page_id"), c(url).cast("string").alias("url"))
    name, decided = longest_rule(c("host"), c("path"), rules)
    judged = own.withColumns({"host": host, "path": path})
    judged = judged.withColumns({"rule": name, "decided": decided})
    urls = _distinct(judged.select("url", c("decided").alias("verdict")))
    model = _train(urls)
    free = judged.where("decided is null")
    if model:
        scored = model.score_rows(urls.where("verdict is null").select("url"))
        scored = scored.withColumnRenamed("url", "chars")
        free = free.join(scored, F.coalesce("url", F.lit("")) == c("chars"))
        free = free.withColumn("probability", model.probability_of(c("score")))
    else:
        free = free.withColumns({"score": F.lit(0.0), "probability": F.lit(1.0)})
    columns = ["page_id", "url", "host", "path", "rule"]
    verdict = F.when(c("probability") >= 0.5, F.lit("allow")).otherwise(F.lit("block"))
    none = F.lit(None).cast("double")
    return judged.where("decided is not null").select(
        *columns, c("decided").alias("verdict"), none.alias("score"), none.alias("probability")
    ).unionByName(free.select(*columns, verdict.alias("verdict"), "score", "probability"))
