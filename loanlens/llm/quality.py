"""Quality classifier: hierarchical empirical Bayes over document, host and path evidence.

A logistic regression on the look of a text (shares of kinds of characters, repetition, and
pairs of character kinds) gives each document log-odds. Its posteriors summed by host and by
path are soft counts of good documents there. Each host's rate is shrunk toward the global rate,
each path's toward its host's; how strongly is estimated from how much hosts, and paths in hosts,
differ beyond chance. A document's log-odds move by the log-odds of its path's rate against the
global rate, so a sparse site says nothing and a large bad one much. Counts are taken over all
documents by grouped aggregation.

The regression is fitted on about `SAMPLE` labelled rows at most (a documented bound, chosen by a
hash of the id, and of id and text where ids repeat); a quarter of them calibrate it. Without labels
of both classes nothing is rejected.

Cases: null is the empty text, which has no look: its own evidence is 0. A null host or path is one
site with the empty one. Ids are cast to bigint. Rows with equal or null ids stay rows of their own; a label of an id counts for
each row that has the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm import words as w
from loanlens.llm.rows import add_column, own_name
from loanlens.llm.storage import cut
from loanlens.llm.urls import logistic

c = F.col

SAMPLE = 20_000
KINDS = 12
#: Sites up to this number are sent to all tasks; more are joined by a shuffle.
BROADCAST_SITES = 50_000


def _kind(b: int) -> int:
    """Kinds of bytes: small, capital, digit, space, line end, sentence mark, and others."""
    ch = chr(b)
    for k, members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
        if ch in members:
            return k
    for k, members in enumerate(("0123456789", " ", "\n\r", ".,;:", "!?", "|", "#$%&*", "<>/\\"), 2):
        if ch in members:
            return k
    return 10 if b >= 0x80 else 11


BYTE_KIND = np.array([_kind(b) for b in range(256)], dtype=np.int64)
STYLE = ("length", "distinct", "twice", "word_size", "long_words", "line_size")
FEATURES = len(STYLE) + KINDS + KINDS**2


def features(texts: pa.Array) -> np.ndarray:
    """[text, feature]: style, shares of character kinds, and shares of their pairs."""
    words = w.Words(texts, w.PLAIN, lower=False)
    n = len(texts)
    size = np.diff(words.offsets).astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(words.offsets))
    kind = BYTE_KIND[words.bytes]
    some = np.maximum(size, 1)[:, None]
    shares = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS) / some
    pair = kind[:-1] * KINDS + kind[1:]
    whole = owner[:-1] == owner[1:]
    at = owner[:-1][whole] * KINDS**2 + pair[whole]
    pairs = np.bincount(at, minlength=n * KINDS**2).reshape(n, KINDS**2) / some
    count = words.counts()
    text_of = np.repeat(np.arange(n), count)
    names = words.hashes(41)
    order = np.lexsort((names, text_of))
    new = np.ones(len(names), dtype=bool)
    new[1:] = (names[order][1:] != names[order][:-1]) | (text_of[1:] != text_of[:-1])
    distinct = np.bincount(text_of[new], minlength=n)  # text_of is in order either way
    again = (names[1:] == names[:-1]) & (text_of[1:] == text_of[:-1])
    twice = np.bincount(text_of[1:][again], minlength=n)
    length = words.end - words.start
    letters = np.bincount(text_of, length, minlength=n)
    longs = np.bincount(text_of, length > 15, minlength=n)
    lines = np.bincount(owner, words.bytes == 10, minlength=n) + 1
    most = np.maximum(count, 1)
    style = np.stack(
        [
            np.log1p(size) / 10,
            distinct / most,
            twice / most,
            letters / most / 10,
            longs / most,
            np.log1p(size / lines) / 10,
        ],
        axis=1,
    )
    return np.concatenate([style, shares, pairs], axis=1)


class Classifier:
    """Weights of the features after scaling, and the calibrating slope and offset."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        held = np.arange(len(y)) % 4 == 3
        if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
            held[:] = False
        fit = ~held
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0)
        self.used = np.flatnonzero(self.scale > 1e-9)
        z = self._scaled(x)
        self.weights, self.offset = _fit(z[fit], y[fit])
        raw = z @ self.weights + self.offset
        self.base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        part = held if held.any() else fit
        slope, offset = logistic(raw[part], y[part], np.ones(part.sum()))
        # The curve weighs classes alike; the base rate is put back.
        self.slope, self.shift = max(slope, 1e-3), offset + np.log(self.base / (1 - self.base))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x[:, self.used] - self.mean[self.used]) / self.scale[self.used], -6, 6)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        raw = self._scaled(x) @ self.weights + self.offset
        return np.clip(self.slope * raw + self.shift, -20, 20)


def _fit(z: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> tuple[np.ndarray, float]:
    """Logistic regression by iteratively reweighted least squares, both classes weighted alike."""
    z1 = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    beta = np.zeros(z1.shape[1])
    ridge = np.full(z1.shape[1], decay)
    ridge[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(z1 @ beta, -30, 30)))
        gradient = z1.T @ (weight * (p - y)) + ridge * beta
        hessian = (z1 * (weight * p * (1 - p))[:, None]).T @ z1 + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def train(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE
) -> Classifier | None:
    """Fit on at most about `sample` labelled rows."""
    good = labels.where(c(label).isNotNull() & c(key).isNotNull()).select(
        c(key).cast("long").alias("label_id"), (c(label) > 0).cast("double").alias("good")
    )
    good = good.groupBy("label_id").agg(F.max("good").alias("good"))
    count = good.count()
    share = min(1.0, sample / max(count, 1))
    chosen = good.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < share * (1 << 20))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text", limit=1 << 19):
                found = features(part.column("text")).astype(np.float32)
                yield pa.record_batch(
                    [part.column("label_id"), part.column("good")]
                    + [pa.array([row.tobytes() for row in found], pa.binary())],
                    names=["label_id", "good", "look"],
                )

    # The chosen ids are `sample` rows of two numbers. An id may have any number of rows: equal rows
    # count once, and different ones are chosen by a hash where there are too many.
    picked = docs.select(
        c(key).cast("long").alias("label_id"), c(text).cast("string").alias("text")
    ).join(F.broadcast(chosen), "label_id")
    digest = F.xxhash64("text", "label_id")
    count = picked.select(digest.alias("digest")).distinct().count()
    share = min(1.0, sample / max(count, 1))
    picked = picked.where(F.pmod(digest, F.lit(1 << 20)) < share * (1 << 20))
    rows = (
        picked.dropDuplicates(["label_id", "text"])
        .mapInArrow(look, "label_id long, good double, look binary")
        .toPandas()
        .sort_values(["label_id", "look"], kind="stable")
    )
    if rows["good"].nunique() < 2:
        return None
    x = np.stack([np.frombuffer(v, dtype=np.float32) for v in rows["look"]]).astype(np.float64)
    return Classifier(x, rows["good"].to_numpy())


def with_log_odds(docs: DataFrame, name: str, text: str, model: Classifier) -> DataFrame:
    """The rows with their own evidence, 0 for an empty text, in a column `name`."""

    def evidence(part: pa.RecordBatch) -> pa.Array:
        texts = part.column(text)
        empty = np.diff(w.text_bytes(texts)[1]) == 0
        return pa.array(np.where(empty, 0.0, model.log_odds(features(texts))))

    return add_column(docs, name, "double", text, lambda: evidence, limit=1 << 19)


def site_rates(thin: DataFrame, base: float) -> DataFrame:
    """(host, path, shift): the log-odds of each path's shrunk rate against the global rate, from
    rows of (host, path, p)."""
    paths = cut(
        thin.groupBy("host", "path").agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("good")
        )
    )
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), F.sum("good").alias("host_good")
    )
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    rate = min(max((whole["good"] or 0.0) / max(whole["n"] or 0.0, 1.0), 1e-6), 1 - 1e-6)
    host_strength = _strength(hosts, c("host_n"), c("host_good"), F.lit(rate))
    hosts = hosts.withColumn(
        "host_rate",
        (c("host_good") + host_strength * rate) / (c("host_n") + host_strength),
    )
    both = paths.join(hosts, "host")
    path_strength = _strength(both, c("n"), c("good"), c("host_rate"))
    path_rate = (c("good") + path_strength * c("host_rate")) / (c("n") + path_strength)
    return both.select("host", "path", (_odds(path_rate) - _odds(F.lit(rate))).alias("shift"))


def _odds(rate: Column) -> Column:
    return F.log(rate / (1 - rate))


def _strength(groups: DataFrame, n: Column, good: Column, rate: Column) -> float:
    """The number of documents a prior is worth: moments of a beta-binomial. Groups that differ no
    more than chance make it large, so that their rates are the prior's."""
    spread = n * (good / n - rate) * (good / n - rate) / (rate * (1 - rate))
    row = groups.agg(
        F.count(F.lit(1)).alias("k"), F.sum(spread).alias("q"), F.sum(n - 1).alias("m")
    ).first()
    if not row["k"] or not row["m"] or row["m"] <= 0:
        return 1e6
    # E[q] = k + within * sum(n - 1), where within = 1 / (strength + 1).
    within = ((row["q"] or 0.0) - row["k"]) / row["m"]
    return float(np.clip(1 / within - 1, 10.0, 1e6)) if within > 0 else 1e6


def judge(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    least: float = 0.5,
) -> DataFrame:
    """The rows with host, path, own_probability, probability and keep in a struct column
    `judgement` (a clash with an input column is avoided by underscores)."""
    name = own_name(docs.columns, "judgement")
    model = train(docs, labels, key, text, label)
    place = F.struct(
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
    )
    if model is None:
        nothing = F.lit(None).cast("double")
        verdict = F.struct(
            place["host"].alias("host"),
            place["path"].alias("path"),
            nothing.alias("own_probability"),
            nothing.alias("probability"),
            F.lit(True).alias("keep"),
        )
        return docs.withColumn(name, verdict)

    def probability(odds: Column) -> Column:
        return 1 / (1 + F.exp(-odds))

    short = docs.select(place.alias("site"), c(f"`{text}`").cast("string").alias("body"))
    thin = with_log_odds(short, "evidence", "body", model).select(
        "site.host", "site.path", probability(c("evidence")).alias("p")
    )
    rates = cut(site_rates(thin, model.base))
    site, shift = own_name(docs.columns, "site"), own_name(docs.columns, "shift")
    odds = own_name(docs.columns, "evidence")
    sites = rates.select(F.struct("host", "path").alias(site), c("shift").alias(shift))
    if rates.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    scored = with_log_odds(docs, odds, text, model).withColumn(site, place)
    final = probability(c(odds) + F.coalesce(c(shift), F.lit(0.0)))
    verdict = F.struct(
        c(site)["host"].alias("host"),
        c(site)["path"].alias("path"),
        probability(c(odds)).alias("own_probability"),
        final.alias("probability"),
        (final >= least).alias("keep"),
    )
    return (
        scored.join(sites, site, "left").withColumn(name, verdict).select(*docs.columns, name)
    )
