"""Token counts behind a digest cache.

The cache is a Parquet table of (digest, n_bytes, n_tokens) for each tokenizer version. A text's
digest is the SHA-256 of its normalised content; normalisation turns null into the empty text and
changes nothing else, since any other change could change the count. The version is the SHA-256 of
the tokenizer's file. Counts that the cache has are joined; of the rest each distinct text is
encoded once, by the library, and appended.

Inside a task, texts are cut where the tokenizer certainly begins a new word, and each distinct
piece is encoded once; texts with a special token's string are encoded whole.

Cases: null and empty texts have 0 tokens. Rows with equal or null ids stay rows of their own. A
cache that does not exist yet is an empty one; a digest that two writers appended counts once.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm import words as w
from loanlens.llm.pieces import Cache
from loanlens.llm.storage import new_path, once_each

c = F.col

COUNTS = "digest string, n_bytes long, n_tokens long"


class Counter:
    """Counts tokens with the library that a tokenizer file belongs to."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.data = file.read()
        self.kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
        self.version = hashlib.sha256(self.kind.encode() + self.data).hexdigest()

    def start(self) -> None:
        """Build the library's object; once in each task."""
        self.special: list[str] = []
        self.cut = False
        if self.kind == "sentencepiece":
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_buffer(self.data)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [x.content for x in self.model.get_added_tokens_decoder().values()]
        # Words are known to begin at spaces only for the plain byte-level pre-tokenizer.
        before = str(self.model.pre_tokenizer)
        self.cut = (
            self.model.normalizer is None
            and before.startswith("ByteLevel(")
            and "add_prefix_space=False" in before
            and "use_regex=True" in before
        )
        self.cache = Cache(self.whole)

    def whole(self, texts: list[str]) -> list[int]:
        if self.kind == "sentencepiece":
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [len(x) for x in found]

    def count(self, texts: list[str]) -> list[int]:
        if not self.cut:
            return self.whole(texts)
        plain = [not any(s in text for s in self.special) for text in texts]
        cached = self.cache.of([t for t, ok in zip(texts, plain, strict=True) if ok])
        rest = iter(self.whole([t for t, ok in zip(texts, plain, strict=True) if not ok]))
        return [sum(next(cached)) if ok else next(rest) for ok in plain]


def _run(batches: Iterator[pa.RecordBatch], counter: Counter) -> Iterator[pa.RecordBatch]:
    counter.start()
    for batch in batches:
        for part in w.slices(batch, "content", limit=1 << 20):
            _, offsets = w.text_bytes(part.column("content"))
            counts = counter.count(part.column("content").to_pylist())
            yield pa.record_batch(
                [
                    part.column("digest").cast(pa.string()),
                    pa.array(offsets[1:] - offsets[:-1], pa.int64()),
                    pa.array(counts, pa.int64()),
                ],
                names=["digest", "n_bytes", "n_tokens"],
            )


class DigestCache:
    """Stored counts, a Parquet folder with a part for each tokenizer version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def known(self, version: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/tokenizer={version}")
        except AnalysisException:
            return None

    def append(self, counts: DataFrame, version: str) -> None:
        counts.write.mode("append").parquet(f"{self.path}/tokenizer={version}")


def own_cache(spark: SparkSession) -> DigestCache:
    """A new, empty cache in the shared folder."""
    return DigestCache(spark, new_path(spark, "token-counts"))


def content(text: Column) -> Column:
    """The normalised content that is counted."""
    return F.coalesce(text.cast("string"), F.lit(""))


def token_counts(
    docs: DataFrame,
    cache: DigestCache,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: the key, n_bytes and n_tokens. Distinct misses are encoded and
    appended to the cache before this returns."""
    counter = Counter(tokenizer)
    known = cache.known(counter.version)
    wanted = docs.select(
        F.sha2(content(c(text)), 256).alias("digest"), content(c(text)).alias("content")
    )
    if known is not None:
        wanted = wanted.join(known.select("digest"), "digest", "left_anti")
    misses = wanted.dropDuplicates(["digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _run(batches, counter)

    cache.append(misses.mapInArrow(run, COUNTS), counter.version)
    stored = once_each(cache.known(counter.version), "digest")
    return (
        docs.select(c(key), F.sha2(content(c(text)), 256).alias("digest"))
        .join(stored, "digest")
        .select(key, "n_bytes", "n_tokens")
    )
