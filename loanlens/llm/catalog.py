"""The operators' registered queries and their SQL answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.statements import SQL as SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from loanlens.llm.substrings import remove_repeats

    found = remove_repeats(table(spark, folder, "documents"), size=20)
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from loanlens.llm.similarity import similar_documents

    return similar_documents(table(spark, folder, "documents"), shingle=4, percent=85)


@query
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from loanlens.llm.contamination import contaminated, search

    found = search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=13)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated(percent=5).alias("contaminated"),
    )


#: Further words among which the words of a benchmark window may lie.
SLOP = 6


@query
def op8_benchmark_proximity(spark: SparkSession, folder: str) -> DataFrame:
    """Exact and proximity matches: all 13 words of a window within 13 + `SLOP` words."""
    from loanlens.llm.contamination import search

    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = search(docs, items, window=13, slop=SLOP)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        F.size("near_items").cast("long").alias("n_near_items"),
        F.sha2(F.concat_ws(",", "near_items"), 256).alias("near_items_sha256"),
    )


@query
def op1_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """`n_near`, for ids divisible by 50: other documents within 3 bits of the fingerprint."""
    from loanlens.llm import fingerprints as f
    from loanlens.llm.storage import cut

    c = F.col
    found = cut(f.with_next(table(spark, folder, "documents")))
    asked = found.where("doc_id % 50 = 0")
    holders = found.groupBy(c("fingerprint").alias("near")).agg(F.count(F.lit(1)).alias("k"))
    near = (
        f.within_radius(asked, found, radius=3)
        .join(holders, "near")
        .groupBy("fingerprint")
        .agg((F.sum("k") - 1).alias("n_near"))
    )
    return found.join(near, "fingerprint", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        f.as_text(c("fingerprint")).alias("fingerprint"),
        f.as_text(c("edited_fingerprint")).alias("edited_fingerprint"),
        f.likeness(c("fingerprint"), c("edited_fingerprint")).alias("near_edited"),
        f.likeness(c("fingerprint"), c("next_fingerprint")).alias("near_next"),
        F.when(c("doc_id") % 50 == 0, c("n_near")).alias("n_near"),
    )


@query
def op9_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Starts from an empty ledger, so every run scans every blob."""
    from loanlens.llm import secrets as s

    found = s.scan_versions(table(spark, folder, "documents"), s.own_ledger(spark))
    findings = F.col("findings")

    def number(rank: int) -> Column:
        return F.size(s.of_rules(findings, range(rank, rank + 1))).cast("long")

    base = s.as_text(s.of_rules(findings, range(len(s.BASE))))
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        s.as_text(findings).alias("spans"),
    )


#: The tokenizer of the registered queries; operators take any path.
TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Starts from an empty cache, so every run encodes every distinct text."""
    from loanlens.llm.tokencounts import own_cache, token_counts

    found = token_counts(
        table(spark, folder, "documents"), own_cache(spark), tokenizer_path(TOKENIZER)
    )
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op6_bpe_encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    from loanlens.llm.bpe import encode_decode, ids_text

    found = encode_decode(table(spark, folder, "documents"), tokenizer_path(TOKENIZER))
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def url_rules() -> list:
    from loanlens.llm.urls import Rule

    return [
        Rule("org", "/", "allow"),
        Rule("example.org", "/es/", "block"),
        Rule("example.org", "/en/1", "block"),
        Rule("com", "/fr/", "allow"),
        Rule("com", "/de/", "block"),
    ]


@query
def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    from loanlens.llm.urls import judge

    return judge(table(spark, folder, "pages"), url_rules()).drop("url")


@query
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """A document's site is its source; its language takes the place of the path."""
    from loanlens.llm.quality import judge

    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    found = judge(docs, table(spark, folder, "labels"), F.col("source"), F.col("lang"))
    return found.select("doc_id", "judgement.*")


@query
def op5_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """families: the families found, sorted; spans: paragraph:family of each finding."""
    from loanlens.llm.licenses import scan_rows

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = scan_rows(docs, "scan")
    rows = F.col("scan.found")
    spans = F.transform(
        rows, lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"])
    )
    return found.select(
        "doc_id",
        "scan.n_paragraphs",
        F.size(rows).cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(rows["family"])), ",").alias("families"),
        F.array_join(spans, ",").alias("spans"),
    )


@query
def op12_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from loanlens.llm.fingerprints import as_text
    from loanlens.llm.neardup import near_duplicates

    found = near_duplicates(table(spark, folder, "documents"), shingle=4, radius=4)
    return found.withColumn("fingerprint", as_text(F.col("fingerprint")))


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    from loanlens.llm.lexical import search

    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), top=10)


@query
def op11_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation begins with the first turns, up to 8, of one of every five."""
    from loanlens.llm import prefixtrie as p

    c, key = F.col, F.col("conv_id")
    turns = p.turns_of(table(spark, folder, "conversations"))
    rows = p.cut(p.rebuilt(turns, F.crc32(key.cast("string")) % 9, key - key % 5))
    trie = p.build(rows)
    digests = p.ends_digests(trie.ends).withColumnsRenamed({"depth": "d", "g1": "q1", "g2": "q2"})
    same = (c("depth") == c("d")) & (c("g1") == c("q1")) & (c("g2") == c("q2"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves"]
    none = F.sha2(F.lit(""), 256)
    return trie.nodes.join(digests, same, "left").select(
        *columns, "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
