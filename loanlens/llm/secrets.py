"""Secret scans over an incremental blob ledger, with DataFrame functions only.

A blob is the SHA-256 of a text: every historical version of a file has one, and all paths that
hold the same text share it. The ledger is a Parquet table of (blob, rule version, findings). A
scan takes the distinct blobs of the given versions, leaves out the (blob, rule version) pairs the
ledger has, scans the rest, appends them to the ledger, and joins findings back to all paths.

Spans: a pattern cuts a text into pieces between its matches; lengths of pieces and matches add up
to the positions, in code points, end exclusive.

Cases: null is the empty text, which has no findings. Equal paths, repeated versions and null paths
stay rows of their own. A ledger that does not exist yet is an empty one. Overlapping spans of
different kinds are all reported, in order of start and then of kind.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.rows import own_name
from loanlens.llm.storage import cut, new_path, once_each

c = F.col


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group whose length counts, and a cheap test that every text
    with a match passes."""

    kind: str
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...]
    base: bool = False


#: The three base kinds, in their order.
BASE = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
        r"""([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
        ("=", ":"),
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, ("AKIA",), True),
    # A run of 16 or more is what the plain run pattern finds there, as it takes whole runs.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, (), True),
)
#: Public formats of further secrets.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("PRIVATE KEY-----",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, ("eyJ",)),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, ("gh",)),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, ("xox",)),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39, ("AIza",)),
)
RULES = (*BASE, *MORE)

SPAN = "struct<start:bigint,rank:int,end:bigint>"
FINDINGS = f"array<{SPAN}>"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """A name of what the rules find: it changes with any of them."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's matches in a text, left to right and not overlapping."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    found = F.arrays_zip(
        F.transform(pieces, lambda x: F.length(x)).alias("gap"),
        F.transform(matches, lambda x: F.length(x)).alias("size"),
        F.transform(judged, lambda x: F.length(x)).alias("judged"),
    )
    empty = F.struct(
        F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {FINDINGS})").alias("out")
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")
        ).cast(SPAN)
        keep = x["judged"] >= rule.least
        return F.struct(
            end.alias("at"),
            F.when(keep, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    listed = F.aggregate(found, empty, step, lambda state: state["out"])
    maybe = F.lit(True)
    for k, hint in enumerate(rule.hints):
        maybe = F.contains(text, F.lit(hint)) if k == 0 else maybe | F.contains(text, F.lit(hint))
    if not rule.hints:
        maybe = F.rlike(text, F.lit(rule.pattern))
    return F.when(maybe, listed).otherwise(F.expr(f"cast(array() as {FINDINGS})"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of the texts in `content`."""
    listed = [spans(c("content"), rule, rank) for rank, rule in enumerate(rules)]
    return blobs.select("blob", F.array_sort(F.concat(*listed)).alias("findings"))


class Ledger:
    """The scanned (blob, rule version) pairs, a Parquet folder with a part for each version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def known(self, version: str) -> DataFrame | None:
        try:
            found = self.spark.read.parquet(f"{self.path}/rules={version}")
        except AnalysisException:
            return None
        return found.select("blob", "findings")

    def append(self, found: DataFrame, version: str) -> None:
        found.write.mode("append").parquet(f"{self.path}/rules={version}")

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan the unseen blobs of (blob, content) rows; gives the ledger of this rule version."""
        version = rule_version(rules)
        known = self.known(version)
        unseen = versions
        if known is not None:
            unseen = versions.join(known.select("blob"), "blob", "left_anti")
        unseen = unseen.dropDuplicates(["blob"])
        self.append(scan(unseen, rules), version)
        return self.known(version)


def scan_versions(
    versions: DataFrame,
    ledger: Ledger,
    path: str = "doc_id",
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """(path, findings) for each row. `versions` may hold many versions of a path."""
    content = F.coalesce(c(text).cast("string"), F.lit(""))
    found = ledger.update(
        versions.select(F.sha2(content, 256).alias("blob"), content.alias("content")), rules
    )
    paths = versions.select(c(path), F.sha2(content, 256).alias("blob"))
    return (
        paths.join(once_each(found, "blob"), "blob", "left")
        .select(path, F.coalesce("findings", F.expr(f"cast(array() as {FINDINGS})")).alias("findings"))
    )


def own_ledger(spark: SparkSession) -> Ledger:
    """A new, empty ledger in the shared folder."""
    return Ledger(spark, new_path(spark, "ledger"))


def as_text(findings: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.concat_ws(
        ",",
        F.transform(
            findings, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["end"])
        ),
    )


def of_rules(findings: Column, ranks: range) -> Column:
    return F.filter(findings, lambda x: x["rank"].between(ranks.start, ranks.stop - 1))


def redacted(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with each covered stretch replaced by a mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, x: Column) -> Column:
        # Spans come by start; one that begins inside what is gone only makes it longer.
        fresh = x["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, x["start"] - state["at"])
        return F.struct(
            F.when(fresh, F.concat(state["out"], gap, F.lit(mark)))
            .otherwise(state["out"])
            .alias("out"),
            F.greatest(state["at"], x["end"]).alias("at"),
        )

    whole = F.aggregate(
        findings,
        start,
        step,
        lambda state: F.concat(
            state["out"], F.substring(text, state["at"] + 1, F.length(text).cast("long"))
        ),
    )
    return F.when(F.size(findings) > 0, whole).otherwise(text)


#: Findings up to this number of rows, and of spans, are sent to all tasks; more are joined by a
#: shuffle.
BROADCAST_ROWS, BROADCAST_SPANS = 50_000, 500_000


def redact_rows(
    docs: DataFrame, ledger: Ledger, text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """The rows with their secrets replaced by a mark; the columns stay the same. Only blobs with
    findings are joined back."""
    content = F.coalesce(c(text).cast("string"), F.lit(""))
    blob, findings = own_name(docs.columns, "blob"), own_name(docs.columns, "findings")
    found = ledger.update(
        docs.select(F.sha2(content, 256).alias("blob"), content.alias("content")), rules
    )
    found = found.where(F.size("findings") > 0).dropDuplicates(["blob"])
    found = cut(found.select(c("blob").alias(blob), c("findings").alias(findings)))
    size = found.agg(F.count(F.lit(1)), F.sum(F.size(findings))).first()
    if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_SPANS:
        found = F.broadcast(found)
    joined = docs.withColumn(blob, F.sha2(content, 256)).join(found, blob, "left")
    clean = F.when(c(findings).isNull(), c(text)).otherwise(redacted(c(text), c(findings)))
    return joined.withColumn(text, clean).select(*docs.columns)
