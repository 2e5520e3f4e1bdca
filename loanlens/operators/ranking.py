"""Sellers and servicers ranked by the volume they originated in a vintage range."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions import loan
from loanlens.functions.text import DEFAULT_TOTAL
from loanlens.operators.filters import vintages
from loanlens.operators.positions import with_row_numbers
from loanlens.operators.summary import bit
from loanlens.spec import CohortSpec

c = F.col

UNNAMED = "Other"

# Report column with the name behind each party's rank.
NAME_COLUMNS = {"seller": "originator", "servicer": "servicer_name"}


#: Ranks that were worked out, by the loans they come from.
_KNOWN: WeakKeyDictionary[DataFrame, dict[tuple, DataFrame]] = WeakKeyDictionary()


def party_ranks(orig: DataFrame, spec: CohortSpec, party: str) -> DataFrame:
    """Rank, volume and first/last vintage per party over all loans of the vintage range.

    Unnamed sellers are left out before ranking. Unnamed servicers stay, with a NULL rank, and
    use up a number. Ties go by name. Volumes are summed once and kept in the shared folder: a report
    that chooses or groups by rank and then names its parties uses the same ranks again.
    """
    known = _KNOWN.setdefault(orig, {})
    chosen = party, spec.first_vintage, spec.last_vintage
    if chosen not in known:
        known[chosen] = _ranked(orig, spec, party)
    return known[chosen]


def _ranked(orig: DataFrame, spec: CohortSpec, party: str) -> DataFrame:
    volumes = (
        orig.filter(vintages(spec))
        .groupBy(F.coalesce(c(party), F.lit(UNNAMED)).alias(party))
        .agg(
            F.sum("orig_upb").alias("volume"),
            F.min(loan.vintage().cast("int")).alias("min_orig"),
            F.max(loan.vintage().cast("int")).alias("max_orig"),
        )
    )
    if party == "seller":
        volumes = volumes.filter(c(party) != UNNAMED)
    ordered = with_row_numbers(volumes, [c("volume").desc(), c(party).asc()], "position")
    return ordered.select(
        party,
        F.when(c(party) != UNNAMED, c("position")).alias(f"{party}_rank"),
        "volume",
        "min_orig",
        "max_orig",
    )


def with_rank(loans: DataFrame, orig: DataFrame, spec: CohortSpec, party: str) -> DataFrame:
    """Add the party's rank; loans of a party that is not ranked are dropped.

    The party list's size is not bounded by the schema, so the join is not hinted: AQE broadcasts
    the list when it turns out small and splits a party that holds a large share when not.
    """
    ranks = party_ranks(orig, spec, party).select(
        c(party).alias("_party"), f"{party}_rank"
    )
    key = F.coalesce(c(party), F.lit(UNNAMED))
    return loans.join(ranks, key == c("_party")).drop("_party")


def with_party_names(report: DataFrame, orig: DataFrame, spec: CohortSpec) -> DataFrame:
    """Add the name behind each rank to an aggregated report; subtotals are named as such.

    The names come from the rank list again rather than from a text minimum over loans.
    """
    for party, column in NAME_COLUMNS.items():
        if party not in spec.by:
            continue
        rank = f"{party}_rank"
        named = party_ranks(orig, spec, party).filter(c(rank).isNotNull())
        names = named.select(c(rank).alias("_rank"), c(party).alias("_name"))
        name = F.when(c(bit(rank)) == 1, DEFAULT_TOTAL).otherwise(
            F.coalesce(c("_name"), F.lit(UNNAMED))
        )
        report = (
            report.join(names, c(rank) == c("_rank"), "left")
            .withColumn(column, name)
            .drop("_rank", "_name")
        )
    return report
