"""Where results that cut a lineage are kept: the folder the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.sources.shared import kept as cut
from loanlens.sources.shared import new_folder as new_path
from loanlens.sources.shared import remove_folder, shared_folder

__all__ = ["cut", "new_path", "once_each", "remove_folder", "shared_folder"]


def once_each(stored: DataFrame, key: str) -> DataFrame:
    """A stored table with one row of each key. Only where two writers have stored a key twice is it
    written again; else it stays the stored table, so that Spark can split a join with it."""
    twice = stored.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return stored if twice.isEmpty() else cut(stored.dropDuplicates([key]))
