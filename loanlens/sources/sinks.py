"""Report and intermediate-table sinks. All writes are distributed Spark writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def report_name(parameters: list[str]) -> str:
    """Report folder name made of the run's parameters, such as 'F_VINT=1996-BY_AGE.tsv'."""
    return "-".join(parameters).replace(" ", "-") + ".tsv"


def write_report(report: DataFrame, folder: str, parameters: list[str]) -> str:
    """Write a tab-separated report once; an existing one is left as it is."""
    path = f"{folder.rstrip('/')}/{report_name(parameters)}"
    report.write.mode("ignore").option("sep", "\t").option("header", True).csv(path)
    return path


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def source_file() -> Column:
    """Path of the report a row was read from."""
    return F.input_file_name()


def keep(frames: dict[str, DataFrame], folder: str) -> None:
    """Keep intermediate frames (universe, summary) as parquet for later inspection."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
