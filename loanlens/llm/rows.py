"""Arrow functions that add one column to the rows of a table, whatever other columns it has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from loanlens.llm import words as w

Compute = Callable[[pa.RecordBatch], pa.Array]


def own_name(taken: list[str], name: str) -> str:
    """The name, with underscores where the input has a column of that name."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def add_column(
    docs: DataFrame,
    name: str,
    kind: str,
    text: str,
    start: Callable[[], Compute],
    limit: int = w.SLICE,
) -> DataFrame:
    """The rows with a new column. `start` is called once in each task and gives the function from
    a slice of about `limit` text bytes to the column's values."""
    parsed: DataType = _parse_datatype_string(kind)
    schema = StructType([*docs.schema.fields, StructField(name, parsed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            for part in w.slices(batch, text, limit):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, compute(part)], names=[*part.schema.names, name]
                )

    return docs.mapInArrow(run, schema)
