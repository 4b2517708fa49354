"""What the operators share: batches of bounded size and checks of column names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of whole texts handed to Python at once; with the byte bound below it keeps a batch in memory.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def bounded_batches(df: DataFrame) -> None:
    """Bound the Arrow batches of this session's Python stages by rows and bytes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def own_columns(key: str, made: list[str]) -> None:
    """Keys keep their name, so it may not be one that the operator makes."""
    if key in made:
        raise ValueError(f"key column {key!r} has the name of a result; rename it first")


def map_rows(df: DataFrame, schema: str, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Arrow batches through ``f``, lazily and one at a time."""
    bounded_batches(df)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield f(pdf)

    return df.mapInPandas(run, schema)


def keep_rows(df: DataFrame, column: str, wanted: Callable[[list], list[bool]]) -> DataFrame:
    """Rows whose value in ``column`` is wanted, all columns as they are; nothing is shuffled."""
    bounded_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(wanted(batch.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
