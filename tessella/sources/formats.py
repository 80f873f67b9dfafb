"""A plug-in point for formats: two functions, one that splits a source and one that reads a split as Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

Options = dict[str, str]


def register_format(
    spark: SparkSession,
    name: str,
    schema: str,
    split: Callable[[Options], Sequence[Any]],
    read: Callable[[Any], Iterator[pa.RecordBatch]],
) -> None:
    """Makes ``spark.read.format(name)`` read by ``read``, one task for each of what ``split`` makes of the options.

    ``split`` runs once, on the driver; what it returns is sent to the tasks and should be small. ``read`` runs in the
    tasks and yields batches with the columns of ``schema``.
    """
    ship(spark)

    class Reader(DataSourceReader):
        def __init__(self, options: Options):
            self.options = dict(options)

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(x) for x in split(self.options)]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            yield from read(partition.value)

    class Format(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    spark.dataSource.register(Format)
