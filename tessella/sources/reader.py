"""A reader façade over Spark's sources: format, schema and options, then one or more paths, or a table of a catalog.

Pushdown, pruning, splitting, bucketing and the handling of corrupt or missing files are Spark's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class ColumnReader:
    """Collects what a load needs; every setter returns the reader."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._format = "parquet"
        self._schema: StructType | str | None = None
        self._options: dict[str, str] = {}

    def format(self, name: str) -> ColumnReader:
        self._format = name
        return self

    def schema(self, schema: StructType | str) -> ColumnReader:
        self._schema = schema
        return self

    def option(self, key: str, value: object) -> ColumnReader:
        self._options[key] = str(value).lower() if isinstance(value, bool) else str(value)
        return self

    def options(self, **more: object) -> ColumnReader:
        for key, value in more.items():
            self.option(key, value)
        return self

    def load(self, *paths: str) -> DataFrame:
        """Reads ``paths``, or the ``path`` option. A path listed twice is read twice."""
        if self._format.lower() == "hive":
            raise ValueError("Hive tables are read with spark.table, not by this reader")
        if paths and any(k.lower() == "path" for k in self._options):
            raise ValueError("give the path either as an option or to load(), not both")
        reader = self._spark.read.format(self._format).options(**self._options)
        if self._schema is not None:
            reader = reader.schema(self._schema)
        return reader.load(list(paths)) if paths else reader.load()


    def version(self, version: int | str) -> ColumnReader:
        """The state of a catalog's table with this version; catalogs that keep no versions refuse it."""
        return self.option("versionAsOf", version)

    def timestamp(self, timestamp: str) -> ColumnReader:
        """The state of a catalog's table at this time; catalogs that keep no versions refuse it."""
        return self.option("timestampAsOf", timestamp)

    def table(self, name: str) -> DataFrame:
        """Reads a table of a catalog, ``name`` or ``catalog.schema.name``, with the options set so far."""
        if self._schema is not None:
            raise ValueError("a catalog's table has its own schema")
        return self._spark.read.options(**self._options).table(name)


def tolerant(reader: ColumnReader) -> ColumnReader:
    """Skips files that are corrupt, or that vanish between listing and reading."""
    return reader.options(ignoreCorruptFiles=True, ignoreMissingFiles=True)
