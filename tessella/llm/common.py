"""What several operators share: durable intermediate tables, word rules, and inputs without clashing columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..storage import durable  # noqa: F401  (operators take it from here)
from . import bloom

#: The white space that separates words in every contract of this subpackage, for Java and Python patterns.
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Rows that a Python function gets at a time.
ROWS = 256
LETTERS = re.compile(r"[^\W\d_]+")


def arrow_map(df: DataFrame, function: Callable, schema, rows: int = ROWS) -> DataFrame:
    """``mapInArrow`` by workers that can import this package; ``function`` gets batches of at most ``rows`` rows.

    What it makes of a batch in Python is several times as large as the batch, so that small ones keep workers small.
    """
    ship(df.sparkSession)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return df.mapInArrow(mapped, schema)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, and none of its others, so that those can't clash with computed ones."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _split(docs: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Rows of ``docs`` that have none of the ``ids`` (one column, kept) for sure, those that may, and the ids; None without ids.

    A Bloom filter of bounded size tells them apart, so that the texts of most rows aren't shuffled.
    """
    drop = ids.select(F.col(ids.columns[0]).cast("long").alias("__id"))
    n = drop.count()
    if not n:
        return None
    own = docs[column].cast("long")
    may = bloom.possible(drop, "__id", n)(own)
    return docs.filter(own.isNull() | ~may), docs.filter(own.isNotNull() & may), drop


def without_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id isn't in ``ids`` (one column, kept); rows without an id stay."""
    if not (parts := _split(docs, ids, column)):
        return docs
    apart, may, drop = parts
    return apart.unionByName(may.join(drop.hint("shuffle_hash"), may[column].cast("long") == drop["__id"], "left_anti"))


def with_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (one column, kept)."""
    if not (parts := _split(docs, ids, column)):
        return docs.limit(0)
    _, may, wanted = parts
    return may.join(wanted.hint("shuffle_hash"), may[column].cast("long") == wanted["__id"], "left_semi")


def repeated_ids(rows: DataFrame) -> DataFrame:
    """(doc_id), kept: the ids that several of ``rows`` (doc_id long) have."""
    return durable(rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
