"""Global and local sorts with explicit directions and null order, top-k, and dense positions in a global order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

from ..session import ship
from ..storage import durable

#: monotonically_increasing_id() has the partition's number above these bits and the row's number within them.
ROW_BITS = 33
LEAST_INT = -(1 << 31)


@dataclass(frozen=True)
class Key:
    """A sort key: a column, its direction, and whether nulls come first (by default where Spark puts them)."""

    column: str | Column
    descending: bool = False
    nulls_first: bool | None = None

    def order(self) -> Column:
        column = F.col(self.column) if isinstance(self.column, str) else self.column
        first = not self.descending if self.nulls_first is None else self.nulls_first
        if self.descending:
            return column.desc_nulls_first() if first else column.desc_nulls_last()
        return column.asc_nulls_first() if first else column.asc_nulls_last()


def orders(keys: tuple[str | Key, ...]) -> list[Column]:
    return [(k if isinstance(k, Key) else Key(k)).order() for k in keys]


def packed_first(df: DataFrame, keys: tuple[str | Key, ...]) -> list[Column]:
    """The orders of ``keys``, behind one of the first two as one long if both are integers of at most 32 bits.

    Sorts compare the first eight bytes of the first order and look at the row only where these are equal, which is nearly
    always so if the first key has few values. The long never contradicts the keys' own order; where it is equal, as nulls
    equal the least or the greatest integer, the keys decide.
    """
    plain = [k if isinstance(k, Key) else Key(k) for k in keys]
    columns = [F.col(k.column) if isinstance(k.column, str) else k.column for k in plain[:2]]
    types = [f.dataType for f in df.select(*[c.alias(f"k{i}") for i, c in enumerate(columns)]).schema]
    if len(plain) < 2 or not all(isinstance(t, (ByteType, ShortType, IntegerType)) for t in types):
        return orders(keys)

    def code(key: Key, column: Column) -> Column:
        """0 to 2**32 - 1 in the order of the key, nulls apart."""
        number = column.cast("long")
        return F.lit(LEAST_INT - 1 + (1 << 32)) - number if key.descending else number - LEAST_INT

    def end(key: Key, least: int, most: int) -> Column:
        first = not key.descending if key.nulls_first is None else key.nulls_first
        return F.lit(least if first else most).cast("long")

    (a, b), (x, y) = plain[:2], columns
    low = F.coalesce(code(b, y), end(b, 0, (1 << 32) - 1))
    both = F.shiftleft(code(a, x) + LEAST_INT, 32).bitwiseOR(low)
    return [F.coalesce(both, end(a, -(1 << 63), (1 << 63) - 1)).asc(), *orders(keys)]


def global_sort(df: DataFrame, *keys: str | Key) -> DataFrame:
    """All rows in order: a sampled range exchange, then a spilling sort of each partition."""
    return df.orderBy(*packed_first(df, keys))


def local_sort(df: DataFrame, *keys: str | Key) -> DataFrame:
    """Each partition in order, without an exchange."""
    return df.sortWithinPartitions(*packed_first(df, keys))


def top(df: DataFrame, n: int, *keys: str | Key) -> DataFrame:
    """The first ``n`` rows of the order; each partition hands on at most ``n``."""
    return global_sort(df, *keys).limit(n)


def local_positions(df: DataFrame) -> DataFrame:
    """``df`` with ``part`` and ``pos``: the partition of each row, and its place there from 1 in the present order."""
    number = F.monotonically_increasing_id()
    part, row = F.shiftright(number, ROW_BITS).cast("int"), number.bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return df.select("*", part.alias("part"), row.alias("pos"))


def placed(df: DataFrame) -> DataFrame:
    """``df``, kept, with ``__part`` and ``__row``: the partition of each row and its number there."""
    tagged = durable(df.withColumn("__id", F.monotonically_increasing_id()))
    part, row = F.shiftright("__id", ROW_BITS), F.col("__id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return tagged.withColumn("__part", part.cast("int")).withColumn("__row", row).drop("__id")


def with_ordinal(df: DataFrame, name: str = "pos") -> DataFrame:
    """Numbers the rows of ``df`` from 1 in their present order.

    The rows are kept once; the driver sums the row counts of the partitions, one number each, and every partition adds
    its offset. No window over all rows is needed.
    """
    rows = placed(df)
    counts = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}
    offsets, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(part, 0)
    offset = F.get(F.lit(np.array(offsets or [0], np.int64)), F.col("__part"))  # one literal, however many partitions
    return rows.withColumn(name, offset + F.col("__row") + 1).drop("__part", "__row")


def with_position(df: DataFrame, *keys: str | Key, name: str = "pos") -> DataFrame:
    """The rows in global order, each with its place from 1. The keys should be unique together, or ties are arbitrary."""
    return with_ordinal(global_sort(df, *keys), name)


def partition_scan(df: DataFrame, function: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``function`` of each partition's number and its batches in their present order: one pass, without an exchange."""
    ship(df.sparkSession)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(TaskContext.get().partitionId(), batches)

    return df.mapInArrow(scanned, schema)


def group_ranges(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """(key, first_pos, last_pos): where each key's rows lie in the order by key and ``ties``."""
    return (
        with_position(df.select(key, *ties), key, *ties)
        .groupBy(key)
        .agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    )


def inversions(df: DataFrame, key: str) -> DataFrame:
    """One row (inversions): neighbours within a partition that are out of order by ``key``."""
    rows = placed(df.select(key))
    before = F.lag(key).over(Window.partitionBy("__part").orderBy("__row"))
    return rows.select((before > F.col(key)).alias("wrong")).agg(
        F.coalesce(F.sum(F.col("wrong").cast("long")), F.lit(0)).alias("inversions")
    )
