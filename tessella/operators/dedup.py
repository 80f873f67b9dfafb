"""De-duplication of sorted and unsorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import durable
from .sorting import Key, global_sort, orders, partition_scan

#: What ``_edges`` says of a row: it is new, the first of its partition, or (given again) the last.
NEW, FIRST, LAST = 0, 1, 2


def _changes(values: pa.Array) -> pa.Array:
    """Of each value but the first, whether it differs from the one before; nulls equal nulls, NaN equals NaN."""
    before, after = values[:-1], values[1:]
    if pa.types.is_nested(values.type):
        return pa.array([a != b for a, b in zip(before.to_pylist(), after.to_pylist(), strict=True)], pa.bool_())
    both = pc.equal(before, after)
    if pa.types.is_floating(values.type):
        both = pc.or_(both, pc.and_(pc.is_nan(before), pc.is_nan(after)))
    same = pc.if_else(pc.is_null(both), pc.and_(pc.is_null(before), pc.is_null(after)), both)
    return pc.invert(same)


def _edges(part: int, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition that differ from the one before, with its number and what they are."""

    def tagged(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        tags = [pa.array([x] * rows.num_rows, pa.int32()) for x in (part, kind)]
        return pa.RecordBatch.from_arrays([*rows.columns, *tags], names=[*rows.schema.names, "__part", "__kind"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is None:
            yield tagged(batch.slice(0, 1), FIRST)
            last = batch.slice(0, 1)
        values = pa.concat_arrays([last[column], batch[column]])
        yield tagged(batch.filter(_changes(values)), NEW)
        last = batch.slice(batch.num_rows - 1, 1)
    if last is not None:
        yield tagged(last, LAST)


def adjacent_unique(df: DataFrame, column: str, *keys: str | Key) -> DataFrame:
    """The rows, in the order by ``keys``, whose ``column`` differs from the row before; nulls equal each other.

    One pass over the sorted partitions compares each row with the one before it; what it leaves is kept. A partition's
    first row is then compared with the last of the partition before, of which there is one for each partition.
    """
    extra = [StructField("__part", IntegerType()), StructField("__kind", IntegerType())]

    def scan(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _edges(part, batches, column)

    rows = durable(partition_scan(global_sort(df, *keys), scan, StructType([*df.schema.fields, *extra])))
    lasts = rows.filter(F.col("__kind") == LAST).select("__part", F.struct(column).alias("__last"))
    before = lasts.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__before"))
    firsts = rows.filter(F.col("__kind") == FIRST).join(F.broadcast(before), "__part")  # one row for each partition
    differs = F.col("__before").isNull() | ~F.col("__before")[column].eqNullSafe(F.col(column))
    return rows.filter(F.col("__kind") == NEW).select(df.columns).unionAll(firsts.filter(differs).select(df.columns))


def first_per_key(df: DataFrame, by: list[str], *keys: str | Key) -> DataFrame:
    """Of the rows that agree in ``by``, the whole first one in the order by ``keys``.

    Spark limits the ranked window to one row for each key in every task before the shuffle, so that a frequent key
    doesn't fill a task.
    """
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*orders(keys))))
    return ranked.filter("__rank = 1").drop("__rank")


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropDuplicates(list(columns)) if columns else df.distinct()
