"""The structure of frames: projections, row ranges, concatenation, gathering, overwriting and equality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sorting import Key, global_sort, orders, with_ordinal, with_position

#: Rows from the start of an order up to which places are found by a top-k; beyond, by positions in the sorted table.
MOST_TAKEN = 100_000


def project(df: DataFrame, *ordinals: int) -> DataFrame:
    """Columns by ordinal, in the order given."""
    return df.select([df.columns[i] for i in ordinals])


def by_name(df: DataFrame, *names: str) -> DataFrame:
    """Columns by name, in the order given; unknown names are left out."""
    return df.select([n for n in names if n in df.columns])


def take(df: DataFrame, n: int, *keys: str | Key) -> DataFrame:
    """Exactly the first ``n`` rows (or all) of the order."""
    return global_sort(df, *keys).limit(n)


def take_range(df: DataFrame, start: int, stop: int, *keys: str | Key) -> DataFrame:
    """Rows ``start`` (from 0, included) to ``stop`` (excluded) of the order, with their places ``pos`` from 1.

    Of a range near the start each partition hands on at most ``stop`` rows, and nothing else is sorted or kept.
    """
    if stop > MOST_TAKEN:
        return with_position(df, *keys).filter((F.col("pos") > start) & (F.col("pos") <= stop))
    part = global_sort(df, *keys).offset(max(0, start)).limit(max(0, stop - max(0, start)))
    place = F.row_number().over(Window.orderBy(*orders(keys)))  # of at most stop - start rows
    return part.withColumn("pos", (place + max(0, start)).cast("long"))


def concat(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name."""
    return reduce(DataFrame.unionByName, frames)


def concat_take(n: int, frames: Sequence[DataFrame], *keys: str | Key) -> DataFrame:
    return take(concat(*frames), n, *keys)


def split_rows(df: DataFrame, n: int, *keys: str | Key) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows of the order, and the others; if there are no more, (all, none)."""
    rows = with_position(df, *keys)
    return rows.filter(F.col("pos") <= n).drop("pos"), rows.filter(F.col("pos") > n).drop("pos")


def split_columns(df: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    return df.select(df.columns[:at]), df.select(df.columns[at:])


def append_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of both, row by row in their present orders; as many rows as ``left`` has, nulls where right is short."""
    numbered = with_ordinal(left, "__at").join(with_ordinal(right, "__at"), "__at", "left")
    return numbered.orderBy("__at").drop("__at")


def gather(df: DataFrame, places: DataFrame, *keys: str | Key) -> DataFrame:
    """For each of ``places`` (slot, pos), the row at ``pos`` (from 1) of the order by ``keys``. Places may repeat."""
    last = places.agg(F.max("pos")).first()[0]
    return places.join(take_range(df, 0, last or 0, *keys), "pos")


def overwrite(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``df`` with the rows of ``changes`` (same columns) in place of those with the same ``key``.

    A change without such a row does nothing; a null in a change leaves the old value.
    """
    new = changes.select(F.col(key), *[F.col(c).alias(f"__new_{c}") for c in df.columns if c != key])
    return df.join(new, key, "left").select(
        [F.col(c) if c == key else F.coalesce(f"__new_{c}", c).alias(c) for c in df.columns]
    )


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (differences): rows of either that the other lacks, counting repeats."""
    either = left.exceptAll(right).unionAll(right.exceptAll(left))
    return either.agg(F.count("*").alias("differences"))


def equal(left: DataFrame, right: DataFrame) -> bool:
    """Whether both have the same columns (names and types) and the same rows, in any order."""
    return left.dtypes == right.dtypes and differences(left, right).first()[0] == 0


def content_hash(df: DataFrame) -> Column:
    """An aggregate that depends on the rows, not their order: the sum of their hashes, modulo 2**32, for any number of rows."""
    small = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 32)).cast("decimal(38,0)")
    return F.pmod(F.sum(small), F.lit(1 << 32).cast("decimal(38,0)")).cast("long")


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)


def any_null(df: DataFrame) -> DataFrame:
    """One row: of each column, whether it has a null."""
    return df.agg(*[F.coalesce(F.max(F.col(c).isNull()), F.lit(False)).alias(c) for c in df.columns])
