"""Samples: Bernoulli, by hash, of fixed size, and contiguous slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sorting import Key, with_position


def bernoulli(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Every row with probability ``fraction``; keywords, for the positional form drops the seed."""
    return df.sample(fraction=fraction, seed=seed)


def by_hash(df: DataFrame, key: str, per_mille: int) -> DataFrame:
    """The rows whose hashed integer key falls into the first ``per_mille`` of 1000 classes: stable under any layout."""
    mixed = F.pmod(F.col(key).cast("decimal(38,0)") * F.lit(2_654_435_761).cast("decimal(38,0)"), F.lit(1000))
    return df.filter(mixed < per_mille)


def reservoir(df: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` rows, uniformly, or all if there are fewer; each partition hands on at most ``k``. None for k < 1."""
    return df.orderBy(F.rand(seed)).limit(k) if k > 0 else df.limit(0)


def reservoir_and_count(df: DataFrame, k: int, seed: int) -> DataFrame:
    """One row (sampled, total): the sample's size and the number of rows that it was taken from."""
    sampled = reservoir(df.select(F.lit(1).alias("one")), k, seed).agg(F.count("*").alias("sampled"))
    total = df.agg(F.count("*").alias("total"))
    return sampled.select("sampled", total.scalar().alias("total"))


def uniform_int(low: int, high: int, seed: int) -> Column:
    """A random integer from ``low`` to ``high``, both included."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("long")


def random_slice(df: DataFrame, seed: int, *keys: str | Key) -> DataFrame:
    """A contiguous slice of the order by ``keys``: the start is random, and so is the end behind it. May be empty."""
    rows = with_position(df, *keys)
    n = rows.count()
    if not n:
        return rows.drop("pos")
    start, end = df.sparkSession.range(1).select(uniform_int(0, n - 1, seed), F.rand(seed + 1)).first()
    stop = start + int(end * (n - start + 1))
    return rows.filter((F.col("pos") > start) & (F.col("pos") <= stop)).drop("pos")
