"""Writing: Parquet files, bucketed tables, and the benchmark's generated table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The generated table has keys of one digit and values below the largest 32-bit integer.
KEYS, VALUES = 10, 2_147_483_647
#: A full-period step modulo VALUES (which is prime).
STEP, SEED = 48_271, 4_242


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, *columns: str) -> DataFrame:
    """A table at ``path``, bucketed and sorted: equality filters on ``columns`` read one bucket, joins don't shuffle."""
    bucketed = df.write.format("parquet").option("path", path).bucketBy(buckets, *columns).sortBy(*columns)
    bucketed.saveAsTable(name)
    return df.sparkSession.table(name)


def generate(spark: SparkSession, rows: int, seed: int = SEED) -> DataFrame:
    """(numA, numB): ``rows`` pairs of integers that depend on the row's number and ``seed`` alone."""
    mixed = (F.col("id") + seed) * STEP % VALUES
    return spark.range(rows).select(
        (F.floor(mixed / 7) % KEYS).cast("int").alias("numA"), (mixed * STEP % VALUES).cast("int").alias("numB")
    )
