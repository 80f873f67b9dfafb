"""Range partitioning: weighted bounds, bucket search, histograms, and the exchange itself."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..storage import durable
from .sorting import global_sort, local_positions, partition_scan

#: Fixed values of the sampled range exchange: keys for each partition that is asked for, at most in all, and how many
#: times its share an input partition gives.
PER_PARTITION, MOST_SAMPLED, OVERSAMPLED = 20, 1_000_000, 3


def range_bounds(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """(bound_idx, bound): the ``partitions`` - 1 keys that divide the rows of ``df`` evenly, inclusive upper bounds.

    Bound i is the least key at which the running count of rows reaches i/partitions of all. Equal bounds are given
    once, with the smallest index, so there may be fewer. Exact: the rows are counted by key, and the running counts are
    summed within the partitions of the sorted keys; the driver gets one number for each partition.
    """
    counted = df.groupBy(key).agg(F.count("*").alias("__n"))
    schema = StructType([*counted.schema.fields, StructField("__part", IntegerType()), StructField("__sum", LongType())])
    sums = durable(partition_scan(global_sort(counted, key), _running, schema))
    ends = sorted(map(tuple, sums.groupBy("__part").agg(F.max("__sum")).collect()))
    before = dict(zip((p for p, _ in ends), accumulate((n for _, n in ends), initial=0), strict=False))
    total = sum(n for _, n in ends)
    offsets = np.zeros(max(before, default=0) + 1, np.int64)
    offsets[list(before)] = list(before.values())
    reached = F.get(F.lit(offsets), F.col("__part")) + F.col("__sum")
    # Of the i for which i/partitions of all rows lie beyond the keys before, the least; reached with this key or not.
    least = F.call_function("div", (reached - F.col("__n")) * partitions, F.lit(max(1, total))) + 1
    found = sums.select(F.col(key).alias("bound"), least.alias("i"), reached.alias("reached"))
    found = found.filter((F.col("i") < partitions) & (F.col("i") * total <= F.col("reached") * partitions))
    return found.select("bound", F.col("i").cast("int").alias("bound_idx"))


def _running(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts ``__n`` of a partition summed up, in order."""
    total = 0
    for batch in batches:
        sums = np.cumsum(batch["__n"].to_numpy()) + total
        total = int(sums[-1]) if len(sums) else total
        parts = pa.array([part] * batch.num_rows, pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(sums)], names=[*batch.schema.names, "__part", "__sum"])


def bucket_of(key: Column, bounds: Sequence) -> Column:
    """The bucket of ``key``: the number of ``bounds`` (ascending, inclusive upper bounds) strictly below it.

    Two steps, over every n-th bound and then the n between, so that a row compares about 2 * sqrt(bounds) values. Nulls
    are in bucket 0.
    """
    if not bounds:
        return F.lit(0)
    return F.when(key.isNull(), 0).otherwise(_below(key, [F.lit(b) for b in bounds]))


def bucket_of_keys(keys: Sequence[Column], bounds: Sequence[tuple]) -> Column:
    """As ``bucket_of`` for several keys, compared in order, a null below all; ``bounds`` are tuples."""
    if not bounds:
        return F.lit(0)
    names = [f"k{i}" for i in range(len(keys))]
    row = F.struct(*[k.alias(n) for k, n in zip(keys, names, strict=True)])
    return _below(row, [F.struct(*[F.lit(x).alias(n) for x, n in zip(b, names, strict=True)]) for b in bounds])


def _below(value: Column, bounds: Sequence[Column]) -> Column:
    stride = max(1, int(len(bounds) ** 0.5))
    passed = F.size(F.filter(F.array(*bounds[stride - 1 :: stride]), lambda b: b < value)) * stride
    rest = F.slice(F.array(*bounds), passed + 1, F.lit(stride))
    return passed + F.size(F.filter(rest, lambda b: b < value))


def histogram(df: DataFrame, key: str, bounds: Sequence) -> DataFrame:
    """(bucket, n): the rows in each bucket that has any."""
    return df.groupBy(bucket_of(F.col(key), bounds).alias("bucket")).agg(F.count("*").alias("n"))


def distribute(df: DataFrame, key: str, bounds: Sequence) -> DataFrame:
    """Puts every row into the partition that is numbered as its bucket."""
    return df.repartitionById(len(bounds) + 1, bucket_of(F.col(key), bounds).cast("int"))


def range_partition(df: DataFrame, partitions: int, *keys: str | Column) -> DataFrame:
    """Partitions of disjoint key ranges by sampled bounds; which bounds these are isn't fixed."""
    return df.repartitionByRange(partitions, *keys)


def partition_slots(df: DataFrame, keys: Sequence[str], k: int, seed: int = 7) -> DataFrame:
    """(part, key, weight): of each input partition its number and a sample of at most ``k`` keys, each a row.

    The first ``k`` rows of a partition have a slot each, the others are dealt to these at random, and each slot keeps one
    of its rows at random, which stands for as many as the slot had: the weights of a sample sum to the partition's rows,
    and of a partition of at most ``k`` rows all are in it. Slots are combined within the tasks, so that at most ``k`` rows
    of a partition are shuffled.
    """
    rows = local_positions(df.select(F.struct(*keys).alias("key")))
    slot = F.when(F.col("pos") <= k, F.col("pos") - 1).otherwise(F.floor(F.rand(seed) * k)).alias("slot")
    drawn = F.struct(F.rand(seed + 1).alias("r"), "key").alias("x")
    slots = rows.select("part", slot, drawn).groupBy("part", "slot")
    return slots.agg(F.count("*").alias("weight"), F.min("x")["key"].alias("key")).select("part", "key", "weight")


def partition_sample(df: DataFrame, keys: Sequence[str], k: int, seed: int = 7) -> DataFrame:
    """(part, n, sample): of each input partition its number, its rows, and a sample of at most ``k`` (key, weight).

    As ``partition_slots`` with a partition's sample in one row, which has to fit a task's memory.
    """
    slots = partition_slots(df, keys, k, seed)
    return slots.groupBy("part").agg(F.sum("weight").alias("n"), F.collect_list(F.struct("key", "weight")).alias("sample"))


def sampled_bounds(df: DataFrame, keys: Sequence[str], partitions: int, seed: int = 7) -> list[tuple]:
    """At most ``partitions`` - 1 bounds by weight from a bounded sample; null keys aren't sampled.

    min(20 * partitions, 1e6) rows are wanted; every input partition gives up to three times its even share, and one that
    has far more rows than that stands for is sampled again in proportion, so some four times the wanted rows reach the
    driver at most.
    """
    rows = df.select(*keys).dropna()
    want = min(PER_PARTITION * partitions, MOST_SAMPLED)
    inputs = df.select(F.spark_partition_id().alias("part")).distinct().count()
    k = -(-OVERSAMPLED * want // max(1, inputs))
    found = partition_sample(rows, keys, k, seed).collect()
    fraction = min(1.0, want / max(1, sum(r["n"] for r in found)))
    heavy = [r["part"] for r in found if r["n"] * fraction > k]
    candidates = [(tuple(x["key"]), x["weight"]) for r in found if r["part"] not in heavy for x in r["sample"]]
    if heavy:
        own = rows.withColumn("__part", F.spark_partition_id()).filter(F.col("__part").isin(heavy)).select(*keys)
        candidates += [(tuple(r), 1 / fraction) for r in own.sample(fraction=fraction, seed=seed).collect()]
    return weighted_bounds(candidates, partitions)


def weighted_bounds(candidates: Iterable[tuple[tuple, float]], partitions: int) -> list[tuple]:
    """The keys, ascending, at which the running weight reaches each i/partitions of all; none above the last but one key."""
    weights: dict[tuple, float] = {}
    for key, weight in candidates:
        weights[key] = weights.get(key, 0) + weight
    keys = sorted(weights, key=lambda key: [(x != x, x) for x in key])  # NaN after all numbers, as Spark has it
    step = sum(weights.values()) / partitions
    bounds: list[tuple] = []
    reached, target = 0.0, step
    for key in keys[:-1]:
        reached += weights[key]
        if reached >= target and len(bounds) < partitions - 1:
            bounds.append(key)
            target = (reached // step + 1) * step
    return bounds


def distribute_by_keys(df: DataFrame, keys: Sequence[str], bounds: Sequence[tuple]) -> DataFrame:
    """Puts every row into the partition that is numbered as its bucket by several keys."""
    return df.repartitionById(len(bounds) + 1, bucket_of_keys([F.col(k) for k in keys], bounds).cast("int"))


def overlaps(df: DataFrame, key: str) -> DataFrame:
    """One row (overlapping): neighbouring partitions, by least key, whose ranges of ``key`` overlap. Nulls don't count.

    Only each partition's least and greatest key reach the driver-side comparison, which is a sort of that many rows.
    """
    ranges = (
        df.select(F.spark_partition_id().alias("part"), key)
        .groupBy("part")
        .agg(F.min(key).alias("low"), F.max(key).alias("high"))
        .filter("low is not null")
    )
    before = F.max("high").over(Window.orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    return ranges.select((before > F.col("low")).alias("wrong")).agg(
        F.coalesce(F.sum(F.col("wrong").cast("long")), F.lit(0)).alias("overlapping")
    )


def sketch(df: DataFrame, key: str, bounds: Sequence, k: int) -> DataFrame:
    """(bucket, n, sample): of each bucket the row count and a sample of at most ``k`` keys, the same for any partitioning.

    A bucket's keys are dealt to ``k`` slots by hash, and each slot keeps the one of least hash: a minimum, combined before
    the shuffle.
    """
    bucket = bucket_of(F.col(key), bounds).alias("bucket")
    ranked = df.select(bucket, F.struct(F.xxhash64(key).alias("h"), F.col(key).alias("key")).alias("x"))
    counts = ranked.groupBy("bucket").agg(F.count("*").alias("n"))
    parts = ranked.groupBy("bucket", F.pmod(F.col("x.h"), F.lit(k)).alias("slot")).agg(F.min("x").alias("x"))
    samples = parts.groupBy("bucket").agg(F.array_sort(F.collect_set(F.col("x.key"))).alias("sample"))
    return counts.join(samples, "bucket")
