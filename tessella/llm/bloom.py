"""Blocked Bloom filters in DataFrame functions: 256-bit blocks, a key sets one bit in each of four 64-bit words.

A filter of at most ``MAX_WORDS`` words is held by every task, as the value of a scalar subquery; its size is bounded
whatever it is made of. With more keys than it has room for, more other keys pass, and never one of its own is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each key; a block has WORDS words of 64 bits.
BITS_PER_KEY, WORDS = 16, 4
#: Words that a filter held whole by every task has at most (8 MB).
MAX_WORDS = 1 << 20


def blocks_for(keys: int) -> int:
    """A power of two that gives each of ``keys`` about BITS_PER_KEY bits or more."""
    return 1 << max(0, (max(1, keys) * BITS_PER_KEY // (64 * WORDS)).bit_length())


def block_of(key: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 32) % blocks


def bit_of(key: Column, word: int) -> Column:
    """A 64-bit mask with the one bit that ``key`` sets in the given word of its block."""
    at = F.shiftrightunsigned(F.xxhash64(key), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def bloom_blocks(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, w0 .. w3) of the filter over ``keys.column``; blocks without a key are left out."""
    words = [F.bit_or(bit_of(F.col(column), i)).alias(f"w{i}") for i in range(WORDS)]
    return keys.groupBy(block_of(F.col(column), blocks).alias("block")).agg(*words)


def held_words(bloom: DataFrame, blocks: int) -> Column:
    """The whole filter as one array, by a scalar subquery: word ``i`` of block ``b`` is at b * WORDS + i."""
    every = bloom.sparkSession.range(blocks).withColumnRenamed("id", "block").join(bloom, "block", "left")
    words = F.array(*[F.coalesce(f"w{i}", F.lit(0).cast("long")) for i in range(WORDS)]).alias("words")
    in_order = F.sort_array(F.collect_list(F.struct("block", words)))
    return every.agg(F.flatten(F.transform(in_order, lambda x: x["words"])).alias("words")).scalar()


def block_words(words: Column, key: Column, blocks: int) -> Column:
    """The words of the block of ``key``, of a whole filter."""
    return F.slice(words, (block_of(key, blocks) * WORDS).cast("int") + 1, F.lit(WORDS))


def all_set(words: list[Column], key: Column) -> Column:
    """Whether the words of its block have all bits of ``key``."""
    return reduce(and_, [w.bitwiseAND(bit_of(key, i)) != 0 for i, w in enumerate(words)])


def possible(keys: DataFrame, column: str, count: int) -> Callable[[Column], Column]:
    """A test that is true of every key in ``keys.column``, which has ``count``, and of few others.

    ``keys`` should be kept, as each query that uses the test reads them.
    """
    blocks = min(blocks_for(count), MAX_WORDS // WORDS)
    words = held_words(bloom_blocks(keys, column, blocks), blocks)

    def test(key: Column) -> Column:
        own = block_words(words, key, blocks)
        return all_set([F.get(own, i) for i in range(WORDS)], key)

    return test
