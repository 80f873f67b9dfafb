"""Exact de-duplication by a tree-merge of sorted digest runs.

Every input partition makes the digests of its texts a run of unique records (digest, check, smallest id, rows): it sorts
each batch and merges runs of like size, so a record is merged as often as the logarithm of the batches. The runs then meet in binomial rounds over 2**k lanes. A round covers up to ``FAN_BITS`` bits of the lane number:
lanes that differ in these bits only exchange slices of their runs, each keeps the digests that begin with its own bits,
and merges what it gets. After the last round, lane ``i`` holds the whole result for the digests that begin with the bits
of ``i``. A text that a third of all rows share is one record in every run from the first level on, so no lane grows with
its copies, and a lane's run never exceeds its share of the distinct digests of the runs merged so far.

Two equal SHA-256 digests must carry equal 64-bit check values (an independent hash of the same text) at every level;
a merge that sees them differ stops the job rather than dropping a document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of the lane number that one round settles: up to 2**FAN_BITS runs meet in a merge.
FAN_BITS = 3
#: Records in a row of the exchange, 56 bytes each.
CHUNK = 1 << 16
#: Digests of a run before it is merged.
BATCH = 10_000
#: A group with at least 1/HOT of all rows is joined by broadcast; there are at most HOT such groups.
HOT = 1000

RECORD = np.dtype([("digest", "S32"), ("check", "<i8"), ("id", "<i8"), ("rows", "<i8")])
NO_ID = np.iinfo(np.int64).max


def _prefixes(run: np.ndarray, bits: int = 64) -> np.ndarray:
    """The first ``bits`` bits of every digest."""
    return np.ascontiguousarray(run["digest"]).view(">u8")[::4].astype(np.uint64) >> np.uint64(64 - bits)


def _merged_order(prefixes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending arrays, all values in order and their places in the arrays put end to end; runs meet in pairs."""
    starts = accumulate(map(len, prefixes), initial=0)
    runs = [(x, np.arange(at, at + len(x))) for x, at in zip(prefixes, starts, strict=False)]
    while len(runs) > 1:
        runs.sort(key=lambda run: len(run[0]), reverse=True)
        (right, right_at), (left, left_at) = runs.pop(), runs.pop()
        at = np.searchsorted(left, right, side="right") + np.arange(len(right))
        rest = np.ones(len(left) + len(right), bool)
        rest[at] = False
        values, places = np.empty(len(rest), np.uint64), np.empty(len(rest), np.int64)
        values[at], values[rest], places[at], places[rest] = right, left, right_at, left_at
        runs.append((values, places))
    return runs[0]


def _folded(run: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """A run in order by prefix with its records of equal digests made one."""
    digests = run["digest"]
    like = np.flatnonzero(prefixes[1:] == prefixes[:-1])
    if (digests[like] != digests[like + 1]).any():  # different digests share a prefix: their order is that of the rest
        run = run[np.argsort(digests, kind="stable")]
        digests = run["digest"]
    first = np.ones(len(run), bool)
    first[like + 1] = digests[like] != digests[like + 1]
    starts = np.flatnonzero(first)
    out = run[starts]
    checks = run["check"]
    if (np.minimum.reduceat(checks, starts) != np.maximum.reduceat(checks, starts)).any():
        raise ValueError("two different texts share a SHA-256 digest")
    out["id"] = np.minimum.reduceat(run["id"], starts)
    out["rows"] = np.add.reduceat(run["rows"], starts)
    return out


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """The multiway merge of sorted runs: one sorted run of unique digests, with the smallest id and the rows of each."""
    runs = [x for x in runs if len(x)]
    if not runs:
        return np.empty(0, RECORD)
    prefixes, places = _merged_order([_prefixes(x) for x in runs])
    return _folded(np.concatenate(runs)[places], prefixes)


def sorted_run(records: np.ndarray) -> np.ndarray:
    """A run from records in any order."""
    prefixes = _prefixes(records)
    order = np.argsort(prefixes, kind="stable")
    return _folded(records[order], prefixes[order]) if len(records) else records


def _slices(lane: int, run: np.ndarray, done: int, step: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """What ``lane`` sends in the round that settles bits ``done`` to ``done + step``: (receiver, slice)."""
    if not len(run):
        return
    own = _prefixes(run, done + step).astype(np.int64) & ((1 << step) - 1)
    shift = bits - done - step
    cuts = np.flatnonzero(np.diff(own)) + 1
    for part in np.split(run, cuts):
        value = int(_prefixes(part[:1], done + step)[0]) & ((1 << step) - 1)
        yield (lane & ~(((1 << step) - 1) << shift)) | (value << shift), part


def _rows(slices: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lane, part in slices:
        for at in range(0, len(part), CHUNK):
            yield pa.RecordBatch.from_pydict(
                {"lane": pa.array([lane], pa.int32()), "run": pa.array([part[at : at + CHUNK].tobytes()], pa.binary())}
            )


def _received(batches: Iterable[pa.RecordBatch]) -> dict[int, list[np.ndarray]]:
    runs: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for lane, raw in zip(batch["lane"].to_pylist(), batch["run"].to_pylist(), strict=True):
            runs.setdefault(lane, []).append(np.frombuffer(raw, RECORD))
    return runs


def _leaves(step: int, bits: int, lane: int | None = None):
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[np.ndarray] = []
        for batch in batches:
            new = np.empty(batch.num_rows, RECORD)
            new["digest"] = np.frombuffer(b"".join(batch["digest"].to_pylist()), "S32")
            new["check"] = batch["check"].to_numpy(zero_copy_only=False)
            new["id"] = batch["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
            new["rows"] = 1
            runs.append(sorted_run(new))
            while len(runs) > 1 and len(runs[-2]) <= 2 * len(runs[-1]):
                runs[-2:] = [merged(runs[-2:])]
        own = TaskContext.get().partitionId() & ((1 << bits) - 1) if lane is None else lane
        yield from _rows(_slices(own, merged(runs), 0, step, bits))

    return leaves


def _level(done: int, step: int, bits: int):
    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lane, runs in sorted(_received(batches).items()):
            yield from _rows(_slices(lane, merged(runs), done, step, bits))

    return level


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, runs in sorted(_received(batches).items()):
        run = merged(runs)
        for at in range(0, len(run), CHUNK):
            part = run[at : at + CHUNK]
            raw = np.ascontiguousarray(part["digest"]).tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    "digest": pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()),
                    "keep_id": pa.array(part["id"], mask=part["id"] == NO_ID),
                    "group_size": pa.array(part["rows"]),
                }
            )


def tree_merge(digests: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """(digest, keep_id, group_size) of each distinct digest in ``digests`` (doc_id, digest binary(32), check long).

    The number of lanes is the session's number of shuffle partitions, rounded up to a power of two.
    """
    bits = max(1, (common.shuffle_partitions(digests.sparkSession) - 1).bit_length())
    rounds = -(-bits // fan_bits)
    steps = [bits // rounds + (i < bits % rounds) for i in range(rounds)]
    wire = "lane int, run binary"
    runs = common.arrow_map(digests.select("doc_id", "digest", "check"), _leaves(steps[0], bits), wire, BATCH)
    done = 0
    for i, step in enumerate(steps):
        done += step
        runs = runs.repartitionById(1 << bits, F.col("lane"))
        if i + 1 < rounds:
            runs = common.arrow_map(runs, _level(done, steps[i + 1], bits), wire)
    return common.arrow_map(runs, _roots, "digest binary, keep_id long, group_size long")


def _plain(text: Column) -> Column:
    """What is compared of a text: white space counts as one space, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.BLANK, " ")


def text_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, check) of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _plain(F.col("text")).alias("plain")).select(
        "doc_id", F.unhex(F.sha2("plain", 256)).alias("digest"), F.xxhash64("plain").alias("check")
    )


def _grouped(digests: DataFrame) -> DataFrame:
    """``digests`` (digest and other columns, kept) with keep_id and group_size of their group; nulls for a single row."""
    groups = common.durable(tree_merge(digests).filter("group_size > 1"))
    total = digests.count()
    with_hot = digests.join(F.broadcast(groups.filter(F.col("group_size") * HOT >= total)), "digest", "left")
    rest = with_hot.filter("group_size is null").select(digests.columns)
    cold = groups.filter(F.col("group_size") * HOT < total)
    return with_hot.filter("group_size is not null").unionByName(rest.join(cold, "digest", "left"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of white space by one space. Defined results: a null text
    is an empty one, and all empty texts are one group; very long texts are compared whole; rows without doc_id count in
    their group but never become its keep_id, and are kept only in a group without any id (keep_id null); repeated rows
    of one doc_id are one document and share its decision, a doc_id with different texts is one for each; an empty table
    gives an empty result; other columns are ignored.
    """
    return _judged(common.durable(text_digests(docs)))


def _judged(digests: DataFrame) -> DataFrame:
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return _grouped(digests).select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each text, with all its columns: one that has the smallest doc_id of the text's rows.

    Defined results are those of ``exact_duplicates``, but that one row stays where several have the smallest doc_id,
    or where none has one; which of these isn't defined, as they differ at most in white space and other columns.
    """
    digests = common.durable(text_digests(docs.select("doc_id", "text")))
    judged = common.durable(_judged(digests))
    repeated = common.repeated_ids(digests)
    copies = judged.filter("not kept and doc_id is not null").select("doc_id")
    one = common.without_ids(docs, common.durable(copies.join(repeated, "doc_id", "left_anti")))
    unclear = repeated.unionByName(digests.filter("doc_id is null").select("doc_id"))
    if unclear.isEmpty():
        return one
    # Rows that their doc_id doesn't tell apart are judged by their own digests.
    one = common.without_ids(one.filter("doc_id is not null"), repeated)
    rows = docs.filter("doc_id is null").unionByName(common.with_ids(docs, repeated))
    rows = rows.withColumn("__own", F.sha2(_plain(F.col("text")), 256)).withColumn("__id", F.col("doc_id").cast("long"))
    stays = judged.filter("kept").select(F.col("doc_id").alias("__kept"), "text_sha256").distinct()
    same = F.col("__own") == F.col("text_sha256")
    kept = rows.join(stays, same & F.col("__id").eqNullSafe(F.col("__kept")), "left_semi")
    return one.unionByName(kept.dropDuplicates(["__own"]).select(docs.columns))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.table(spark, sf_dir, "documents", "doc_id", "text"))
