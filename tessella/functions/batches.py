"""The batch view: one row for each Arrow batch, with an array for each column, and accessors for batches in Python.

Where a batch ends depends on the partitioning, so only what doesn't depend on that (sums of lengths, round trips) is
meaningful as a result.

Encoded, some batches are one value: an Arrow stream, compressed, in which every batch can carry bytes of its own.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..operators.sorting import partition_scan, with_position
from ..session import ship

#: Values in an array of ``column_arrays``.
CHUNK = 10_000


def _as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ends = pa.array([0, batch.num_rows], pa.int32())
            columns = [pa.ListArray.from_arrays(ends, c) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def batch_view(df: DataFrame) -> DataFrame:
    """Each Arrow batch of ``df`` as one row, every column of type T as ARRAY<T>."""
    ship(df.sparkSession)
    return df.mapInArrow(_as_arrays, StructType([StructField(f.name, ArrayType(f.dataType)) for f in df.schema]))


def rows_of(batches: DataFrame) -> DataFrame:
    """The rows of a batch view: its inverse."""
    names = batches.columns
    zipped = batches.select(F.explode(F.arrays_zip(*names)).alias("row"))
    return zipped.select([F.col("row")[n].alias(n) for n in names])


def batch_sizes(batches: DataFrame) -> DataFrame:
    """(batch_rows) of each batch of a batch view."""
    return batches.select(F.size(batches.columns[0]).cast("long").alias("batch_rows"))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """``function`` applied to every Arrow batch."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(function, batches)

    return df.mapInArrow(mapped, schema)


#: ``function`` applied to each partition's number and its Arrow batches.
map_with_index = partition_scan


def column_arrays(df: DataFrame, by: str, column: str, size: int = CHUNK) -> DataFrame:
    """(by, chunk, values): the column's values of each group, sorted and cut into arrays of ``size``, nulls left out.

    Chunks are numbered from 0. A value's chunk follows from its place in the order by (by, column), so that no task has
    more than it would have in a sort, whatever the size of a group.
    """
    rows = with_position(df.select(by, column).filter(F.col(column).isNotNull()), by, column, name="__pos")
    first = rows.groupBy(F.col(by).alias("__by")).agg(F.min("__pos").alias("__first"))
    chunk = F.floor((F.col("__pos") - F.col("__first")) / size).alias("chunk")
    placed = rows.join(first, F.col(by).eqNullSafe(F.col("__by"))).select(by, chunk, column)
    return placed.groupBy(by, "chunk").agg(F.array_sort(F.collect_list(column)).alias("values"))


#: What a batch is encoded with: bytes for it, and the batch that goes into the stream.
Extra = Callable[[pa.RecordBatch], tuple[bytes, pa.RecordBatch]]
_SIDE = b"side"


def _plain(batch: pa.RecordBatch) -> tuple[bytes, pa.RecordBatch]:
    return b"", batch


def encode(
    batches: Iterable[pa.RecordBatch], columns: int | None = None, rows: int | None = None, extra: Extra = _plain
) -> bytes:
    """Batches as one value: of each at most the first ``columns``, of all together at most the first ``rows``.

    ``extra`` splits a batch into bytes that travel with it and what is encoded. Nothing for no batches.
    """
    sink, writer, left = io.BytesIO(), None, rows
    for batch in batches:
        if left is not None and left <= 0:
            break
        side, batch = extra(batch)
        batch = batch.select(batch.schema.names[:columns]).slice(0, left)
        if writer is None:
            writer = pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        writer.write_batch(batch, custom_metadata={_SIDE: side})
        left = None if left is None else left - batch.num_rows
    if writer is not None:
        writer.close()
    return sink.getvalue()


def decode(raw: bytes) -> Iterator[tuple[bytes, pa.RecordBatch]]:
    """The batches of an encoded value, each with the bytes that came with it."""
    if not raw:
        return
    reader = pa.ipc.open_stream(raw)
    while True:
        try:
            batch, metadata = reader.read_next_batch_with_custom_metadata()
        except StopIteration:
            return
        yield (metadata or {}).get(_SIDE, b""), batch


def encoded_batches(df: DataFrame, columns: int | None = None, rows: int | None = None, extra: Extra = _plain) -> DataFrame:
    """(part, encoded): the batches of each partition as one value, with at most ``rows`` of its rows."""

    def coded(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "encoded": [encode(batches, columns, rows, extra)]})

    return partition_scan(df, coded, "part int, encoded binary")


@dataclass(frozen=True)
class Column:
    """The values of one column of a batch."""

    values: pa.Array

    def __len__(self) -> int:
        return len(self.values)

    def get(self, i: int) -> Any | None:
        """The value at ``i``; None if it is null or there is no such row."""
        return self.values[i].as_py() if 0 <= i < len(self.values) else None

    def is_null_at(self, i: int) -> bool:
        return self.get(i) is None

    @property
    def any_null(self) -> bool:
        return self.values.null_count > 0

    def concat(self, other: Column) -> Column:
        if other.values.type != self.values.type:
            raise TypeError(f"can't append {other.values.type} to {self.values.type}")
        return Column(pa.concat_arrays([self.values, other.values]))

    def to_list(self) -> list:
        return self.values.to_pylist()


@dataclass(frozen=True)
class Batch:
    """Some rows, by column, as ``collect_batches`` gives them."""

    data: pa.RecordBatch

    def __len__(self) -> int:
        """The number of columns, as a batch is a sequence of columns."""
        return self.data.num_columns

    @property
    def num_rows(self) -> int:
        return self.data.num_rows

    def column(self, i: int) -> Column | None:
        return Column(self.data.column(i)) if 0 <= i < len(self) else None

    def is_null_at(self, i: int) -> bool:
        return self.column(i) is None

    @property
    def any_null(self) -> bool:
        return any(c.null_count for c in self.data.columns)

    def row(self, i: int) -> tuple | None:
        return tuple(c[i].as_py() for c in self.data.columns) if 0 <= i < self.num_rows else None

    def __iter__(self) -> Iterator[Column]:
        return map(Column, self.data.columns)

    def make_string(self, separator: str = ",") -> str:
        return separator.join(str(c.to_list()) for c in self)

    def take(self, start: int, stop: int) -> Batch:
        """Rows ``start`` to ``stop``, as many of them as there are."""
        start = min(max(0, start), self.num_rows)
        return Batch(self.data.slice(start, max(0, min(stop, self.num_rows) - start)))

    def equals(self, other: Batch) -> bool:
        """The same columns with the same values in the same order."""
        return self.data.equals(other.data)

    def __hash__(self) -> int:
        return hash((self.data.schema.to_string(), tuple(map(str, self.data.columns))))

    @property
    def nbytes(self) -> int:
        return self.data.nbytes

    def append(self, other: Batch) -> Batch:
        """The rows of both, one below the other."""
        return Batch(pa.Table.from_batches([self.data, other.data]).combine_chunks().to_batches()[0])


def concat_columns(batches: list[Batch]) -> list[Column]:
    """Each column of several batches as one."""
    table = pa.Table.from_batches([b.data for b in batches])
    return [Column(pa.concat_arrays(c.chunks)) for c in table.columns]


def collect_batches(df: DataFrame) -> list[Batch]:
    """All batches, on the driver: for results of known size."""
    return list(map(Batch, df.toArrow().to_batches()))


def collect_with_side_data(df: DataFrame, extra: Extra) -> list[tuple[bytes, Batch]]:
    """All batches, on the driver, in the order of the partitions, each with the bytes that ``extra`` makes of it there."""
    rows = encoded_batches(df, extra=extra).orderBy("part").select("encoded").collect()
    return [(side, Batch(batch)) for r in rows for side, batch in decode(bytes(r["encoded"]))]


def iterate_batches(df: DataFrame) -> Iterator[Batch]:
    """The batches one partition at a time, so that the driver holds no more than the largest partition, as Arrow data."""

    def coded(_: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"encoded": [encode([batch])]})

    for row in partition_scan(df, coded, "encoded binary").toLocalIterator():
        yield from (Batch(batch) for _, batch in decode(bytes(row["encoded"])))


def take_batches(df: DataFrame, n: int) -> list[Batch]:
    """Exactly ``n`` batches, or all if there are fewer."""
    return list(islice(iterate_batches(df), n))
