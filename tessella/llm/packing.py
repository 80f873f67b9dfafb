"""Packing: bounded-space online best fit, with a final merge of what is left in open windows.

Each partition keeps ``OPEN`` windows. A document's whole windows go out as they are; its rest goes into the fullest open
window that it fits. When it fits none and all windows are open, the fullest goes out: topped up with the head of
the rest if its gap is worth a cut, else padded. A partition's open windows, at most ``OPEN`` of them and so of bounded
size, are left over with their ids. Groups of ``MERGED`` partitions merge theirs: pieces are placed best fit decreasing,
windows that stay well short of full are strung together and cut, and the last remainder is cut into powers of two, which
need no padding.

Ids are encoded once; the pieces and leftovers of the first pass are kept in the shared folder, and cut ids only occur in
the task that has them, so every piece's checksum is taken of its own ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Tokens of a full sequence, and the id that ends a document.
SIZE, END_ID = 2048, 1
#: Open windows of a partition.
OPEN = 64
#: A gap of fewer tokens is padded, not filled with a cut piece.
CUT_GAP = 16
#: Partitions whose open windows are merged by one task: at most OPEN * SIZE * 4 bytes of ids from each.
MERGED = 16

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PIECE.split(", ")]
TYPES = pa.schema([(x, pa.int64()) for x in NAMES])

#: A piece while it is placed: (doc_id, start, ids, doc_tokens).
Piece = tuple[int | None, int, bytes, int]


def _length(piece: Piece) -> int:
    return len(piece[2]) // 4


def _cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * at], total), (doc, start + at, ids[4 * at :], total)


class Emitter:
    """Numbers sequences from ``first`` on and turns their pieces into rows."""

    def __init__(self, first: int):
        self.next = first
        self.rows: list[tuple] = []

    def emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for piece in pieces:
            doc, start, ids, total = piece
            self.rows.append((doc, start, _length(piece), zlib.crc32(ids), total, self.next, offset))
            offset += _length(piece)
        self.next += 1

    def taken(self) -> dict[str, pa.Array]:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(NAMES)
        self.rows = []
        return {n: pa.array(c, pa.int64()) for n, c in zip(NAMES, map(list, columns), strict=True)}


class Windows:
    """The open windows of a partition, by fill."""

    def __init__(self, out: Emitter, size: int = SIZE, limit: int | None = OPEN, cut_gap: int = CUT_GAP):
        self.out, self.size, self.limit, self.cut_gap = out, size, limit, cut_gap
        self.fills: list[tuple[int, int]] = []
        self.held: dict[int, list[Piece]] = {}
        self.made = 0

    def add(self, piece: Piece) -> None:
        while _length(piece) >= self.size:
            head, piece = _cut(piece, self.size)
            self.out.emit([head])
        n = _length(piece)
        if not n:
            return
        at = bisect_right(self.fills, (self.size - n, self.made)) - 1
        if at >= 0:
            fill, name = self.fills.pop(at)
        else:
            if self.limit is not None and len(self.fills) >= self.limit:
                piece = self._release_fullest(piece)
            fill, name = 0, self.made
            self.made += 1
            self.held[name] = []
        self.held[name].append(piece)
        fill += _length(piece)
        if fill == self.size:
            self.out.emit(self.held.pop(name))
        else:
            insort(self.fills, (fill, name))

    def _release_fullest(self, piece: Piece) -> Piece:
        """Sends the fullest window out, with the head of ``piece`` if the gap is worth it; what remains of the piece."""
        fill, name = self.fills.pop()
        window = self.held.pop(name)
        if self.size - fill >= self.cut_gap:
            head, piece = _cut(piece, self.size - fill)
            window.append(head)
        self.out.emit(window)
        return piece


def _first_pass(path: str, size: int, open_windows: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        part = TaskContext.get().partitionId()
        out = Emitter(part << 32)
        windows = Windows(out, size, open_windows)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode(texts), strict=True):
                ids += end
                windows.add((doc, 0, ids, len(ids) // 4))
            yield _with_ids(out.taken(), None, part)
        for fill, name in windows.fills:
            out.emit(windows.held[name])
        ids = [piece[2] for _, name in windows.fills for piece in windows.held[name]]
        yield _with_ids(out.taken(), ids, part)

    return packed


def _with_ids(columns: dict[str, pa.Array], ids: list[bytes] | None, part: int) -> pa.RecordBatch:
    n = len(columns["doc_id"])
    columns["ids"] = pa.array([None] * n if ids is None else ids, pa.binary())
    columns["part"] = pa.array([part] * n, pa.int32())
    return pa.RecordBatch.from_pydict(columns)


def merge_leftovers(pieces: list[Piece], out: Emitter, size: int = SIZE, cut_gap: int = CUT_GAP) -> None:
    """Packs ``pieces`` whole where they fit well, and cuts the others without any padding."""
    windows = Windows(out, size, None)
    for piece in sorted(pieces, key=_length, reverse=True):
        windows.add(piece)
    loose: list[Piece] = []
    for fill, name in windows.fills:
        if size - fill < cut_gap:
            out.emit(windows.held[name])
        else:
            loose += windows.held[name]
    row: list[Piece] = []
    room = size
    left = sum(map(_length, loose))
    if left < size:
        room = _power(left)
    for piece in loose:
        while _length(piece):
            head, piece = _cut(piece, min(room, _length(piece)))
            row.append(head)
            room -= _length(head)
            left -= _length(head)
            if not room:
                out.emit(row)
                row, room = [], size if left >= size else _power(left)


def _power(n: int) -> int:
    """The largest power of two up to ``n``."""
    return 1 << (n.bit_length() - 1) if n else 0


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, open_windows: int = OPEN) -> DataFrame:
    """The pieces (columns of ``PIECE``) of the sequences that hold all rows of ``docs`` (doc_id, text).

    Defined results: a null or empty text has the end id alone; a very long text fills as many whole sequences as it
    needs, its rest is packed like a short text; strings of the file's added tokens get these tokens' ids, as the library
    gives them; repeated rows are packed as documents of their own; of equally full windows the newest is taken; a null
    doc_id is passed on; an empty table gives an empty result; other columns are ignored. Every id of a document is in
    exactly one piece, pieces of a sequence follow each other without gaps from offset 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = _first_pass(path or tokens.default_path(), size, open_windows)
    first = common.durable(common.arrow_map(rows, placed, f"{PIECE}, ids binary, part int"))

    def merged(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        columns = (rows[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))
        out = Emitter((1 << 62) + ((min(rows["part"].to_pylist()) // MERGED) << 32))
        merge_leftovers(list(zip(*columns, strict=True)), out, size)
        return pa.table(out.taken())

    left = first.filter("ids is not null").withColumn("merge", F.floor(F.col("part") / MERGED))
    return first.filter("ids is null").select(NAMES).unionByName(left.groupBy("merge").applyInArrow(merged, PIECE))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents", "doc_id", "text"))
