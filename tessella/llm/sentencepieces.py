"""SentencePiece BPE encoding in vectorised merge rounds, and decoding.

A text, with one space before it and every space written as the space mark, is cut before each run of space marks: no
piece of the vocabulary has another character before a space mark (checked when the model is loaded), so no merge
crosses a cut. The distinct words that a batch adds to a worker's cache are merged together: all their symbols lie in one
flat array; each round takes every word's pair of least rank (by a segmented minimum), merges its leftmost occurrence, or
all that don't overlap where that can't change the order of merges, looks up the ranks of the new pairs and compacts the
arrays; words without a pair leave. Characters that the vocabulary lacks become pieces of single bytes.

A word of more than ``LONG`` characters would need a round for nearly every rank. Its rounds merge more at a time: every
pair with no pair of lower rank within as many symbols on both sides as the longest piece has characters. Nothing else can
reach such a pair before its turn: whatever would take one of its two symbols has to be made, or to stand, within one
piece's length of it, and the first merge of that kind would be a pair of lower rank there. Of pairs of equal rank that
overlap, every second one merges, counted from the first, once that one is free to. When a round merges little, as in
periodic text whose pairs wait for each other, a heap of the remaining pairs ends the word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .lookup import KeyTable

#: Words whose ids a worker remembers, and the longest (in characters) that it does.
REMEMBERED, LONGEST = 400_000, 64
#: Characters of a word beyond which it is merged in several places in each round, while one in LITTLE symbols merges.
LONG, LITTLE = 200, 64

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
NEVER = np.iinfo(np.int32).max
CODE_POINTS = 0x110000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A BPE model's vocabulary, merges and byte pieces. Symbols are piece ids, or ``size`` + code point if unknown."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = library.get_piece_size()
        self.begin, self.end, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        self.text = [library.id_to_piece(i) for i in range(n)]
        normal = [
            i for i in range(n)
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))
        ]
        self.control = {i for i in range(n) if library.is_control(i)}
        self.byte_of = {i: int(self.text[i][1:-1], 16) for i in range(n) if library.is_byte(i)}
        self.id_of_byte = np.zeros(256, np.int64)
        for i, value in self.byte_of.items():
            self.id_of_byte[value] = i
        ids = {self.text[i]: i for i in normal}
        if any(re.search(f"[^{MARK}]{MARK}", x) for x in ids):
            raise ValueError("a piece of this vocabulary crosses words")
        self.of_char = np.arange(n, n + CODE_POINTS, dtype=np.int64)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        order = {i: rank for rank, i in enumerate(sorted(normal, key=lambda i: -library.get_score(i)))}
        pairs: dict[tuple[int, int], int] = {}
        for piece, i in ids.items():
            for at in range(1, len(piece)):
                left, right = self._symbol(piece[:at], ids), self._symbol(piece[at:], ids)
                if left is not None and right is not None:
                    pairs[left, right] = i
        self._pair_table(pairs, order)
        # Merging X may uncover a pair of lower rank than X's own: then only the leftmost X is merged in a round.
        self.unsafe = np.zeros(n, bool)
        for (left, right), i in pairs.items():
            for half in (left, right):
                if half < n and half in order and order[i] < order[half]:
                    self.unsafe[half] = True
        self.reach = max(map(len, ids), default=1)
        self.surface = [x.replace(MARK, " ") for x in self.text]
        for i in self.control:
            self.surface[i] = ""
        self.surface[self.unknown] = " ⁇ "
        self.known: dict[str, bytes] = {}

    def _symbol(self, text: str, ids: dict[str, int]) -> int | None:
        if len(text) == 1:
            return int(self.of_char[ord(text)])
        return ids.get(text)

    def _pair_table(self, pairs: dict[tuple[int, int], int], order: dict[int, int]) -> None:
        lefts, rights = np.array(list(pairs), np.int64).reshape(-1, 2).T
        self.made = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.ranks = np.array([order[i] for i in pairs.values()], np.int32)
        self.keys = lefts * (self.size + CODE_POINTS) + rights
        self.table = KeyTable(self.keys)

    @cached_property
    def _number(self) -> dict[int, int]:
        """The number of each pair's merge by its key, for lookups of single pairs."""
        return dict(zip(self.keys.tolist(), range(len(self.keys)), strict=True))

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair's merge, -1 if it never merges."""
        return self.table.find(left * (self.size + CODE_POINTS) + right)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word (a run of space marks at most, then other characters)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
        symbols = self.of_char[points]
        word = np.repeat(np.arange(len(words)), sizes)
        merges = np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1:
            merges[:-1] = self._look_up(symbols[:-1], symbols[1:])
            merges[:-1][word[1:] != word[:-1]] = -1
        done_words, done_symbols = [], []
        while len(symbols):
            ranks = np.where(merges >= 0, self.ranks[merges], NEVER)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, len(word)))
            open_ = least != NEVER
            if not open_.all():
                stays = np.repeat(open_, lengths)
                done_words.append(word[~stays])
                done_symbols.append(symbols[~stays])
                symbols, word, merges, ranks = symbols[stays], word[stays], merges[stays], ranks[stays]
                if not len(symbols):
                    break
                least, lengths = least[open_], lengths[open_]
            at = np.flatnonzero(ranks == np.repeat(least, lengths))
            at = self._leftmost(at, word, merges)
            symbols, word, merges = self._merged(at, symbols, word, merges)
        return self._collected(len(words), done_words, done_symbols)

    def merge_long(self, word: str) -> np.ndarray:
        """The ids of one long word."""
        symbols = self.of_char[np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32)]
        one = np.zeros(len(symbols), np.int64)
        merges = np.full(len(symbols), -1, np.int64)
        merges[:-1] = self._look_up(symbols[:-1], symbols[1:])
        while (merges >= 0).any():
            ranks = np.where(merges >= 0, self.ranks[merges], NEVER)
            before, after = _least_before(ranks, self.reach), _least_before(ranks[::-1], self.reach)[::-1]
            free = (ranks <= before) & (ranks <= after)
            places = np.arange(len(ranks))
            starts = np.concatenate([[True], ranks[1:] != ranks[:-1]])  # of runs of equal ranks
            first = np.maximum.accumulate(np.where(starts, places, 0))
            held = np.cumsum(~free)  # places that aren't free, up to each place
            free &= (held == held[first]) & free[first] & ((places - first) % 2 == 0) & (merges >= 0)
            at = np.flatnonzero(free & ((ranks < before) | ~self.unsafe[self.made[merges]]))
            if len(at) * LITTLE < len(symbols):
                symbols = self._merged_by_heap(symbols, merges)
                break
            symbols, one, merges = self._merged(at, symbols, one, merges)
        return self._collected(1, [one[: len(symbols)]], [symbols])[0]

    def _merged_by_heap(self, symbols: np.ndarray, merges: np.ndarray) -> np.ndarray:
        """What is left of a word's ``symbols`` when its pairs merge one by one."""
        at = np.flatnonzero(merges >= 0)
        heap = list(zip(self.ranks[merges[at]].tolist(), at.tolist(), merges[at].tolist(), strict=True))
        heapify(heap)
        symbol, merge = symbols.tolist(), merges.tolist()
        n, base = len(symbol), self.size + CODE_POINTS
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        made, ranks, number = self.made.tolist(), self.ranks.tolist(), self._number
        while heap:
            _, i, m = heappop(heap)
            if merge[i] != m:  # one of the two has changed
                continue
            j = after[i]
            symbol[i], symbol[j], merge[j] = made[m], -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left < 0:
                    continue
                merge[left] = found = -1 if right >= n else number.get(symbol[left] * base + symbol[right], -1)
                if found >= 0:
                    heappush(heap, (ranks[found], left, found))
        return np.array([x for x in symbol if x >= 0], np.int64)

    def _leftmost(self, at: np.ndarray, word: np.ndarray, merges: np.ndarray) -> np.ndarray:
        """Of the places with their word's least rank, those that are merged in this round."""
        new_word = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        # Of pairs that overlap (places that follow each other, as in "aaaa"), every second one counts.
        breaks = np.concatenate([[True], (at[1:] != at[:-1] + 1) | new_word[1:]])
        run_start = np.maximum.accumulate(np.where(breaks, np.arange(len(at)), 0))
        alternate = (np.arange(len(at)) - run_start) % 2 == 0
        return at[new_word | (alternate & ~self.unsafe[self.made[merges[at]]])]

    def _merged(self, at, symbols, word, merges):
        symbols[at] = self.made[merges[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, word, merges = symbols[keep], word[keep], merges[keep]
        here = moved[at]
        changed = np.unique(np.concatenate([here, here[here > 0] - 1]))
        merges[changed] = -1
        inner = changed[changed + 1 < len(symbols)]
        inner = inner[word[inner] == word[inner + 1]]
        merges[inner] = self._look_up(symbols[inner], symbols[inner + 1])
        return symbols, word, merges

    def _collected(self, n: int, words: list[np.ndarray], symbols: list[np.ndarray]) -> list[np.ndarray]:
        word = np.concatenate(words) if words else np.empty(0, np.int64)
        symbol = np.concatenate(symbols) if symbols else np.empty(0, np.int64)
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        if (symbol >= self.size).any():
            raw = [chr(x - self.size).encode("utf-8", "replace") if x >= self.size else b"" for x in symbol.tolist()]
            counts = np.array([max(1, len(x)) for x in raw])
            ids = np.repeat(symbol, counts)
            ids[np.repeat(symbol >= self.size, counts)] = self.id_of_byte[np.frombuffer(b"".join(raw), np.uint8)]
            symbol, word = ids, np.repeat(word, counts)
        return np.split(symbol.astype("<u4"), np.searchsorted(word, np.arange(1, n)))

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            return WORD.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", f" {MARK}")).split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, without begin and end."""
        cut = list(map(self._words, texts))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({x for words in cut for x in words if x not in self.known})
        short = [x for x in new if len(x) <= LONG]
        merged = dict(zip(short, (x.tobytes() for x in self.merge(short)), strict=True)) if short else {}
        merged |= {x: self.merge_long(x).tobytes() for x in new if len(x) > LONG}
        known = self.known
        known.update(merged)
        out = [b"".join([known[x] for x in words]) for words in cut]
        for word in merged:
            if len(word) > LONGEST:
                del known[word]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: space marks are spaces, one at the start is dropped, and bytes are read as UTF-8."""
        if not self.byte_of.keys() & ids:
            text = "".join([self.surface[i] for i in ids])
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                parts.append(_utf8(run))
                run.clear()
                parts.append(self.surface[i])
            text = "".join([*parts, _utf8(run)])
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and self.text[first].startswith(MARK) else text


def _least_before(ranks: np.ndarray, reach: int) -> np.ndarray:
    """At each place, the least of the ``reach`` (or more) ranks before it."""
    least, width = ranks, 1
    while width < reach:  # the least of the ``width`` ranks up to each place
        least = np.minimum(least, _shifted(least, width))
        width *= 2
    return _shifted(least, 1)


def _shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    out = np.full_like(ranks, NEVER)
    out[by:] = ranks[:-by]
    return out


def _utf8(raw: bytearray) -> str:
    """The characters of ``raw``; each byte that begins no whole character is a replacement character."""
    parts = []
    while raw:
        try:
            parts.append(raw.decode())
            break
        except UnicodeDecodeError as error:
            parts.append(raw[: error.start].decode() + "�")
            raw = raw[error.start + 1 :]
    return "".join(parts)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each worker process and model."""
    return Pieces(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs`` (doc_id, text): ids (binary) with begin and end, and their text.

    ``ids`` are little-endian unsigned 32-bit integers. Defined results: a null text is encoded as an empty one, which
    has the begin and end ids alone; very long texts and words are encoded whole; of equal pairs the leftmost merges first,
    as in the library; a null doc_id is passed on; repeated rows give repeated results; an empty table
    gives an empty result; other columns are ignored.
    """
    path = path or default_path()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        begin, end = (i.to_bytes(4, "little") for i in (model.begin, model.end))
        for batch in batches:
            ids = [begin + x + end for x in model.encode([x or "" for x in batch["text"].to_pylist()])]
            texts = [model.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.arrow_map(rows, coded, "doc_id long, ids binary, decoded string")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    coded = encoded(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
