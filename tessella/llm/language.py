"""Language identification by unigrams of pieces, marginalised over segmentations.

A text is its runs of letters, in lower case, each with the space mark of the vocabulary before it. A language gives every
piece of a fixed public vocabulary a probability; a word's probability is the sum, over all ways to cut it into pieces, of
the products, by the forward algorithm. No piece crosses words, so a text's probability is the product of its words', and
a worker computes each distinct word once, for all languages together.

The probabilities are learned by expectation maximisation: the counts of a language's words are summed in Spark, and each
iteration sums the expected uses of pieces (forward and backward) over the partitions of that table. The driver receives
one number for each piece and language. The words, of any length, come from at most ``MAX_TRAINING`` labelled documents,
those of least id hash; every text is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .lookup import KeyTable

#: Labelled documents whose words are learned from, at most.
MAX_TRAINING = 8000
ITERATIONS = 3
#: Added to the expected uses of every piece, and the probability of a letter that the vocabulary lacks.
SMOOTHING, UNKNOWN = 0.05, 1e-7
#: Words with more letters are rescaled every RESCALED letters, lest their products underflow.
LONG, RESCALED = 20, 8
#: Words whose probabilities a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 150_000, 64
#: Words and letters counted in a task before they are handed on.
HELD, HELD_LETTERS = 200_000, 16_000_000
#: Least posterior of a document that ``accepted`` keeps.
LEAST_SCORE = 0.5
UND = "und"
MARK = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str) -> list[str]:
    return common.LETTERS.findall(text.lower())


class Vocabulary:
    """The pieces that lower-case words can have, with a lookup of all substrings of many words."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = (library.id_to_piece(i) for i in range(library.get_piece_size()))
        fits = (x for x in texts if x.lower() == x and (x == MARK or common.LETTERS.fullmatch(x.removeprefix(MARK))))
        self.pieces = sorted(set(fits))
        self.longest = max(map(len, self.pieces))
        self.table = KeyTable(np.array([_key(x) for x in self.pieces], np.uint64).view(np.int64))

    def __len__(self) -> int:
        return len(self.pieces)

    def lattice(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length n: of each substring length, the pieces (words x starts); ``len(self)`` is unknown.

        Unknown substrings of more than one character are marked by ``len(self) + 1``, which has no probability.
        """
        n = len(words[0]) + 1
        points = np.frombuffer("".join(MARK + x for x in words).encode("utf-32-le"), np.uint32).reshape(len(words), n)
        points = points.astype(np.uint64)
        out, keys = [], np.zeros((len(words), n + 1), np.uint64)
        with np.errstate(over="ignore"):
            for size in range(1, min(self.longest, n) + 1):
                keys = keys[:, :-1] * _BASE + points[:, size - 1 :] + np.uint64(1)
                found = self.table.find(keys.ravel().view(np.int64)).reshape(keys.shape)
                out.append(np.where(found < 0, len(self) + (size > 1), found))
        return out


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _key(piece: str) -> int:
    key = 0
    for c in piece:
        key = (key * int(_BASE) + ord(c) + 1) & (2**64 - 1)
    return key


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each process and file."""
    return Vocabulary(path)


class Sums:
    """Sums over the segmentations of every prefix of words of one length, (n + 1) x words x languages, and their scales.

    The sum of the prefix of length i is ``sums[i] * exp(logs[i])``. Short words have no scales (``logs`` is None). Of the
    reversed lattice, the sums are those of the suffixes.
    """

    def __init__(self, lattice: list[np.ndarray], shares: np.ndarray):
        count, n = lattice[0].shape
        self.ids = _by_end(lattice)
        self.sums = np.ones((n + 1, count, shares.shape[1]))
        self.logs = np.zeros_like(self.sums) if n > LONG + 1 else None
        longest = len(lattice)
        for end in range(1, n + 1):
            first = max(0, end - longest)
            here = self.sums[first:end] * shares[self.ids[end][: end - first][::-1]]
            here.sum(0, out=self.sums[end])
            if self.logs is not None:
                self.logs[end] = self.logs[end - 1]
                if end % RESCALED == 0:
                    window = slice(max(0, end - longest + 1), end + 1)
                    most = self.sums[window].max(0)
                    self.sums[window] /= most
                    self.logs[window] += np.log(most)

    def total_logs(self) -> np.ndarray:
        """The logarithm of each whole word's sum (words x languages)."""
        return np.log(self.sums[-1]) + (0 if self.logs is None else self.logs[-1])


def _by_end(lattice: list[np.ndarray]) -> list[np.ndarray]:
    """Of each end, the pieces that stop there (sizes x words), the shortest first; none stop at 0."""
    count, n = lattice[0].shape
    ids = np.full((n + 1, len(lattice), count), -1, np.int32)
    for size, own in enumerate(lattice, 1):
        ids[size:, size - 1] = own.T
    return [ids[end, : min(end, len(lattice))] for end in range(n + 1)]


def _reversed(lattice: list[np.ndarray]) -> list[np.ndarray]:
    """The lattice of the words read from their ends."""
    return [x[:, ::-1] for x in lattice]


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        groups.setdefault(len(word), []).append(i)
    return groups


@dataclass
class Model:
    """Piece probabilities by language: rows are the vocabulary's pieces, the unknown letter and the impossible piece."""

    path: str
    langs: list[str]
    shares: np.ndarray

    @cached_property
    def _cache(self) -> tuple[dict[str, int], np.ndarray]:
        return {}, np.empty((0, len(self.langs)))

    def word_logs(self, words: list[str]) -> np.ndarray:
        """The log probability of each word in each language."""
        out = np.empty((len(words), len(self.langs)))
        for at in _by_length(words).values():
            out[at] = Sums(vocabulary(self.path).lattice([words[i] for i in at]), self.shares).total_logs()
        return out

    def log_probabilities(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The log probability of each text (as its words) in each language."""
        number, logs = self._cache
        if len(logs) > REMEMBERED:
            number, logs = {}, logs[:0]
        new = sorted({w for words in texts for w in words if w not in number}, key=len)
        number.update(zip(new, range(len(logs), len(logs) + len(new)), strict=True))
        logs = np.concatenate([logs, self.word_logs(new)])
        out = [logs[[number[w] for w in words]].sum(0) for words in texts]
        forgotten = [w for w in new if len(w) > LONGEST]  # the last of them
        for word in forgotten:
            del number[word]
        self.__dict__["_cache"] = (number, logs[: len(logs) - len(forgotten)])
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its posterior under a uniform prior; ``und`` and 0 without letters."""
        words = [words_of(x or "") for x in texts]
        out = []
        for own, logs in zip(words, self.log_probabilities(words), strict=True):
            # Runs may also be of numerals such as fractions, which aren't letters.
            if not self.langs or not any(c.isalpha() for word in own for c in word):
                out.append((UND, 0.0))
                continue
            best = int(np.argmax(logs))
            out.append((self.langs[best], float(1 / np.exp(logs - logs[best]).sum())))
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    letters = 0

    def flush() -> pa.RecordBatch:
        langs, words = zip(*counts, strict=True) if counts else ((), ())
        out = pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["lang", "word", "n"],
        )
        counts.clear()
        return out

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for word, n in Counter(words_of(text)).items():
                counts[lang, word] += n
            letters += len(text)
            if len(counts) > HELD or letters > HELD_LETTERS:
                yield flush()
                letters = 0
    yield flush()


def expected_uses(words: list[str], counts: np.ndarray, shares: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """How often each piece is used in ``counts`` copies of ``words``, on average over their segmentations."""
    out = np.zeros(len(shares))
    column = shares[:, None]
    for at in _by_length(words).values():
        lattice = vocab.lattice([words[i] for i in at])
        forward, backward = Sums(lattice, column), Sums(_reversed(lattice), column)
        before, after = forward.sums[:, :, 0], backward.sums[::-1, :, 0]
        if forward.logs is None:
            weight = counts[at] / before[-1]
        else:
            total = forward.total_logs()[:, 0]
            scale = forward.logs[:, :, 0], backward.logs[::-1, :, 0]
        for size, ids in enumerate(lattice, 1):
            n = ids.shape[1]
            uses = before[:n] * column[ids.T, 0] * after[size : size + n]
            if forward.logs is None:
                uses *= weight
            else:
                uses *= np.exp(scale[0][:n] + scale[1][size : size + n] - total) * counts[at]
            out += np.bincount(ids.T.ravel(), uses.ravel(), len(out))
    return out


def _normalised(uses: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    shares = (uses[: len(vocab)] + SMOOTHING) / (uses[: len(vocab)].sum() + SMOOTHING * len(vocab))
    return np.concatenate([shares, [UNKNOWN, 0.0]])


def train(docs: DataFrame, held_out: Column, path: str, most: int = MAX_TRAINING, iterations: int = ITERATIONS) -> Model:
    """Learned from text and lang of ``docs`` (doc_id, text, lang), without the rows for which ``held_out``."""
    vocab = vocabulary(path)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    chosen = usable.select(F.col("doc_id").alias("__chosen")).distinct().orderBy(F.xxhash64("__chosen"), "__chosen").limit(most)
    sample = usable.join(F.broadcast(chosen), F.col("doc_id") == F.col("__chosen"), "left_semi").select("lang", "text")
    counted = common.arrow_map(sample, _counted, "lang string, word string, n long")
    words = common.durable(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    shares = np.stack([_normalised(np.ones(len(vocab)), vocab)] * max(1, len(langs)), 1)[:, : len(langs)]
    for _ in range(iterations if langs else 0):
        found = docs.sparkSession.sparkContext.broadcast(shares)

        def expected(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            vocab = vocabulary(path)
            uses = np.zeros_like(found.value)
            for batch in batches:
                rows = np.array([langs.index(x) for x in batch["lang"].to_pylist()])
                text, n = batch["word"].to_pylist(), batch["n"].to_numpy(zero_copy_only=False).astype(float)
                for i in np.unique(rows):
                    at = np.flatnonzero(rows == i)
                    uses[:, i] += expected_uses([text[j] for j in at], n[at], found.value[:, i], vocab)
            piece, lang = np.nonzero(uses)
            yield pa.RecordBatch.from_pydict(
                {"piece": piece.astype(np.int32), "lang": lang.astype(np.int32), "uses": uses[piece, lang]}
            )

        partial = common.arrow_map(words, expected, "piece int, lang int, uses double", 10_000)
        total = partial.groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.zeros_like(shares)
        uses[total["piece"], total["lang"]] = total["uses"]
        shares = np.stack([_normalised(uses[:, i], vocab) for i in range(len(langs))], 1)
    return Model(path, langs, shares)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text).

    Defined results: texts without a letter, null and empty ones included, are ``und`` with score 0, as is everything if
    nothing was learned; very long texts and words are scored whole; of equally likely languages the first by name wins; repeated rows get equal results; a null
    doc_id is passed on; an empty table gives an empty result; other columns are ignored.
    """
    found = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = zip(*found.value.predict(batch["text"].to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.arrow_map(rows, judged, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is told with a posterior of ``least`` or more, with all their columns."""
    found = docs.sparkSession.sparkContext.broadcast(model)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [lang != UND and score >= least for lang, score in found.value.predict(batch["text"].to_pylist())]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return common.arrow_map(docs, filtered, docs.schema)


def op3_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op3_model(docs: DataFrame) -> Model:
    return train(docs.select("doc_id", "text", "lang"), op3_held_out(F.col("doc_id")), default_path())


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(op3_held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return predicted(docs, op3_model(docs)).select("doc_id", held_out, "lang_pred", "score")
