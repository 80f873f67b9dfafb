"""Quality rules: how far a document's histograms diverge from those of its nearest language.

Two passes over the texts. The first counts character classes and all words of every document that has a language, in
Python with bounded dictionaries per task, and sums them in Spark; of each language the ``COMMON`` most frequent words
stay. The second compares each document's character-class and common-word histograms with every language's by the
Jensen-Shannon distance (base 2, the square root of the divergence) and takes the nearest language, so that a wrong or
missing label doesn't condemn a text. Short texts have noisy histograms: below ``MIN_CHARS`` or ``MIN_WORDS`` the
distance in question isn't held against a document.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words a language's reference histogram has, besides one bin for all others.
COMMON = 100
#: Longer words (in bytes) are counted under their MD5, so that what a task holds is bounded.
LONGEST = 32
#: Least characters and words for the two distances to count.
MIN_CHARS, MIN_WORDS = 200, 50
#: Largest distances of a document that is kept. That of n words may be greater by WORD_NOISE / sqrt(n), as the distance of
#: a sample from its own source falls with the root of its size.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, WORD_NOISE = 0.28, 0.4, 1.2
#: Words counted in a task before they are handed on.
HELD = 150_000

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "other letter", "digit", "blank", "stop", "symbol", "other")


@lru_cache(maxsize=1)
def class_of() -> np.ndarray:
    """The class of each code point below 65536; all above are ``other``."""
    out = np.full(65537, CLASSES.index("other"), np.int8)
    for i in range(65536):
        c = chr(i)
        kind = unicodedata.category(c)
        if c in common.BLANKS or kind == "Zs":
            name = "blank"
        elif i < 128 and kind in ("Ll", "Lu"):
            name = "lower" if kind == "Ll" else "upper"
        elif kind[0] in "LM":
            name = "other letter"
        elif kind == "Nd":
            name = "digit"
        elif c in ".,;:!?'\"()-" or kind in ("Pi", "Pf", "Pd"):
            name = "stop"
        elif kind[0] in "PS":
            name = "symbol"
        else:
            continue
        out[i] = CLASSES.index(name)
    return out


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.bincount(class_of()[np.minimum(points, 65536)], minlength=len(CLASSES))


def _fold(word: bytes) -> bytes:
    """How a word is counted: lower case, without the stops around it."""
    return word.decode(errors="replace").lower().strip(".,;:!?'\"()-").encode()


def _key(word: bytes) -> bytes:
    """What a word is counted as before the fold. A digest begins with a blank, as no word does."""
    if len(word) <= LONGEST:
        return word
    folded = _fold(word)
    return folded if len(folded) <= LONGEST else b" " + hashlib.md5(folded).hexdigest().encode()


@dataclass
class Words:
    """What one split of a text gives all rules."""

    distinct: list[bytes]
    counts: np.ndarray
    base: tuple[int, int, int, int, int]


def measure(text: str) -> Words:
    """The base counts of a text: words, code points in words, symbols, repeated lines, words in repeated windows."""
    raw = text.encode(errors="replace")
    words = raw.split()  # on exactly the six white spaces of ``common.BLANKS``
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text) - sum(map(text.count, common.BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    counts = np.bincount(ids, minlength=len(number))
    base = (len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(ids, len(number)))
    return Words(list(number), counts, base)


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """How many words stand in a window of three that the text has twice or more."""
    if len(ids) < 4 or distinct == len(ids):
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct > 1 << 20:  # three numbers would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    in_order = windows[order]
    same = in_order[1:] == in_order[:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counter in words.items():
            folded: Counter = Counter()
            for word, n in counter.items():
                folded[_fold(word)] += n
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(folded), pa.string()),
                    "word": pa.array(list(folded), pa.binary()),
                    "n": pa.array(list(folded.values()), pa.int64()),
                }
            )
        words.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            counter = words.setdefault(lang, Counter())
            for word, n in Counter(text.encode(errors="replace").split()).items():
                counter[_key(word)] += n
            classes[lang] = classes.get(lang, 0) + class_counts(text)
            if sum(map(len, words.values())) > HELD:
                yield from flush()
    yield from flush()
    for lang, counts in classes.items():
        yield pa.RecordBatch.from_pydict(
            {
                "lang": [lang] * len(counts),
                "word": pa.array([None] * len(counts), pa.binary()),
                "n": [int(n) * 16 + i for i, n in enumerate(counts)],
            }
        )


@dataclass
class References:
    """Histograms by language, as shares: classes (L x C) and, of the words, the index of each and shares (L x K + 1)."""

    langs: list[str]
    classes: np.ndarray
    index: dict[bytes, int]
    columns: np.ndarray
    words: np.ndarray


def references(docs: DataFrame, common_words: int = COMMON) -> References:
    """Learned from all words of all rows of ``docs`` (lang, text) in which neither is null.

    Of equally frequent words those of least MD5 are taken. The driver receives ``common_words`` words and one class
    histogram for each language label.
    """
    rows = docs.filter("lang is not null and text is not null").select("lang", "text")
    counts = common.arrow_map(rows, _counted, "lang string, word binary, n long")
    # Class counts travel as n * 16 + class, so that one pass over the texts serves both histograms.
    kind = F.when(F.col("word").isNull(), F.col("n") % 16).cast("int")
    n = F.when(F.col("word").isNull(), F.floor(F.col("n") / 16)).otherwise(F.col("n"))
    summed = common.durable(
        counts.select("lang", "word", kind.alias("class"), n.cast("long").alias("n"))
        .groupBy("lang", "word", "class")
        .agg(F.sum("n").alias("n"))
    )
    classes = summed.filter("word is null").collect()
    words = summed.filter("word is not null")
    digest = F.when(F.col("word").startswith(F.lit(b" ")), F.substr("word", F.lit(2)).cast("string")).otherwise(F.md5("word"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "digest")
    ranked = words.filter("length(word) > 0").withColumn("digest", digest).withColumn("rank", F.row_number().over(order))
    top = ranked.filter(F.col("rank") <= common_words).collect()
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({r["lang"] for r in classes})
    by_class = np.zeros((len(langs), len(CLASSES)))
    for r in classes:
        by_class[langs.index(r["lang"]), r["class"]] = r["n"]
    index = {w: i for i, w in enumerate(sorted({bytes(r["word"]) for r in top}))}
    columns = np.full((len(langs), common_words), len(index), np.int64)
    shares = np.zeros((len(langs), common_words + 1))
    for r in top:
        at = langs.index(r["lang"])
        columns[at, r["rank"] - 1] = index[bytes(r["word"])]
        shares[at, r["rank"] - 1] = r["n"] / totals[r["lang"]]
    shares[:, -1] = 1 - shares.sum(1)
    return References(langs, by_class / np.maximum(by_class.sum(1, keepdims=True), 1), index, columns, shares)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2) along the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum(parts.sum(-1) / 2, 0))


def _nearest(text: str, words: Words, refs: References) -> tuple[float, float]:
    """The distances (classes, words) to the language for which their sum is smallest."""
    shares = class_counts(text) / max(1, len(text))
    by_class = distances(shares[None, :], refs.classes)
    seen = np.zeros(len(refs.index) + 1)
    for word, n in zip(words.distinct, words.counts.tolist(), strict=True):
        if (at := refs.index.get(_fold(_key(word)))) is not None:
            seen[at] += n
    total = max(1, words.base[0])
    own = seen[refs.columns] / total
    own = np.concatenate([own, 1 - own.sum(1, keepdims=True)], 1)
    by_word = distances(own, refs.words)
    at = int(np.argmin(by_class + by_word))
    return float(by_class[at]), float(by_word[at])


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, class_distance double, word_distance double"
)
#: The place of ``kept`` among them.
KEPT = 6


def judge(text: str | None, refs: References) -> tuple:
    """The columns of ``SCHEMA`` for one text."""
    words = measure(text or "")
    n_words, _, _, _, repeat = words.base
    failed = n_words < 50 or 100 * repeat > 50 * n_words
    by_class, by_word = _nearest(text or "", words, refs) if refs.langs else (0.0, 0.0)
    near = (len(text or "") < MIN_CHARS or by_class <= MAX_CLASS_DISTANCE) and (
        n_words < MIN_WORDS or by_word <= MAX_WORD_DISTANCE + WORD_NOISE / n_words**0.5
    )
    return *words.base, failed, not failed and near, by_class, by_word


def quality(docs: DataFrame, refs: References | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id and the columns of ``SCHEMA``.

    Defined results: a null or empty text has no words and is not kept; a very long text is judged whole, and so is one
    of a single word; without any language to compare with, the distances are 0 and the base rules decide alone; of
    equally near languages the first by name counts; repeated rows are judged alike, each counted in the references; a
    null doc_id is passed on; an empty table gives an empty result; other columns are ignored.
    """
    found = docs.sparkSession.sparkContext.broadcast(refs or references(docs))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(judge(x, found.value) for x in batch["text"].to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, map(list, columns))], names=["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.arrow_map(rows, judged, f"doc_id long, {SCHEMA}")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, judged against references learned from ``docs``."""
    found = docs.sparkSession.sparkContext.broadcast(references(docs))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge(x, found.value)[KEPT] for x in batch["text"].to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return common.arrow_map(docs, filtered, docs.schema)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality(common.table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, text IS NOT NULL AS has_text, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, lang, has_text, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)
), n AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), v AS (
  SELECT doc_id, i, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), x AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS times FROM v WHERE w3 IS NOT NULL
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM x, range(3) AS s(k) WHERE times > 1 GROUP BY doc_id
), b AS (
  SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) AS chars
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
), g AS (
  SELECT doc_id, lang, has_text, length(t) AS chars, regexp_replace(t, '[\x{10000}-\x{10FFFF}]', '', 'g') AS u FROM d
), h AS (
  SELECT doc_id, lang, has_text, chars, [length(regexp_replace(u, '[^a-z]', '', 'g')), length(regexp_replace(u, '[^A-Z]', '', 'g')),
    length(regexp_replace(u, '[a-zA-Z]|[^\pL\pM]', '', 'g')), length(regexp_replace(u, '[^\p{Nd}]', '', 'g')),
    length(regexp_replace(u, '[^\x09-\x0D\p{Zs}]', '', 'g')), length(regexp_replace(u, '[^.,;:!?''"()\-\p{Pi}\p{Pf}\p{Pd}]', '', 'g')),
    length(regexp_replace(u, '[.,;:!?''"()\-\p{Pi}\p{Pf}\p{Pd}]|[^\pP\pS]', '', 'g'))] AS c FROM g
), k AS (
  SELECT doc_id, lang, has_text, bin, CASE WHEN bin <= 7 THEN c[bin] ELSE chars - list_sum(c) END AS count, greatest(chars, 1) AS chars
  FROM h, range(1, 9) AS s(bin)
), rk AS (
  SELECT lang, bin, sum(count) / greatest(sum(sum(count)) OVER (PARTITION BY lang), 1) AS q FROM k
  WHERE lang IS NOT NULL AND has_text GROUP BY lang, bin
), jk AS (
  SELECT doc_id, rk.lang, count / chars AS p, q, (p + q) / 2 AS m FROM k JOIN rk USING (bin)
), ck AS (
  SELECT doc_id, lang, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2, 0)) AS by_class FROM jk GROUP BY doc_id, lang
), f AS (
  SELECT doc_id, lang, has_text, regexp_replace(lower(word), '^[.,;:!?''"()-]+|[.,;:!?''"()-]+$', '', 'g') AS word FROM w
), fl AS (
  SELECT lang, word, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS total FROM f
  WHERE lang IS NOT NULL AND has_text GROUP BY lang, word
), top AS (
  SELECT lang, word, n / total AS q FROM fl WHERE word != ''
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, md5(word)) <= 100
), fd AS (
  SELECT doc_id, word, count(*) AS n FROM f GROUP BY doc_id, word
), jw AS (
  SELECT b.doc_id, top.lang, coalesce(fd.n, 0) / greatest(n_words, 1) AS p, q FROM b CROSS JOIN top
  LEFT JOIN fd ON fd.doc_id = b.doc_id AND fd.word = top.word
), jo AS (
  SELECT * FROM jw UNION ALL SELECT doc_id, lang, 1 - sum(p), 1 - sum(q) FROM jw GROUP BY doc_id, lang
), cw AS (
  SELECT doc_id, lang, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS by_word FROM jo GROUP BY doc_id, lang
), z AS (
  SELECT b.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, by_class, by_word,
    row_number() OVER (PARTITION BY b.doc_id ORDER BY round(by_class + by_word, 12), lang) AS place
  FROM b JOIN ck USING (doc_id) JOIN cw USING (doc_id, lang)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(by_class, 6) AS class_distance,
  round(by_word, 6) AS word_distance,
  NOT base_failed AND (chars < 200 OR by_class <= 0.28) AND (n_words < 50 OR by_word <= 0.4 + 1.2 / sqrt(n_words)) AS kept
FROM z WHERE place = 1
"""
