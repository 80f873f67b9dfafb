"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are which of ``2**BITS`` places its words, pairs of neighbours and pairs with one word between hash to.
The learner keeps per-coordinate sums of gradients and of their squares, so every weight has its own rate, and the L1
term leaves most weights at exactly zero: only the others are broadcast to score all texts.

Learning is sequential and runs in one task over a bounded sample: the ``MAX_TRAINING`` labelled documents of least id
hash, and of these as many, in the same order, as have ``MAX_PLACES`` features together. The sample is the same for any
partitioning. All texts are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 20
#: Documents that the model learns from, at most, and their distinct features (of four bytes each), summed.
MAX_TRAINING, MAX_PLACES = 6000, 48_000_000
#: The learner's rate, its smoothing, both penalties, and how often it sees the sample.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 20.0, 0.1, 5
#: How much more an example of label 1 counts than one of label 0, which is far commoner.
POSITIVE = 3.0
#: Characters that don't belong to a word.
STOPS = b".,;:!?\"()[]{}"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIRST, _NEXT, _SKIP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The hashed words, pairs of neighbours and pairs with one word between, in order and with repeats."""
    words = (text or "").lower().encode(errors="replace").translate(None, STOPS).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        first = h * _FIRST
        parts = [first, first[:-1] + h[1:] * _NEXT + np.uint64(1), first[:-2] + h[2:] * _SKIP + np.uint64(2)]
        mixed = np.concatenate(parts)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    return (mixed >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Weights:
    """The weights that aren't zero, by place, and the bias."""

    places: np.ndarray
    values: np.ndarray
    bias: float

    def dense(self, bits: int = BITS) -> np.ndarray:
        out = np.zeros(1 << bits, np.float32)
        out[self.places] = self.values
        return out


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """FTRL-proximal for examples of which each has some places at 1; the bias is one more place without penalties."""

    def __init__(
        self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, positive: float = POSITIVE
    ):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2, self.positive = alpha, beta, l1, l2, positive

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        out = np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)
        return np.where(at == len(self.z) - 1, -z / rate, out)

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, len(self.z) - 1)
        w = self.weights(at)
        gradient = (sigmoid(w.sum()) - label) * (self.positive if label else 1.0)
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + gradient**2

    def result(self) -> Weights:
        w = self.weights(np.arange(len(self.z)))
        places = np.flatnonzero(w[:-1])
        return Weights(places.astype(np.int32), w[places], float(w[-1]))


def _sampled(labels: DataFrame, held_out: Column, most: int) -> DataFrame:
    """(doc_id, toxic) of at most ``most`` labelled documents that aren't held out; conflicting labels count as toxic."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    return usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, weight) learned from rows (doc_id, toxic, places) in the sample's order; the bias has place -1."""
    examples, room = [], MAX_PLACES
    for batch in batches:
        for doc, label, places in zip(*(batch[c].to_pylist() for c in ("doc_id", "toxic", "places")), strict=True):
            room -= len(places) // 4
            if room < 0:
                break
            examples.append((doc, places, label))
    examples.sort(key=lambda x: (zlib.crc32(str(x[0]).encode()), x))
    model = Ftrl()
    for _ in range(PASSES):
        for _, places, label in examples:
            model.learn(np.frombuffer(places, np.int32), label)
    found = model.result()
    places = np.append(found.places, -1).astype(np.int32)
    yield pa.RecordBatch.from_pydict({"place": places, "weight": np.append(found.values, found.bias)})


def train(docs: DataFrame, labels: DataFrame, held_out: Column, most: int = MAX_TRAINING) -> Weights:
    """Weights from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), without the ids for which ``held_out``.

    An id is one example: of several texts, that whose features come first as bytes.
    """
    sample = F.broadcast(_sampled(labels, held_out, most))  # of at most ``most`` rows of two numbers
    rows = docs.join(sample, "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.unique(features(x)).tobytes() for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["toxic"], pa.array(places, pa.binary())], names=["doc_id", "toxic", "places"]
            )

    hashes = common.arrow_map(rows, hashed, "doc_id long, toxic int, places binary")
    examples = hashes.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("places").alias("places"))
    in_order = examples.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = common.arrow_map(in_order, _learned, "place int, weight double").toPandas()
    if found.empty:  # nothing to learn from
        return Weights(np.empty(0, np.int32), np.empty(0), 0.0)
    own = found["place"] >= 0
    bias = float(found.loc[~own, "weight"].iloc[0])
    return Weights(found.loc[own, "place"].to_numpy(), found.loc[own, "weight"].to_numpy(), bias)


def scored(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text): the probability of the label 1.

    Defined results: a null or empty text has no features and gets the bias alone; a very long text is scored whole;
    repeated rows get equal scores, and without anything to learn from all get 0.5, which counts as toxic; a null doc_id is passed on; an empty table gives an empty result; other columns are ignored.
    """
    found = docs.sparkSession.sparkContext.broadcast(weights)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, bias = found.value.dense(), found.value.bias
        for batch in batches:
            scores = []
            for text in batch["text"].to_pylist():
                places = features(text)
                places = np.unique(places[dense[places] != 0])
                scores.append(float(sigmoid(bias + float(dense[places].sum(dtype=np.float64)))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.arrow_map(rows, judged, "doc_id long, score double")


def op6_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    labels = common.table(spark, sf_dir, "labels", "doc_id", "toxic")
    weights = train(docs, labels, op6_held_out(F.col("doc_id")))
    return scored(docs, weights).select(
        "doc_id",
        F.coalesce(op6_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
