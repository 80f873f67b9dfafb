"""MinHash near-de-duplication: universal hash minima, banding, signature verification, exact confirmation, components.

1. One pass over the texts makes, of each document's shingle set, a 128-bit digest and a signature: the minima of
   ``HASHES`` universal hashes, eight bits of each.
2. Documents with equal sets form a class; its smallest id represents it from here on. An id whose rows have different
   texts stands for several classes, and links them.
3. Bands of the signature are bucketed. Buckets of one are dropped; in every other, the member of smallest id is the
   pivot, and all members are compared with it: first signatures, then whole sets. So a bucket makes as many pairs as it
   has members. Only the texts of documents in such pairs are read again, found by a Bloom filter of bounded size.
4. Components of the confirmed links. A bucket whose members are now all in one component needs no more work.
5. What remains, pairs of one bucket in different components, is tested in cells: the probes, which are the members
   outside the bucket's largest component, against all members. A first pass has signatures only and finds the members
   that have a partner by these; the second has the sets of those members. Only links come out, each pair is tested in
   its first common bucket. No bucket is capped: probes and members are cut into blocks of bounded rows and bytes, a cell
   has one of each.

The widest bands are taken for which a pair exactly at the threshold shares no bucket with a probability of at most
``MISS``; a pair's signatures are rejected only ``SIGMAS`` standard deviations below the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom, common
from .components import components
from .shingles import shingle_set

#: Universal hashes of a signature, at most.
HASHES = 200
MISS = 1e-6
SIGMAS = 5.0
#: Defaults of the operator: words of a shingle, and the similarity of a link in hundredths.
WORDS, PERCENT = 5, 80
#: Rows, and bytes of sets and signatures, in a block of a heavy bucket.
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
#: Bands at most, a power of two: a bucket's key has the band in as many bits.
BANDS = 256
#: Shingles hashed at a time, so that the products stay in the processor's cache.
TILE = 256


@dataclass(frozen=True)
class Plan:
    """What is derived from the similarity of a link."""

    words: int
    percent: int
    rows: int
    bands: int

    @property
    def hashes(self) -> int:
        return self.rows * self.bands

    @property
    def least_equal(self) -> int:
        """Equal places that the signatures of a link have, but for a negligible chance."""
        s = self.percent / 100
        return int(np.floor(self.hashes * s - SIGMAS * np.sqrt(self.hashes * s * (1 - s))))


def plan(words: int = WORDS, percent: int = PERCENT, hashes: int = HASHES, miss: float = MISS) -> Plan:
    s = percent / 100
    rows = max([r for r in range(1, 33) if (1 - s**r) ** (hashes // r) <= miss], default=1)
    return Plan(words, percent, rows, hashes // rows)


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``n`` multiply-add hashes modulo 2**64."""
    rng = np.random.Generator(np.random.PCG64(20_240_229))
    a, b = rng.integers(0, 2**64, (2, n), np.uint64)
    return a | np.uint64(1), b


def digest_of(shingles: np.ndarray) -> bytes | None:
    """128 bits of a whole set; None of an empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """Eight bits of the minimum of each hash over a set that isn't empty."""
    least = np.full(len(a), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), TILE):
            products = a[:, None] * shingles[None, at : at + TILE]
            products += b[:, None]
            np.minimum(least, products.min(axis=1), out=least)
    return (least >> np.uint64(24)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, p: Plan) -> DataFrame:
    """(doc_id, n_shingles, digest, signature) of ``docs`` (doc_id, text); no digest or signature of an empty set."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hash_family(p.hashes)
        for batch in batches:
            sizes, digests, signs = [], [], []
            for text in batch["text"].to_pylist():
                found = shingle_set(text, p.words)
                sizes.append(len(found))
                digests.append(digest_of(found))
                signs.append(signature(found, a, b) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.arrow_map(rows, signed, "doc_id long, n_shingles long, digest binary, signature binary")


def _buckets(classes: DataFrame, p: Plan) -> DataFrame:
    """(key, rep, digest, pivot, members) of the members of buckets with two or more. The last bits of a key are its band."""
    band = F.explode(F.sequence(F.lit(0), F.lit(p.bands - 1))).alias("band")
    place = F.substr("signature", F.col("band") * p.rows + 1, F.lit(p.rows))
    key = F.xxhash64(place).bitwiseAND(F.lit(~(BANDS - 1))).bitwiseOR(F.col("band").cast("long"))
    keyed = classes.select("rep", "digest", "signature", band).select("rep", "digest", key.alias("key"))
    shared = common.durable(
        keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("pivot")).filter("members > 1")
    )
    # Most members are alone in a bucket: hardly any of these meets the others in the join.
    may = bloom.possible(shared, "key", shared.count())
    return common.durable(keyed.filter(may(F.col("key"))).join(shared, "key"))


def _sets(docs: DataFrame, wanted: DataFrame, p: Plan, repeats: bool) -> DataFrame:
    """(rep, digest, shingles), kept, of the documents in ``wanted`` (doc_id, kept)."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, p.words) for x in batch["text"].to_pylist()]
            digests = pa.array([digest_of(x) for x in sets], pa.binary())
            shingles = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], digests, shingles], names=["rep", "digest", "shingles"])

    rows = common.with_ids(docs, wanted).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = common.arrow_map(rows, shingled, "rep long, digest binary, shingles array<long>").filter("digest is not null")
    return common.durable(found.dropDuplicates(["rep", "digest"]) if repeats else found)


def _sides(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with ``column`` of both sides as ``a_`` and ``b_`` + column."""
    a = table.select(F.col("rep").alias("a"), F.col(column).alias(f"a_{column}"))
    b = table.select(F.col("rep").alias("b"), F.col(column).alias(f"b_{column}"))
    return pairs.join(a, "a").join(b, "b")


def _alike(pairs: DataFrame, classes: DataFrame, p: Plan) -> DataFrame:
    """The ``pairs`` (a, b) whose signatures don't rule out a link."""
    least = p.least_equal

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8) for c in ("a_signature", "b_signature")]
            equal = (sides[0] == sides[1]).reshape(batch.num_rows, p.hashes).sum(1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(equal))

    return common.arrow_map(_sides(pairs, classes, "signature"), compared, "a long, b long", 16 * common.ROWS)


def _confirmed(pairs: DataFrame, sets: DataFrame, p: Plan) -> DataFrame:
    """The ``pairs`` (a, b) that are links by their whole sets."""
    both = F.size(F.array_intersect("a_shingles", "b_shingles"))
    either = F.size("a_shingles") + F.size("b_shingles") - both
    return _sides(pairs, sets, "shingles").filter(both * 100 >= either * p.percent).select("a", "b")


def _partners(p: Plan, cell: Cell, x: int) -> np.ndarray:
    """The targets of a cell that may be linked with probe ``x``: by their signatures, in no earlier bucket."""
    rep, comp = cell.rep, cell.comp
    others = cell.targets & (comp != comp[x]) & ((comp == cell.major) | (rep > rep[x]))
    others = np.flatnonzero(others)
    equal = cell.signs[others] == cell.signs[x]
    near = equal.sum(1) >= p.least_equal
    others, equal = others[near], equal[near]
    return others[equal.reshape(len(others), p.bands, p.rows).all(2).argmax(1) == cell.band]


@dataclass
class Cell:
    """A block of probes and a block of targets of one bucket; ``sets`` are missing in the first pass."""

    rep: np.ndarray
    comp: np.ndarray
    targets: np.ndarray
    signs: np.ndarray
    band: int
    major: int
    sets: list[np.ndarray] | None = None

    @classmethod
    def of(cls, p: Plan, group: pa.Table) -> Cell:
        signs = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint8).reshape(group.num_rows, p.hashes)
        rep, comp, target = (group[c].to_numpy() for c in ("rep", "component", "target"))
        sets = [x.values.to_numpy() for x in group["shingles"]] if "shingles" in group.column_names else None
        return cls(rep, comp, target, signs, group["key"][0].as_py() & (BANDS - 1), group["major"][0].as_py(), sets)


def has_partner(p: Plan, cell: Cell) -> np.ndarray:
    """Which rows of a cell are in a pair that the signatures don't rule out."""
    out = np.zeros(len(cell.rep), bool)
    for x in np.flatnonzero(~cell.targets):
        found = _partners(p, cell, x)
        out[found] = True
        out[x] = len(found) > 0
    return out


def cross_links(p: Plan, cell: Cell) -> list[tuple[int, int]]:
    """Links between components among the probes and targets of a cell, by their whole sets.

    Enough of them to join what belongs together: once two components are linked, their other pairs are passed over.
    """
    parent: dict[int, int] = {int(c): int(c) for c in cell.comp}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    for x in np.flatnonzero(~cell.targets):
        for y in _partners(p, cell, x):
            mine, other = root(int(cell.comp[x])), root(int(cell.comp[y]))
            if mine == other:
                continue
            both = len(np.intersect1d(cell.sets[x], cell.sets[y], assume_unique=True))
            if 100 * both >= p.percent * (len(cell.sets[x]) + len(cell.sets[y]) - both):
                links.append((int(cell.rep[x]), int(cell.rep[y])))
                parent[mine] = other
    return links


CELL = ["key", "t_block", "p_block"]


def _dealt(members: DataFrame, size: Column) -> DataFrame:
    """The rows of cells: ``members`` (key, rep, digest, component, major, ...) as probes and as targets.

    Targets are cut into blocks by the hash of their id, probes too; every probe block meets every target block. ``size``
    is the bytes that a member brings to a cell.
    """
    probe = (F.col("component") != F.col("major")).cast("int")
    blocks = members.groupBy("key").agg(_blocks(F.lit(1), size).alias("t_blocks"), _blocks(probe, size * probe).alias("p_blocks"))
    # Kept, so that the join is one of two tables, which can split a heavy bucket.
    rows = members.join(common.durable(blocks.filter("p_blocks > 0")), "key")

    def side(own: str, other: str, target: bool, source: DataFrame) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        block = F.pmod(F.xxhash64("rep", "digest"), F.col(f"{own}_blocks")).cast("int").alias(f"{own}_block")
        return source.select(*members.columns, F.lit(target).alias("target"), block, each)

    # Dealt by cell: tables that are dealt by key already would leave all cells of a bucket to one task.
    return side("t", "p", True, rows).unionByName(side("p", "t", False, rows.filter("component != major"))).repartition(*CELL)


def _blocks(rows: Column, size: Column) -> Column:
    return F.ceil(F.greatest(F.sum(rows) / BLOCK_ROWS, F.sum(size) / BLOCK_BYTES)).cast("int")


def _residual_links(docs: DataFrame, buckets: DataFrame, classes: DataFrame, comps: DataFrame, p: Plan, repeats: bool) -> DataFrame:
    """(a, b): links between members of one bucket that ``comps`` (node, component) has apart."""
    node = comps.select(F.col("node").alias("rep"), "component")
    labelled = buckets.filter("members > 2").select("key", "rep", "digest").join(node, "rep", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "rep"))
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    split = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component"))["component"].alias("major"))
    open_ = labelled.join(common.durable(split.filter("parts > 1").select("key", "major")), "key")
    # Signatures first: most members have no partner left.
    members = common.durable(open_.join(classes.select("rep", "digest", "n", "signature"), ["rep", "digest"]))

    def marked(group: pa.Table) -> pa.Table:
        found = has_partner(p, Cell.of(p, group))
        return group.select(["key", "rep", "digest"]).filter(pa.array(found))

    left = _dealt(members, F.lit(p.hashes + 64)).groupBy(*CELL).applyInArrow(marked, "key long, rep long, digest binary").distinct()
    near = common.durable(members.join(left, ["key", "rep", "digest"], "left_semi"))
    sets = _sets(docs, common.durable(near.select("rep").distinct()), p, repeats)
    whole = _dealt(near, F.col("n") * 8 + p.hashes + 64).join(sets, ["rep", "digest"])

    def tested(group: pa.Table) -> pa.Table:
        links = cross_links(p, Cell.of(p, group))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return whole.groupBy(*CELL).applyInArrow(tested, "a long, b long")


def _same_document(full: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """(a, b): a repeated id and the representative of each of its sets."""
    several = full.join(repeated, "doc_id", "left_semi").select("doc_id", "digest").distinct()
    found = several.join(classes.select("digest", "rep"), "digest")
    return found.filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked whose sets of ``words``-word shingles have a Jaccard similarity of ``percent``/100 or more;
    component_id is the smallest doc_id that links reach. Defined results: null and blank texts have no shingles and no
    links; a text of fewer words is one shingle; very long texts are compared whole; rows without doc_id stay alone
    (component_id null, kept); rows that repeat a doc_id are one node, linked by any of its texts, and have its component;
    an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    signed = common.durable(signatures(docs, plan(words, percent)))
    return _linked(docs, signed, common.repeated_ids(signed), plan(words, percent))


def _linked(docs: DataFrame, signed: DataFrame, repeated: DataFrame, p: Plan) -> DataFrame:
    full = signed.filter("doc_id is not null and digest is not null")
    classes = common.durable(
        full.groupBy("digest").agg(
            F.min_by("signature", "doc_id").alias("signature"), F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")
        )
    )
    repeats = not repeated.isEmpty()
    buckets = _buckets(classes, p)
    stars = buckets.filter("pivot != rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    alike = common.durable(_alike(stars, classes, p).distinct())
    wanted = common.durable(alike.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    links = _confirmed(alike, _sets(docs, wanted, p, repeats), p)
    if repeats:
        links = links.unionByName(_same_document(full, classes, repeated))
    links = common.durable(links)
    comps = common.durable(components(links))
    more = common.durable(_residual_links(docs, buckets, classes, comps, p, repeats))
    if not more.isEmpty():
        comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    comps = common.durable(comps)
    linked = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    found = linked.select("digest", "rep", F.coalesce("component", "rep").alias("class_component"))
    # Most documents are alone in their class and component: these need no join.
    sizes = full.groupBy("digest").agg(F.count("*").alias("copies"))
    found = found.join(sizes.filter("copies > 1").select("digest", "copies"), "digest", "left")
    found = found.filter("copies is not null or class_component != rep").select("digest", "class_component")
    apart = signed.filter("digest is null")
    if repeats:  # a blank text whose id has others
        own = comps.select(F.col("node").alias("doc_id"), F.col("component").alias("class_component"))
        apart = apart.join(own, "doc_id", "left")
    else:
        apart = apart.withColumn("class_component", F.lit(None).cast("long"))
    joined = signed.filter("digest is not null").join(found, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return joined.unionByName(apart).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each component, and rows without id.

    Of several rows with the doc_id that stays, the one of least text stays (null before all others).
    """
    plain = docs.select("doc_id", "text")
    signed = common.durable(signatures(plain, plan(words, percent)))
    repeated = common.repeated_ids(signed)
    found = _linked(plain, signed, repeated, plan(words, percent))
    one = common.without_ids(docs, common.durable(found.filter("not kept").select("doc_id").distinct()))
    if repeated.isEmpty():
        return one
    rows = common.with_ids(one, repeated).groupBy("doc_id")
    first = rows.agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text"))).alias("__row")).select("__row.*")
    return common.without_ids(one, repeated).unionByName(first)


#: What the query's contract asks for.
OP1_WORDS, OP1_PERCENT = 3, 85


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents", "doc_id", "text"), OP1_WORDS, OP1_PERCENT)


#: All pairs that share a shingle: exact, and quadratic in the documents that share one.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2]))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS shingle FROM w
), n AS (
  SELECT documents.doc_id, count(shingle) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY documents.doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)
), r AS (
  SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x
)
SELECT n.doc_id, n.n AS n_shingles, min(reached) AS component_id, n.doc_id = min(reached) AS kept
FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""
