"""Near-duplicate documents: DartMinHash signatures, banded joining, exact check, classes.

Elements are five-word shingles, weighted by how often they occur in the text (a text of one to
four words is one shingle). Two texts are linked if their weighted Jaccard similarity is at least
0.8; a class is a connected set of links, and its row with the smallest ``doc_id`` stays.

* Texts with equal shingles are one node, so copies are never paired.
* Signatures are cut into bands; nodes that agree in a band share a bucket. With 32 bands of 6 a
  link at the threshold is missed with a probability of 6 in 100,000.
* In a bucket some nodes are pivots and all others are compared with them: first by the number of
  equal coordinates (four bits of each), which at the threshold lies ``deviations`` (four) above what
  is asked for; then by outlines, bit maps of 2,048 bits of a node's codes: bits set in one of two
  are codes that the other does not hold, and more than a ninth of both sizes rules a link out with
  certainty; then exactly. Nodes already in one class are not compared. Then further nodes are
  pivots, eight times as many each round and those with the most links first, until every pair
  that shares a bucket was compared or is in one class. So no pair is left out, and a large group
  of near copies, which mostly becomes one class at once, takes a few rounds.
* ``deviations=None`` compares without the coordinates, which let 3 in 100,000 pairs at the threshold
  go; then a link is missed only if its nodes share no bucket.

Texts without words (null, empty, only marks) are copies of each other. Equal ``doc_id`` are told
apart by their texts; of fully repeated rows one stays. A null ``doc_id`` sorts last. An empty table
gives an empty result. Columns other than ``doc_id`` and ``text`` are ignored or carried through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowrill.llm.dart_minhash import DartMinHash, mix
from flowrill.llm.frames import discard, fresh, kept, stored
from flowrill.llm.words import words

SHINGLE = 5
BANDS, ROWS = 32, 6
FIRST_PIVOTS, MORE_PIVOTS = 8, 8
OUTLINE_BITS = 2048
BLOCK_SHINGLES = 60_000
KEPT_WORDS = 100_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.arange(1, 65, dtype=np.uint64) * _GOLDEN
_SKETCH = (
    "rid long, doc_id long, text_hash long, copy_key binary, n long, bands array<long>, "
    "signature array<long>, outline array<long>, codes array<int>"
)


class _WordHashes(dict):
    """64-bit hashes of words, kept for the next texts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = number = xxhash.xxh3_64_intdigest(word)
        return number


def shingle_counts(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as 64-bit hashes, and how often each occurs."""
    found = words(text)
    known = kept("word hashes", _WordHashes)
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    if not hashes.size:
        return hashes, np.zeros(0, np.int64)
    size = min(size, hashes.size)
    n = hashes.size - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):  # position matters: each word is scrambled with its place
        total += mix(hashes[i : i + n] + _PLACES[i])
    return np.unique(mix(total), return_counts=True)


def occurrence_codes(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 32-bit code for each occurrence; equal codes of two texts are common occurrences."""
    starts = np.cumsum(counts) - counts
    occurrence = np.arange(int(counts.sum())) - np.repeat(starts, counts)
    codes = mix(np.repeat(elements, counts) + occurrence.astype(np.uint64) * _GOLDEN)
    return codes.astype(np.uint32).view(np.int32)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A bucket number for each band of each signature."""
    parts = signatures.reshape(-1, bands, rows) + np.arange(1, rows + 1, dtype=np.uint64) * _GOLDEN
    return mix(mix(parts).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def packed_signatures(signatures: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate. For every 64 coordinates there are four numbers, one for each
    of the bits."""
    n, k = signatures.shape
    padded = np.zeros((n, -(-k // 64) * 64), np.uint64)
    padded[:, :k] = mix(signatures)
    groups = padded.reshape(n, -1, 64)
    planes = [
        np.packbits(((groups >> np.uint64(bit)) & np.uint64(1)).astype(bool), axis=2, bitorder="little").view("<i8")
        for bit in range(4)
    ]
    return np.concatenate(planes, axis=2).reshape(n, -1)


def outlines(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bit map of the codes of each of several sets, given one after the other."""
    bits = np.zeros((len(sizes), OUTLINE_BITS), bool)
    bits[np.repeat(np.arange(len(sizes)), sizes), codes.view(np.uint32) % OUTLINE_BITS] = True
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def unequal_bits(a: str, b: str) -> Column:
    """How many bits of two outlines differ: at most as many as codes that one of both lacks."""
    differing = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(OUTLINE_BITS // 64)]
    return reduce(Column.__add__, differing)


def unequal_coordinates(a: str, b: str, coordinates: int) -> Column:
    """How many coordinates of two packed signatures differ."""
    total = F.lit(0)
    for first in range(0, -(-coordinates // 64) * 4, 4):
        planes = [F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) for i in range(first, first + 4)]
        total = total + F.bit_count(reduce(Column.bitwiseOR, planes))
    return total


def least_equal(coordinates: int, similarity: float = 0.8, deviations: float = 4.0) -> int:
    """Equal coordinates that a pair at the threshold has but for so many deviations."""
    p = similarity + (1 - similarity) / 16  # a sixteenth of the others agree by chance
    return math.floor(coordinates * p - deviations * math.sqrt(coordinates * p * (1 - p)))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row its copy key, bands and occurrence codes; ``rid`` numbers the rows once stored."""

    def lists(rows: np.ndarray, kept: np.ndarray, kind: pa.DataType) -> pa.Array:
        """Rows of equal length as lists; empty where ``kept`` is false."""
        ends = np.cumsum(np.where(kept, rows.shape[1], 0))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(rows[kept].ravel(), kind))

    def signed(ids: list[pa.Array], sets: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        elements, counts = (np.concatenate(part) for part in zip(*sets))
        sizes = np.array([len(e) for e, _ in sets])
        totals = np.array([int(c.sum()) for _, c in sets])
        keys = [xxhash.xxh3_128_digest(e.tobytes() + c.astype("<i8").tobytes()) for e, c in sets]
        signatures = dart.signatures(elements, counts.astype(float), sizes)
        codes = occurrence_codes(elements, counts)
        kept = sizes > 0
        return pa.RecordBatch.from_arrays(
            [
                *ids, pa.array(keys, pa.binary()), pa.array(totals, pa.int64()),
                lists(band_hashes(signatures, bands, rows), kept, pa.int64()),
                lists(packed_signatures(signatures), kept, pa.int64()),
                lists(outlines(codes, totals), kept, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(totals)]), pa.int32()), pa.array(codes, pa.int32())),
            ],
            names=["rid", "doc_id", "text_hash", "copy_key", "n", "bands", "signature", "outline", "codes"],
        )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, sets = 0, 0, []
            for i, scalar in enumerate(batch.column(3)):
                sets.append(shingle_counts(scalar.as_py()))
                held += len(sets[-1][0])
                if held >= BLOCK_SHINGLES or i + 1 == batch.num_rows:
                    yield signed([batch.column(c).slice(first, len(sets)) for c in range(3)], sets)
                    first, held, sets = i + 1, 0, []

    dart = DartMinHash(bands * rows)
    return docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"),
        F.xxhash64("text").alias("text_hash"), "text",
    ).mapInArrow(sketch, _SKETCH)


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """Edges ``u > v`` to stars: one edge from each connected node to the smallest; stored, with
    its path.

    Alternates large-star and small-star steps: every step hangs neighbours on the smallest node
    they know, edges only shrink, and minima are combined before the exchange.
    """

    def smallest(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def are_stars(edges: DataFrame) -> bool:
        """Whether every node is either a centre or hangs on one node."""
        ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))))
        roles = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("centre"))
        return roles.where("out > 1 or (out = 1 and centre = 0)").isEmpty()

    path = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        low = large.where("u > v")
        small = (
            low.join(smallest(low), "u")
            .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
            .where("u > v").distinct()
        )
        old, (edges, path) = path, stored(small, "stars")
        if old is not None:
            discard(old)
        if are_stars(edges):
            return edges, path


def in_open_bands(members: DataFrame) -> DataFrame:
    """The members of bands that hold more than one component."""
    is_open = members.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return members.join(is_open.select("band"), "band", "left_semi")


def bucket_components(
    buckets: DataFrame, codes: DataFrame, coordinates: int, deviations: float | None = 4.0
) -> tuple[DataFrame, str]:
    """``node, comp`` for nodes linked to others that share a bucket with them; stored, with its
    path. ``comp`` is the smallest node connected.

    ``buckets`` has ``band, band_no, node, n, signature, outline, bands``, ``codes`` has ``node, codes``. A
    pair is compared in the first band that both share, and in no other.
    """
    same = F.zip_with("bands", "pivot_bands", lambda a, b: a == b)
    first_shared = F.array_position(same, F.lit(True)) == F.col("band_no") + 1
    own = ["band", "band_no", "node", "n", "signature", "outline", "bands"]
    alike = 9 * unequal_bits("outline", "pivot_outline") <= F.col("n") + F.col("pivot_n")
    if deviations is not None:
        unequal = unequal_coordinates("signature", "pivot_signature", coordinates)
        alike = (unequal <= coordinates - least_equal(coordinates, deviations=deviations)) & alike
    members = buckets.withColumn("comp", F.col("node")).withColumn("degree", F.lit(0).cast("long"))
    links, stars, stars_path, loose = None, None, None, []
    n_pivots = FIRST_PIVOTS
    while True:
        order = [F.col("degree").desc(), F.xxhash64("node"), "node"]
        pivots = (
            members.withColumn("place", F.row_number().over(Window.partitionBy("band").orderBy(*order)))
            .where(F.col("place") <= n_pivots)
            .select("band", F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("comp").alias("pivot_comp"), F.col("signature").alias("pivot_signature"), F.col("outline").alias("pivot_outline"), F.col("bands").alias("pivot_bands"))
        )
        pivots, pivots_path = stored(pivots, "pivots")
        loose.append(pivots_path)
        pairs = (
            members.join(pivots, "band")
            .where("comp <> pivot_comp and 5 * least(n, pivot_n) >= 4 * greatest(n, pivot_n)").where(alike).where(first_shared)
            .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
            .distinct()
        )
        common = F.size(F.array_intersect("codes_a", "codes_b"))
        both = F.size("codes_a") + F.size("codes_b")
        new = (
            pairs.join(codes.select(F.col("node").alias("a"), F.col("codes").alias("codes_a")), "a")
            .join(codes.select(F.col("node").alias("b"), F.col("codes").alias("codes_b")), "b")
            .where(9 * common >= 4 * both)  # 0.8 * (both - common) <= common
            .select("a", "b")
        )
        new, path = stored(new, "links")
        loose.append(path)
        links = new if links is None else links.union(new)
        edges = new.select(F.col("b").alias("u"), F.col("a").alias("v"))
        if stars is None or not new.isEmpty():
            old = stars_path
            stars, stars_path = components(edges if stars is None else stars.union(edges))
            if old:
                discard(old)
        comps = stars.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        rest, rest_path = stored(
            members.join(pivots.select("band", F.col("pivot").alias("node")), ["band", "node"], "left_anti")
            .select(*own),
            "members",
        )
        loose.append(rest_path)
        if rest.isEmpty():
            break
        degrees = (
            links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        )
        labelled = (
            rest.join(comps, "node", "left").join(degrees, "node", "left")
            .select(*own, F.coalesce("comp", "node").alias("comp"), F.coalesce("degree", F.lit(0)).alias("degree"))
        )
        members, members_path = stored(in_open_bands(labelled), "members")
        loose.append(members_path)
        if members.isEmpty():
            break
        n_pivots *= MORE_PIVOTS
    discard(*loose)
    return comps, stars_path


def near_classes(
    docs: DataFrame, bands: int = BANDS, rows: int = ROWS, deviations: float | None = 4.0
) -> DataFrame:
    """Per row ``doc_id, text_hash, class_id, class_size, keep``.

    ``class_id`` is the smallest ``doc_id`` of the row's class; ``keep`` holds for one row of each.
    The result is stored; tables on the way there are deleted.
    """
    sketch, sketch_path = stored(sketches(docs, bands, rows), "sketches")
    copies = (
        sketch.groupBy("copy_key").agg(F.min("rid").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1").select("copy_key", "first")
    )
    nodes, nodes_path = stored(
        sketch.select("rid", "doc_id", "text_hash", "copy_key", "n", "bands")
        .join(copies, "copy_key", "left")
        .withColumn("node", F.coalesce("first", "rid"))
        .select("rid", "doc_id", "text_hash", "node", "n", F.when(F.col("rid") == F.col("node"), F.col("bands")).alias("bands")),
        "nodes",
    )
    banded = nodes.select(F.posexplode("bands").alias("band_no", "band"), "node", "n")
    shared = banded.groupBy("band").agg(F.count("*").alias("in_band")).where("in_band > 1").select("band")
    places, places_path = stored(banded.join(shared, "band"), "places")
    details, details_path = stored(
        sketch.select(F.col("rid").alias("node"), "bands", "signature", "outline", "codes")
        .join(places.select("node").distinct(), "node", "left_semi"),
        "details",
    )
    discard(sketch_path)
    # 31 bits of a band tell bands of the same number apart well enough; they travel with the members.
    short = F.transform("bands", lambda band: band.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("bands")
    buckets, buckets_path = stored(places.join(details.select("node", "signature", "outline", short), "node"), "buckets")
    discard(places_path)
    comps, stars_path = bucket_components(buckets, details.select("node", "codes"), bands * rows, deviations)
    discard(buckets_path, details_path)

    own = F.coalesce("comp", "node")
    placed = nodes.join(comps, "node", "left").select("rid", "doc_id", "text_hash", own.alias("class"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "rid"))
    classes = (
        placed.groupBy("class").agg(first.alias("first"), F.count("*").alias("class_size"))
        .where("class_size > 1")
        .select("class", F.col("first.doc_id").alias("class_id"), F.col("first.rid").alias("stays"), "class_size")
    )
    result, _ = stored(
        placed.join(classes, "class", "left").select(
            "doc_id", "text_hash",
            F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
            F.coalesce(F.col("stays") == F.col("rid"), F.lit(True)).alias("keep"),
        ),
        "classes",
    )
    discard(nodes_path, stars_path)
    return result


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, all columns unchanged.

    Rows are found again by ``doc_id`` and text hash; only rows that go are on the other side of
    that join. Where a row that stays occurs several times, one of them is taken.
    """
    classes = near_classes(docs, **options)
    decided = classes.groupBy("doc_id", "text_hash").agg(
        F.max("keep").alias("keep"), F.count("*").alias("times")
    ).where("not keep or times > 1")
    key, hashed, keep, times = (fresh(docs, n) for n in ("key", "text_hash", "keep", "times"))
    decided, _ = stored(
        decided.select(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed), F.col("keep").alias(keep)), "decided"
    )
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(hashed))
    # What goes grows with the documents, so the plan is one that fits any size of it.
    stay = docs.join(decided.hint("merge"), same, "left_anti")
    repeated = decided.where(F.col(keep))
    if repeated.isEmpty():
        return stay
    once = docs.join(repeated, same).dropDuplicates([key, hashed]).select(*[docs[c] for c in docs.columns])
    return stay.unionByName(once)
