"""Ranked lexical search: range-maximum sparse tables on posting lists, best-first intervals.

:func:`build_index` cuts the documents into blocks and stores a block's posting lists; every
document and every term is indexed. :func:`search` weighs the postings of the queries' terms with
their impacts, the parts they add to a score. On each list a sparse table answers range maxima. A
query starts with the interval of all documents of a block, bounded by the sum of its terms'
maxima. The interval of the highest bound is split at the document of its greatest impact: that
document is scored, and the two rests are bounded again. The search of a block ends when no
interval can hold a better document than the k found, so its k best are exact, and so are the k
best of all blocks. Before, the documents at the maxima of whole lists are scored: the k-th best of
them in all blocks is a floor, and intervals bounded below it are not opened.

A block holds at most ``BLOCK_CHARS`` characters of text or ``BLOCK_DOCS`` documents (one longer
document is a block of its own), so a task holds the lists of one block at a time. Queries are
searched in batches. Nothing is broadcast and nothing passes the driver but four numbers.

A term is a word (:mod:`flowrill.llm.words`). Null and empty texts have none and are never found. A
query counts each term once; rows that share an ``item_id`` are one query. Equal scores are in
ascending order of ``doc_id``, null last. Each row is a document of its own, also if it repeats
another. An empty table, or queries without terms, give an empty result. Columns other than
``doc_id, text`` and ``item_id, text`` are not read.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowrill.llm.frames import stored
from flowrill.llm.words import word_array, words

BLOCK_CHARS, BLOCK_DOCS = 1 << 25, 1 << 20
BATCH_ITEMS = 256
SLICE = 50_000
_POSTINGS = "block string, term string, docs array<int>, tfs array<int>, ids array<long>, lengths array<long>"


class _Terms(dict):
    """Numbers terms in the order they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


class _Block:
    """Postings of the documents of one block."""

    def __init__(self) -> None:
        self.numbers, self.terms, self.places, self.tfs = _Terms(), array("i"), array("i"), array("i")
        self.ids, self.lengths, self.chars = [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        found = words(text)
        times = Counter(found)
        self.terms.extend(map(self.numbers.__getitem__, times))
        self.tfs.extend(times.values())
        self.places.extend(repeat(len(self.ids), len(times)))
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.chars += len(text or "")

    def batches(self, name: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row with the documents in order of their ids, then a row for each term."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        head = {
            "block": [name], "term": [None], "docs": [None], "tfs": [None],
            "ids": [[self.ids[i] for i in order]], "lengths": [[self.lengths[i] for i in order]],
        }
        yield pa.RecordBatch.from_pydict(head, schema)
        if not self.terms:
            return
        terms, docs = np.frombuffer(self.terms, np.int32), place[np.frombuffer(self.places, np.int32)]
        by_term = np.lexsort((docs, terms))
        ends = np.cumsum(np.bincount(terms, minlength=len(self.numbers))).astype(np.int32)
        offsets = pa.array(np.concatenate([np.zeros(1, np.int32), ends]))
        none = pa.nulls(len(self.numbers), pa.list_(pa.int64()))
        rows = pa.RecordBatch.from_arrays(
            [
                pa.array([name]).take(pa.array(np.zeros(len(self.numbers), np.int32))),
                pa.array(list(self.numbers), pa.binary()).cast(pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(docs[by_term])),
                pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(self.tfs, np.int32)[by_term])),
                none, none,
            ],
            schema=schema,
        )
        for start in range(0, rows.num_rows, SLICE):
            yield rows.slice(start, SLICE)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index: per block a row of its documents (no ``term``) and a row for each term."""
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    schema = pa.schema(
        [("block", pa.string()), ("term", pa.string()), ("docs", ints), ("tfs", ints), ("ids", longs), ("lengths", longs)]
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                block.add(doc_id.as_py(), text.as_py())
                if block.chars >= BLOCK_CHARS or len(block.ids) >= BLOCK_DOCS:
                    yield from block.batches(f"{part}-{number}", schema)
                    number, block = number + 1, _Block()
        if block.ids:
            yield from block.batches(f"{part}-{number}", schema)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(plain.mapInArrow(index, _POSTINGS), "lexical-index", "zstd")[0]


def _packed(numbers: np.ndarray) -> array:
    """Eight bytes a number, and plain integers on access."""
    out = array("q")
    out.frombytes(numbers.astype(np.int64).tobytes())
    return out


def sparse_table(impacts: np.ndarray) -> list[array]:
    """Level j holds the maxima of 2^j neighbours, each with its place: equal ones, the first."""
    n = len(impacts)
    level = (impacts << np.int64(23)) + (n - 1 - np.arange(n, dtype=np.int64))
    levels, width = [_packed(level)], 1
    while 2 * width <= n:
        level = np.maximum(level[:-width], level[width:])
        levels.append(_packed(level))
        width *= 2
    return levels


class PostingList:
    """Documents of one term in order, their impacts and the range maxima of these."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray) -> None:
        self.docs, self.impacts = _packed(docs), _packed(impacts)

    @cached_property
    def levels(self) -> list[array]:
        return sparse_table(np.frombuffer(self.impacts, np.int64))

    @cached_property
    def best(self) -> int:
        """The first document of the greatest impact."""
        return self.docs[self.impacts.index(max(self.impacts))]

    def top(self, start: int, end: int) -> int:
        """The greatest impact in a range that is not empty, packed with its place."""
        j = (end - start).bit_length() - 1
        level = self.levels[j]
        a, b = level[start], level[end - (1 << j)]
        return a if a >= b else b

    def impact(self, doc: int) -> int:
        i = bisect_left(self.docs, doc)
        return self.impacts[i] if i < len(self.docs) and self.docs[i] == doc else 0


def seeds(lists: list[PostingList], k: int) -> list[int]:
    """The k best scores among the documents of greatest impact of each list."""
    return heapq.nlargest(k, (sum(p.impact(doc) for p in lists) for doc in {p.best for p in lists}))


def best_first(lists: list[PostingList], n_docs: int, k: int, floor: int = 1) -> list[tuple[int, int]]:
    """``(score, document)`` of the k best documents, scores from ``floor`` on, equal ones in
    document order."""

    def interval(lo: int, hi: int, ranges: list[tuple[PostingList, int, int]]):
        """A heap entry: bound, place and the document to split at."""
        bound, best, split = 0, -1, 0
        for posting, start, end in ranges:
            packed = posting.top(start, end)
            impact = packed >> 23
            bound += impact
            if impact > best:
                best, split = impact, posting.docs[len(posting.docs) - 1 - (packed & 0x7FFFFF)]
        return -bound, lo, hi, split, ranges

    found: list[tuple[int, int]] = []  # a heap of (score, -document)
    ranges = [(p, 0, len(p.docs)) for p in lists if p.docs]
    heap = [interval(0, n_docs, ranges)] if ranges else []
    while heap:
        bound, lo, hi, split, ranges = heapq.heappop(heap)
        if len(found) == k and (-bound, -lo) <= found[0]:
            break
        score, left, right = 0, [], []
        for posting, start, end in ranges:
            i = j = bisect_left(posting.docs, split, start, end)
            if i < end and posting.docs[i] == split:
                score += posting.impacts[i]
                j += 1
            if start < i:
                left.append((posting, start, i))
            if j < end:
                right.append((posting, j, end))
        if score >= floor:
            if len(found) < k:
                heapq.heappush(found, (score, -split))
            elif (score, -split) > found[0]:
                heapq.heapreplace(found, (score, -split))
        for start, end, rest in ((lo, split, left), (split + 1, hi, right)):
            if rest:
                entry = interval(start, end, rest)
                if -entry[0] >= floor and (len(found) < k or (-entry[0], -start) > found[0]):
                    # Intervals do not overlap, so no two entries agree in bound and start.
                    heapq.heappush(heap, entry)
    return sorted(((score, -doc) for score, doc in found), key=lambda x: (-x[0], x[1]))


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's k best documents.

    With N documents that have terms, L terms of all of them and df documents that hold a term, the
    term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))). Its impact on a document of n terms that
    holds it tf times is w * ((10^9 tf) div (1000 tf + 8m)) with m = 10 + (90 n N) div L.
    """
    item_type = items.schema["item_id"].dataType.simpleString()
    terms = items.select("item_id", F.explode(F.array_distinct(word_array(F.col("text")))).alias("term")).distinct()
    n_items = items.agg(F.count_distinct(F.struct("item_id"))).first()[0]
    n_batches = max(1, -(-n_items // BATCH_ITEMS))
    terms, _ = stored(
        terms.select(F.pmod(F.xxhash64("item_id"), F.lit(n_batches)).cast("int").alias("batch"), "item_id", "term"), "query-terms"
    )
    hits, _ = stored(
        index.select("block", "term", "docs", "tfs").join(terms.select("term").distinct(), "term", "left_semi"), "query-postings"
    )
    blocks = index.where("term is null").select("block", "ids", "lengths")
    sums = blocks.agg(
        F.sum(F.size(F.filter("lengths", lambda n: n > 0))),
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)),
    ).first()
    total_docs, total_terms = sums[0] or 0, sums[1] or 0
    weight = F.floor(1000 * F.log((2.0 * total_docs + 2) / (2 * F.col("df") + 1)))
    weights = hits.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).select("term", weight.alias("w"))
    batches = F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1)))
    every = blocks.withColumn("batch", batches).groupBy("block", "batch")

    def by_block(queries: DataFrame, answer: Callable, schema: str) -> DataFrame:
        """``answer(lists, n_docs, floor)`` for every query in every block, as rows of columns."""
        names = [name.split()[0] for name in schema.split(", ")]

        def run(postings: pa.Table, block: pa.Table) -> pa.Table:
            own = postings.schema.field("items").type.value_type
            types = {"item_id": own.field("item_id").type}
            out: dict[str, list] = {name: [] for name in names}
            if postings.num_rows and block.num_rows:
                ids = block["ids"][0].values
                m = np.array([10 + (90 * n * total_docs) // total_terms for n in block["lengths"][0].as_py()], np.int64)
                lists: dict = {}
                for docs, tfs, w, of in zip(postings["docs"], postings["tfs"], postings["w"], postings["items"]):
                    docs, tf = docs.values.to_numpy(), tfs.values.to_numpy().astype(np.int64)
                    posting = PostingList(docs, w.as_py() * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])))
                    for item in of.as_py():
                        lists.setdefault((item["item_id"], item["floor"]), []).append(posting)
                for (item, floor), found in lists.items():
                    for score, doc in answer(found, len(m), floor):
                        out["item_id"].append(item)
                        out["score"].append(score)
                        if "doc_id" in out:
                            out["doc_id"].append(ids[doc].as_py())
            return pa.table({name: pa.array(out[name], types.get(name, pa.int64())) for name in names})

        wanted = queries.groupBy("batch", "term").agg(F.collect_list(F.struct("item_id", "floor")).alias("items"))
        weighed = hits.join(wanted.join(weights, "term"), "term")
        return weighed.groupBy("block", "batch").cogroup(every).applyInArrow(run, schema)

    # The k-th best of some documents' scores is a floor of the k-th best of all.
    some = by_block(
        terms.withColumn("floor", F.lit(1).cast("long")),
        lambda lists, n_docs, floor: ((score, 0) for score in seeds(lists, k)),
        f"item_id {item_type}, score long",
    )
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc()))
    floors, _ = stored(
        some.withColumn("place", place).where(F.col("place") == k)
        .select(F.col("item_id").alias("of"), F.greatest("score", F.lit(1)).alias("floor")),
        "query-floors",
    )
    raised = terms.join(floors, F.col("item_id").eqNullSafe(F.col("of")), "left").select(
        "batch", "item_id", "term", F.coalesce("floor", F.lit(1).cast("long")).alias("floor")
    )
    found = by_block(
        raised, lambda lists, n_docs, floor: best_first(lists, n_docs, k, floor),
        f"item_id {item_type}, doc_id long, score long",
    )
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
