"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (line ends, then sentence ends, then every 200 characters). Each
paragraph's digest, salted with its occurrence number in the text, is added to one cell in each of
three thirds of a table; a cell holds a count, the XOR of its digests and the XOR of their checks.
Two tables of one size subtract cell by cell, which cancels what the texts share, and peeling cells
with a single digest recovers the digests on either side. If peeling fails the two are sketched
again with four times the cells, until it succeeds. Likeness is common paragraphs over all
paragraphs (1 for two empty texts).

A null text is an empty one. Documents are ordered by descending ``doc_id`` (nulls last, equal ids
by text hash); columns other than ``doc_id`` and ``text`` are ignored. Equal texts have equal
fingerprints. A table of one row is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

CELLS = 18
_PARAGRAPH = re.compile(r"[^.!?\n]{1,200}[.!?\n]*|[.!?\n]+")
_CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def paragraph_digests(text: str) -> np.ndarray:
    """The distinct digests of the paragraphs; of a repeated one the occurrence number is hashed
    too. Peeling needs each digest at most once in a table."""
    seen: dict[str, int] = {}
    digests = []
    for paragraph in _PARAGRAPH.findall(text):
        occurrence = seen.get(paragraph, 0)
        seen[paragraph] = occurrence + 1
        digests.append(xxhash.xxh3_64_intdigest(f"{occurrence}\n{paragraph}" if occurrence else paragraph))
    return np.unique(np.array(digests, np.uint64))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Scrambled 64-bit numbers (multiply and shift)."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _check(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 77) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _cell(keys: np.ndarray, third: int, cells: int) -> np.ndarray:
    size = cells // 3
    return third * size + (_mix(keys, third + 1) % np.uint64(size)).astype(np.int64)


class Tables:
    """Sketches of several documents, one row each, all with the same number of cells."""

    def __init__(self, n: int, cells: int) -> None:
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int32)
        self.key = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint32)

    def add(self, rows: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = _check(keys)
        for third in range(3):
            at = rows * self.cells + _cell(keys, third, self.cells)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def minus(self, other: Tables) -> Tables:
        out = Tables(0, self.cells)
        out.n, out.count = self.n, self.count - other.count
        out.key, out.check = self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which rows decode fully, and the row, digest and sign of all recovered digests.

        Empties the tables. Cells of one third are peeled together, since a digest has only one
        cell there.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = self.cells // 3
        moved, rounds = True, 0
        while moved and rounds < 1000:  # a false check could put digests to and fro
            moved, rounds = False, rounds + 1
            for third in range(3):
                counts = self.count.reshape(self.n, self.cells)[:, third * size : (third + 1) * size]
                row, col = np.nonzero(np.abs(counts) == 1)
                at = row * self.cells + third * size + col
                pure = self.check[at] == _check(self.key[at])
                pure &= _cell(self.key[at], third, self.cells) == third * size + col
                if not pure.any():
                    continue
                row, at = row[pure], at[pure]
                keys, signs = self.key[at], self.count[at]
                self.add(row, keys, -signs)
                found.append((row, keys, signs))
                moved = True
        left = (self.count != 0) | (self.key != 0)
        done = ~left.reshape(self.n, self.cells).any(axis=1)
        if not found:
            empty = np.zeros(0, np.int64)
            return done, empty, empty.astype(np.uint64), empty
        return done, *[np.concatenate(part) for part in zip(*found)]


def sketch(digests: list[np.ndarray], cells: int) -> Tables:
    tables = Tables(len(digests), cells)
    if digests:
        rows = np.repeat(np.arange(len(digests)), [len(d) for d in digests])
        tables.add(rows, np.concatenate(digests))
    return tables


def serialised(tables: Tables) -> list[str]:
    """Each row's table as text."""
    data = np.zeros(tables.n * tables.cells, _CELL)
    data["count"], data["key"], data["check"] = tables.count, tables.key, tables.check
    step = tables.cells
    return [base64.b64encode(data[i * step : (i + 1) * step].tobytes()).decode("ascii") for i in range(tables.n)]


def differences(
    left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS
) -> tuple[np.ndarray, np.ndarray]:
    """Digests only left and only right, counted per pair, from subtracted and peeled sketches.

    Pairs that do not decode are sketched again with four times the cells.
    """
    only_left, only_right = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    waiting = np.arange(len(left))
    while waiting.size:
        step = max(1, 300_000 // cells)  # bounds the memory of large tables
        failed = []
        for first in range(0, waiting.size, step):
            own = waiting[first : first + step]
            tables = sketch([left[i] for i in own], cells).minus(sketch([right[i] for i in own], cells))
            done, row, _, sign = tables.peel()
            only_left[own] = np.bincount(row[sign > 0], minlength=own.size)
            only_right[own] = np.bincount(row[sign < 0], minlength=own.size)
            failed.append(own[~done])
        waiting = np.concatenate(failed)
        cells *= 4
    return only_left, only_right


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    only_left, only_right = differences(left, right)
    sizes = np.array([len(d) for d in left], np.int64)
    common, union = sizes - only_left, sizes + only_right
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the characters replaced by the first of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the key (0 for null); a search in two levels."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    upto = lambda values: F.size(F.filter(values, lambda b: b <= key))
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    inner = F.array(*[F.array(*map(F.lit, b)) for b in blocks])
    block = upto(heads)
    return F.when(key.isNull() | (block == 0), 0).otherwise(
        (block - 1) * step + upto(F.get(inner, block - 1))
    )


def with_following(docs: DataFrame, n_ranges: int) -> DataFrame:
    """Rows dealt to ranges of ``doc_id`` (``bucket``), each with the first rows of the next lower
    range as ``extra`` rows, so that every task sees the document that follows its last one.

    The range bounds and each range's largest id (``n_ranges`` numbers) pass the driver; only ids
    are read for them. Texts are exchanged once.
    """
    share = [i / n_ranges for i in range(1, n_ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", share, 10_000)).first()[0] if share else []
    bounds = sorted(set(bounds or []))
    bucket = _bucket(F.col("doc_id"), bounds)
    tops = {
        r["bucket"]: r["top"]
        for r in docs.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("top")).collect()
    }
    order = sorted(tops, reverse=True)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first range follows the last
    n = len(bounds) + 1
    top = F.array(*[F.lit(tops.get(b)).cast("long") for b in range(n)])
    receiver = F.array(*[F.lit(before.get(b)).cast("int") for b in range(n)])
    own = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("extra"))
    sent = F.struct(F.get(receiver, F.col("own")).alias("bucket"), F.lit(True).alias("extra"))
    is_top = F.col("doc_id").eqNullSafe(F.get(top, F.col("own")))
    return (
        docs.withColumn("own", bucket)
        .withColumn("to", F.when(is_top, F.array(own, sent)).otherwise(F.array(own)))
        .select("doc_id", "text", F.inline("to"))
    )


def fingerprint_documents(docs: DataFrame, chunk: int = 128, chunk_chars: int = 1_000_000) -> DataFrame:
    """Per row ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` for its text, its edited text and the next document's text.

    Documents are sketched ``chunk`` at a time, fewer if they have ``chunk_chars`` characters: this
    bounds a task's memory.
    """
    spark = docs.sparkSession
    n_ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def compute(rows_: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
        ids = [r[0] for r in rows_]
        texts = [r[1] for r in rows_]
        nexts = [*texts[1:], following]
        changed = [edited(a, b) for a, b in zip(texts, nexts)]
        own = [paragraph_digests(t) for t in [*texts, following]]
        other = [paragraph_digests(t) for t in changed]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(map(len, texts), pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed]),
                pa.array(serialised(sketch(own[:-1], CELLS))),
                pa.array(serialised(sketch(other, CELLS))),
                pa.array(likeness(own[:-1], other)),
                pa.array(likeness(own[:-1], own[1:])),
            ],
            names=[part.split()[0] for part in _RESULT.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int | None, str]] = []
        bucket, closed, held = None, False, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for doc_id, text, where, extra in zip(*columns):
                doc_id, text, where, extra = doc_id.as_py(), text.as_py(), where.as_py(), extra.as_py()
                if where != bucket:
                    bucket, closed = where, False
                if closed:
                    continue  # further rows of the next range
                full = len(waiting) >= chunk or held >= chunk_chars
                if waiting and (extra or full):
                    yield compute(waiting, text)
                    waiting, held = [], 0
                if extra:
                    closed = True
                else:
                    waiting.append((doc_id, text))
                    held += len(text)

    return (
        with_following(rows, n_ranges)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
        .mapInArrow(run, _RESULT)
    )
