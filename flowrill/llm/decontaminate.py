"""Benchmark decontamination: one Aho-Corasick automaton over the test items, one scan of each text.

Items and texts are reduced to words. A window is 13 consecutive words of an item, or a whole item
of fewer; a document word inside any occurrence of a window is hit. Each benchmark word is one
symbol, so the automaton walks words, and hits are mapped back to characters of the original.

Null and empty texts and items have no words and no hits. An item without id is listed as ``null``;
items that share an id count once. Rows are judged one by one, so repeated rows repeat their
result. An empty benchmark hits nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from flowrill.llm.frames import fresh, kept
from flowrill.llm.words import word_spans, words
from flowrill.session import shared_dir

WINDOW = 13
_SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
_HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("words", T.ArrayType(_SPAN)),
        T.StructField("characters", T.ArrayType(_SPAN)),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_ARROW_HITS = pa.struct(
    [
        ("n_words", pa.int64()),
        ("words", _ARROW_SPANS),
        ("characters", _ARROW_SPANS),
        ("items", pa.list_(pa.string())),
    ]
)

Piece = tuple[str, list[bytes]]


def item_blocks(benchmark: DataFrame, window: int, max_windows: int) -> Iterator[list[Piece]]:
    """Items as word lists, in blocks of at most ``max_windows`` windows; one block at a time.

    An item with more windows is cut into pieces that overlap by ``window - 1`` words.
    """
    block: list[Piece] = []
    room = max_windows
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        item = words(row[1])
        first, n = 0, max(1, len(item) - window + 1)
        while item and first < n:
            take = min(room, n - first)
            block.append((row[0] or "null", item[first : first + take + window - 1]))
            first, room = first + take, room - take
            if not room:
                yield block
                block, room = [], max_windows
    if block:
        yield block


class WindowAutomaton:
    """Finds all windows of a block of items in a list of words."""

    def __init__(self, pieces: Iterable[Piece], window: int) -> None:
        self.symbols: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item_id, item in pieces:
            text = "".join(map(self._symbol, item))
            for first in range(max(1, len(text) - window + 1)):
                owners.setdefault(text[first : first + window], set()).add(item_id)
        self.automaton = ahocorasick.Automaton()
        for text, ids in owners.items():
            self.automaton.add_word(text, (len(text), ids))
        # A window lies in a run of words that all occur in items; only such runs are walked.
        self.runs = re.compile("[^\0]{%d,}" % min(map(len, owners), default=1))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def _symbol(self, word: bytes) -> str:
        known = self.symbols.get(word)
        if known is None:
            code = len(self.symbols) + 1  # 0 stands for words of no item
            known = self.symbols[word] = chr(code if code < 0xD800 else code + 0x800)
        return known

    def find(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of hit words (first and last), and the ids of items with windows there."""
        ranges: list[list[int]] = []
        items: set[str] = set()
        if self.empty:
            return [], items
        get = self.symbols.get
        line = "".join([get(w, "\0") for w in text])
        for run in self.runs.finditer(line):
            for last, (length, ids) in self.automaton.iter(line, *run.span()):
                items |= ids
                first = last - length + 1
                while ranges and first <= ranges[-1][1] + 1:
                    first = min(first, ranges.pop()[0])
                ranges.append([first, last])
        return [(a, b) for a, b in ranges], items


def automaton(key: str, shared, window: int) -> WindowAutomaton:
    """The automaton of a broadcast block, kept in a worker process from task to task."""
    return kept(f"automaton {key}", lambda: WindowAutomaton(shared.value, window))


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if merged and first <= merged[-1][1] + 1:
            first, last = merged[-1][0], max(last, merged.pop()[1])
        merged.append((first, last))
    return merged


def find_windows(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], out: str,
    window: int = WINDOW, max_windows: int = 50_000,
) -> DataFrame:
    """The ``keep`` columns and a struct ``out`` of ``n_words`` and the merged hit ``words`` and
    ``characters`` (first and last, from 0) and the ``items`` hit.

    What is sent to the executors is a block of the benchmark of at most ``max_windows`` windows; a
    larger benchmark takes several blocks, each scanning the texts once and adding its hits. No
    rows are exchanged.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    df = docs
    blocks = item_blocks(benchmark, window, max_windows)
    ahead = list(islice(blocks, 2)) or [[]]
    number = 0
    while ahead:
        block, ahead = ahead[0], ahead[1:] + list(islice(blocks, 1))
        number += 1
        if number > 1:  # the hits so far are stored, so one automaton is in memory at a time
            path = shared_dir(spark, "hits")
            df.write.parquet(path)
            df = spark.read.parquet(path)
        df = _scan(df, context.broadcast(block), keep, out, window, bool(ahead), number > 1)
    return df


def _scan(df, shared, keep, out, window, more, again) -> DataFrame:
    columns = list(dict.fromkeys([*keep, "text"])) if more else keep
    before = [out] if again else []
    wanted = df.select(*[f"`{c}`" for c in dict.fromkeys([*columns, "text", *before])])
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton(key, shared, window)
        for batch in batches:
            hits = []
            earlier = batch.column(batch.schema.get_field_index(out)) if again else None
            for i, scalar in enumerate(batch.column(batch.schema.get_field_index("text"))):
                text = scalar.as_py() or ""
                own = words(text)
                ranges, items = finder.find(own)
                if again:
                    old = earlier[i].as_py()
                    ranges = _joined(ranges + [(x["first"], x["last"]) for x in old["words"]])
                    items |= set(old["items"])
                spans = word_spans(text) if ranges else []
                hits.append(
                    {
                        "n_words": len(own),
                        "words": [{"first": a, "last": b} for a, b in ranges],
                        "characters": [{"first": spans[a][0], "last": spans[b][1] - 1} for a, b in ranges],
                        "items": sorted(items),
                    }
                )
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(hits, _ARROW_HITS)], names=[*columns, out]
            )

    schema = T.StructType([*[wanted.schema[c] for c in columns], T.StructField(out, _HITS)])
    return wanted.mapInArrow(scan, schema)


def hit_counts(hits: str) -> dict:
    """Column expressions over the struct of :func:`find_windows`."""
    n_words = F.col(hits).getField("n_words")
    items = F.col(hits).getField("items")
    n_hit = F.aggregate(
        F.col(hits).getField("words"), F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1
    )
    return {
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.array_join(items, ","), 256),
        "contaminated": (n_hit > 0) & (20 * n_hit >= n_words),
    }


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the hit ``passages``
    (characters of the original) per row; contaminated is a row with a twentieth of its words hit."""
    found = find_windows(docs, benchmark, ["doc_id"], "hits", **options)
    counts = hit_counts("hits")
    return found.select(
        "doc_id", *[c.alias(n) for n, c in counts.items()],
        F.col("hits").getField("characters").alias("passages"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows that are not contaminated, all columns unchanged."""
    hits = fresh(docs, "hits")
    found = find_windows(docs, benchmark, docs.columns, hits, **options)
    return found.where(~hit_counts(hits)["contaminated"]).select(*[f"`{c}`" for c in docs.columns])
