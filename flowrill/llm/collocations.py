"""Phrase collocations: n-grams counted level by level on word-level FM-indexes, one per shard.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words
at blanks and tabs. Everything is per ``lang`` (null: ``und``). A candidate is a phrase of 2 to
``longest`` words that occurs ``min_count`` times. Cut after k words it scores
floor(1000 a n / (l r)), where a, l and r count the phrase and its two parts and n all words; its
lowest cut counts, the first of equal ones. A candidate goes if one with a word more before or
after it occurs (nearly) as often; longer ones cannot occur more often than those.

* A shard is the tokens of some documents of one language, cut at pieces, at most ``SHARD_WORDS``.
* Level by level, counts of n-grams are summed across shards, and shards are told which of theirs
  reached ``min_count``. Only n-grams whose parts both did are counted, so no phrase is missed and
  few others are looked at.
* Most n-grams are rare. Shards send 96-bit hashes and counts, packed by ranges of hashes; of each
  frequent n-gram one shard that holds it gives the words. Two of a million million phrases share
  such a hash with a probability of 6 in a million.
* In a shard, frequent n-grams are found by backward search on an FM-index of word numbers. The
  symbols of the BWT in an interval are the words before it, with their counts. Levels extend in
  turn to the right (on the index of the reversed text) and to the left. Then the text shrinks to
  what can still hold a longer phrase.

Arithmetic is exact. A null or empty text has no words. Repeated rows count again. An empty table
gives an empty result. A piece of any length is whole in one shard. Columns other than ``lang`` and
``text`` are not read. Phrases order by their UTF-8 bytes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowrill.llm.dart_minhash import mix
from flowrill.llm.frames import discard, stored

SHARD_WORDS = 3 << 20
PART_HASHES, PARTITIONS_PER_PART = 4 << 20, 4
SALTS = 64
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PARTS = "shard string, part long, hashes binary, checks binary, counts binary"
_LEVEL = f"{_PARTS}, lang string, size long, text binary, words binary, at binary, phrase string, a long"
_SCHEMA = pa.schema(
    [
        ("shard", pa.string()), ("part", pa.int64()), ("hashes", pa.binary()), ("checks", pa.binary()),
        ("counts", pa.binary()), ("lang", pa.string()), ("size", pa.int64()), ("text", pa.binary()),
        ("words", pa.binary()), ("at", pa.binary()), ("phrase", pa.string()), ("a", pa.int64()),
    ]
)
# Pieces end at the marks and at \x0A-\x0D; a tab parts words as a blank does.
_TABLE = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Numbers(dict):
    """Numbers words from 1 as they come; 0 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Shard:
    def __init__(self) -> None:
        self.numbers, self.tokens = _Numbers({b"\n": 0}), array("i", [0])

    def add(self, text: str) -> None:
        parts = text.encode("utf-8").translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        self.tokens.extend(map(self.numbers.__getitem__, filter(None, parts)))
        self.tokens.append(0)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers by planes of bytes, so that leading zeros take no room."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, len(planes) // width).T).view(kind).ravel()


def phrase_hashes(
    text: np.ndarray, start: np.ndarray, m: int, words: list[bytes], lang: str
) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits for the m words at each place, the same in all shards of a language."""
    out = []
    for seed in (13, 14):
        of_word = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)
        total = np.full(len(start), xxhash.xxh3_64_intdigest(lang.encode("utf-8"), seed), np.uint64)
        for i in range(m):
            total += mix(of_word[text[start + i]] + np.uint64(i + 1) * _GOLDEN)
        out.append(mix(total))
    return out[0], out[1].astype(np.uint32)


def _rows(columns: dict[str, list]) -> pa.Table:
    """A table of the level's schema; columns not given are null."""
    n = len(next(iter(columns.values())))
    return pa.table([pa.array(columns.get(f.name, [None] * n), f.type) for f in _SCHEMA], schema=_SCHEMA)


def _state(
    shard: str, lang: str, text: np.ndarray, words: list[bytes], at: np.ndarray, n: np.ndarray, m: int, parts: int
) -> pa.Table:
    """A shard's text, words (the first is that of 0) and n-grams of m words, which are at ``at`` and
    occur n times; and for each range of hashes a row with their hashes and counts. The places are kept
    in the order of the text, where gaps take little room; that of the hashes is found again from them."""
    by_place = np.argsort(at)
    at, n = at[by_place], n[by_place]
    hashes, checks = phrase_hashes(text, at, m, words, lang)
    order = np.argsort(hashes, kind="stable")
    hashes, checks, n = hashes[order], checks[order], n[order].astype(np.int64)
    part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    own = {
        "shard": [shard], "lang": [lang], "size": [int(np.count_nonzero(text))], "text": [_pack(text.astype("<i4"))],
        "words": [zstandard.ZstdCompressor(level=1).compress(b"\n".join(words[1:]))],
        "at": [_pack(np.diff(at, prepend=0).astype("<i4"))],
    }
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    ranges = [slice(low, high) for low, high in zip(cuts, [*cuts[1:], len(part)])]
    sent = {
        "shard": [shard] * len(cuts), "part": part[cuts].tolist(),
        "hashes": [_pack(np.diff(hashes[r], prepend=np.uint64(0)).astype("<u8")) for r in ranges],
        "checks": [_pack(checks[r].astype("<u4")) for r in ranges],
        "counts": [_pack(n[r].astype("<i8")) for r in ranges],
    }
    return pa.concat_tables([_rows(own), _rows(sent)])


def shards(docs: DataFrame, parts: int) -> DataFrame:
    """The first level: the shards' texts, and their words as n-grams."""

    def finished(name: str, lang: str, shard: _Shard) -> Iterator[pa.RecordBatch]:
        text = np.frombuffer(shard.tokens, np.int32)
        names = list(shard.numbers)
        # Frequent words get small numbers, whose high bytes are mostly 0 and take little room.
        by_count = 1 + np.argsort(-np.bincount(text, minlength=len(names))[1:], kind="stable")
        numbers = np.zeros(len(names), np.int32)
        numbers[by_count] = np.arange(1, len(names))
        text, words = numbers[text], [b"", *[names[i] for i in by_count.tolist()]]
        at = np.zeros(len(words), np.int64)
        at[text[::-1]] = np.arange(len(text) - 1, -1, -1)  # the first place is written last
        n = np.bincount(text, minlength=len(words))
        yield from _state(name, lang, text, words, at[1:], n[1:], 1, parts).to_batches()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, open_shards = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                open_shards.setdefault(lang, _Shard()).add(text)
                if len(open_shards[lang].tokens) >= SHARD_WORDS or sum(len(s.tokens) for s in open_shards.values()) >= 2 * SHARD_WORDS:
                    largest = max(open_shards, key=lambda x: len(open_shards[x].tokens))
                    yield from finished(f"{part}-{number}", largest, open_shards.pop(largest))
                    number += 1
        for lang in sorted(open_shards):
            yield from finished(f"{part}-{number}", lang, open_shards[lang])
            number += 1

    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return read.where("text <> ''").mapInArrow(cut, _LEVEL)


def told(sent: DataFrame, min_count: int) -> DataFrame:
    """Per shard and range: ``bits`` of its frequent n-grams, ``owned`` of those it gives the words
    of, and the counts ``a`` of these over all shards."""

    def add(own: pa.Table) -> pa.Table:
        own = own.sort_by("shard")
        hashes = [np.cumsum(_unpack(h.as_py(), "<u8"), dtype=np.uint64) for h in own["hashes"]]
        ends = np.cumsum([len(h) for h in hashes])
        hashes = np.concatenate(hashes)
        checks = np.concatenate([_unpack(c.as_py(), "<u4") for c in own["checks"]])
        counts = np.concatenate([_unpack(c.as_py(), "<i8") for c in own["counts"]])
        order = np.lexsort((checks, hashes))  # stable, so a phrase's first row is that of its first shard
        hashes, checks = hashes[order], checks[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])])
        firsts = np.flatnonzero(new)
        totals = np.add.reduceat(counts[order], firsts)
        often = np.zeros(len(order), bool)
        often[order] = (totals >= min_count)[np.cumsum(new) - 1]
        total = np.zeros(len(order), np.int64)
        total[order[firsts]] = np.where(totals >= min_count, totals, 0)
        bits, owned, a = [], [], []
        for frequent, sums in zip(np.split(often, ends[:-1]), np.split(total, ends[:-1])):
            bits.append(np.packbits(frequent).tobytes())
            owned.append(np.packbits(sums > 0).tobytes())
            a.append(sums[sums > 0].astype("<i8").tobytes())
        columns = [own["shard"], own["part"], *(pa.array(x, pa.binary()) for x in (bits, owned, a)), pa.array(np.diff(ends, prepend=0), pa.int64())]
        return pa.table(columns, names=["shard", "part", "bits", "owned", "a", "n"])

    return sent.groupBy("part").applyInArrow(add, "shard string, part long, bits binary, owned binary, a binary, n long")


class FmIndex:
    """Suffixes of a text of numbers, ordered by their first ``depth`` ones, and its BWT.

    The text ends with 0, which no pattern holds, so that the symbol before the first is 0 too.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        rank, width = text.astype(np.int64), 1
        self.size = len(text)
        while True:
            step = min(width, depth - width)
            after = np.concatenate([rank[step:], np.zeros(step, np.int64)])
            pairs = rank * (int(rank.max()) + 1) + after
            width += step
            if width >= depth:
                break
            rank = np.unique(pairs, return_inverse=True)[1]
        self.suffixes = np.argsort(pairs, kind="stable")
        self.bwt = text[self.suffixes - 1]
        # Sorted by symbol, then place: the rank of (c, i) is what a step with c makes of i.
        self.steps = np.sort(self.bwt.astype(np.int64) * (self.size + 1) + np.arange(self.size))

    def intervals(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each row of numbers, by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, column].astype(np.int64) * (self.size + 1)
            low, high = np.searchsorted(self.steps, symbol + low), np.searchsorted(self.steps, symbol + high)
        return low, high


def grow_left(text: np.ndarray, at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Extensions by one word before the n-grams of ``m`` words that start at ``at``, of those whose
    first m words are such an n-gram too: the n-gram extended, the word, one place, the count; and
    all places of any."""
    index = FmIndex(text, m + 1)
    low, high = index.intervals(text[at[:, None] + np.arange(m)])
    sizes = high - low
    gram = np.repeat(np.arange(len(at)), sizes)
    rows = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
    places = index.suffixes[rows]
    alive = np.zeros(len(text), bool)
    alive[places] = True
    before = index.bwt[rows]
    grows = (before > 0) & alive[places - 1]
    gram, before, places = gram[grows], before[grows].astype(np.int64), places[grows] - 1
    n_symbols = int(text.max()) + 1
    pairs, first, counts = np.unique(gram * n_symbols + before, return_index=True, return_counts=True)
    return pairs // n_symbols, pairs % n_symbols, places[first], counts, places


def shrunk(text: np.ndarray, places: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of the m words at each of the places, parted by 0; and where each number went."""
    mark = np.zeros(len(text), bool)
    mark[places] = True
    keep = mark.copy()
    for i in range(1, m):
        keep[i:] |= mark[:-i]
    kept = np.flatnonzero(keep)
    moved = np.full(len(text), -1, np.int64)
    moved[kept] = np.arange(len(kept)) + np.cumsum(np.diff(kept, prepend=-1) > 1) + 1
    out = np.zeros(int(moved[kept[-1]]) + 2 if len(kept) else 1, np.int32)
    out[moved[kept]] = text[kept]
    return out, moved


def stepped(states: DataFrame, answers: DataFrame, m: int, parts: int, last: bool) -> DataFrame:
    """The frequent phrases of m words, each from one shard, and the next level."""

    def step(own: pa.Table, answer: pa.Table) -> pa.Table:
        if not own.num_rows or not answer.num_rows:
            return _SCHEMA.empty_table()
        shard, lang = own["shard"][0].as_py(), own["lang"][0].as_py()
        text, at = _unpack(own["text"][0].as_py(), "<i4"), np.cumsum(_unpack(own["at"][0].as_py(), "<i4"), dtype=np.int64)
        words = [b"", *zstandard.ZstdDecompressor().decompress(own["words"][0].as_py()).split(b"\n")]
        at = at[np.argsort(phrase_hashes(text, at, m, words, lang)[0], kind="stable")]  # as they were sent
        answer = answer.sort_by("part")

        def flags(column: str) -> np.ndarray:
            parts = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n.as_py()) for b, n in zip(answer[column], answer["n"])]
            return np.concatenate(parts).astype(bool)

        alive, mine = at[flags("bits")], at[flags("owned")]
        counts = np.frombuffer(b"".join(answer["a"].to_pylist()), "<i8")
        all_words = pa.array(words, pa.binary())
        joined = [all_words.take(pa.array(text[mine + i])) for i in range(m)]
        phrases = pc.binary_join_element_wise(*joined, pa.scalar(b" ", pa.binary())).cast(pa.string())
        found = _rows({"lang": [lang] * len(mine), "phrase": phrases.to_pylist(), "a": counts.tolist()})
        if last or not len(alive):
            return found
        if m % 2:  # to the right: to the left in the reversed text
            _, _, start, n, places = grow_left(text[::-1], len(text) - alive - m, m)
            start, places = len(text) - start - m - 1, len(text) - places - m - 1
        else:
            _, _, start, n, places = grow_left(text, alive, m)
        text, moved = shrunk(text, places, m + 1)
        used, text = np.unique(text, return_inverse=True)  # 0 is always among them
        return pa.concat_tables([found, _state(shard, lang, text, [words[i] for i in used.tolist()], moved[start], n, m + 1, parts)])

    return states.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(step, _LEVEL)


def frequent_phrases(docs: DataFrame, longest: int = 5, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, length, a`` of all phrases of 1 to ``longest`` words that occur ``min_count``
    times; and ``lang, n``, the words of each language. Both are stored."""

    def held(rows: DataFrame) -> tuple[DataFrame, str]:
        """A level; its phrases, texts and what was sent are in folders of their own."""
        kind = F.when(F.col("part").isNotNull(), "sent").when(F.col("text").isNotNull(), "text").otherwise("found")
        return stored(rows.withColumn("kind", kind), "phrase-level", by="kind")

    tables = []
    parts = 1 + docs.rdd.getNumPartitions() // PARTITIONS_PER_PART
    level, path = held(shards(docs, parts))
    sizes, _ = stored(level.where("kind = 'text'").groupBy("lang").agg(F.sum("size").alias("n")), "lang-words")
    for m in range(1, longest + 1):
        states = level.where("kind = 'text'").select("shard", "lang", "text", "words", "at")
        sent = level.where("kind = 'sent'").select("shard", "part", "hashes", "checks", "counts")
        # No more n-grams of the next length than words in the texts.
        parts = -(-(level.where("kind = 'text'").agg(F.sum("size")).first()[0] or 1) // PART_HASHES)
        # What was sent is summed up first: it and its shuffle have gone when the texts are shuffled.
        answers, answers_path = stored(told(sent, min_count), "phrase-answers")
        discard(f"{path}/kind=sent")
        before, (level, path) = path, held(stepped(states, answers, m, parts, m == longest))
        discard(before, answers_path)
        found = level.where("kind = 'found'").select("lang", "phrase", "a", F.lit(m).alias("length"))
        tables.append(stored(found, "phrases")[0])
    discard(path)
    return reduce(DataFrame.unionByName, tables), sizes


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The score of each cut; its products may pass 64 bits."""
    for batch in batches:
        numbers = (batch.column(name).to_pylist() for name in ("a", "n", "l", "r"))
        scores = [1000 * a * n // (l * r) for a, n, l, r in zip(*numbers)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.int64())], [*batch.schema.names, "score"])


def collocations(
    docs: DataFrame, longest: int = 5, min_count: int = 100, share: int = 100, best: int = 2000
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``best`` candidates.

    A candidate inside a longer one goes if that one has ``share`` percent of its occurrences.
    ``longer`` is the count of the most frequent phrase of a word more, null if there is none.
    """
    phrases, sizes = frequent_phrases(docs, longest, min_count)
    part = F.split("phrase", " ", -1)
    joined = lambda start, length: F.array_join(F.slice(part, start, length), " ")
    inner = phrases.where("length > 1").select(
        "lang", "a", F.explode(F.array(joined(F.lit(1), F.size(part) - 1), joined(F.lit(2), F.size(part) - 1))).alias("phrase")
    )
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.where("length > 1").join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    )
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1))).select(
        "lang", "phrase", "a", "longer", "k",
        joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("length") - F.col("k")).alias("tail"),
    )
    counted = (
        cuts.join(phrases.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
        .join(phrases.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
        .join(sizes, "lang").select("lang", "phrase", "a", "longer", "k", "l", "r", "n")
    )
    scored = counted.mapInArrow(
        _scores, "lang string, phrase string, a long, longer long, k int, l long, r long, n long, score long"
    )
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n", "longer")).alias("cut"))
    candidates = lowest.select("lang", "phrase", "cut.*")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # The best of each salt first, so that no task ranks a whole language.
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    final = near.where(F.col("rank") <= best).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return final.where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "longer")
