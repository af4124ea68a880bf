from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from flowrill.llm import collocations as module
from flowrill.llm.collocations import FmIndex, collocations, grow_left, shrunk
from flowrill.llm.frames import discard
from flowrill.llm.queries import QUERIES
from flowrill.llm.words import LOWER, UPPER

FOLD = str.maketrans(UPPER, LOWER)


def brute(rows, longest=5, min_count=100, share=100, best=2000):
    """Rows of the result from counting every phrase; rows are (lang, text)."""
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall(r"[^ \t]+", piece)
            sizes[lang] += len(w)
            for d in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = Counter()
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= min_count}
        longer = Counter()
        for p, a in often.items():
            for d in range(2, len(p)):
                for i in range(len(p) - d + 1):
                    longer[p[i : i + d]] = max(longer[p[i : i + d]], a)
        ranked = []
        for p, a in often.items():
            if len(p) > 1 and not (p in longer and 100 * longer[p] >= share * a):
                cuts = [(1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(ranked)[:best], 1):
            out[(lang, rank, p.decode(), -a, l, r, sizes[lang], -score)] += 1
    return out


def result(docs, **options):
    rows = collocations(docs, **options).collect()
    return Counter((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows)


def sentences(seed, n, vocabulary):
    rng = random.Random(seed)
    blanks, ends = [" ", "  ", "\t", " \t "], [". ", ", ", "\n", "!", " ;", ""]
    def word():
        w = rng.choice(vocabulary)
        return w.upper() if rng.random() < 0.2 else w
    return [
        (rng.choice(["en", "fr", None, "und"]), "".join(word() + rng.choice(blanks) + rng.choice(ends) * (rng.random() < 0.2) for _ in range(rng.randrange(40))))
        for _ in range(n)
    ]


def test_backward_search_and_extensions_equal_a_scan():
    rng = np.random.default_rng(5)
    for n, symbols in ((3, 2), (60, 3), (400, 6)):
        text = np.concatenate([[0], rng.integers(0, symbols, n), [0]]).astype(np.int32)
        for m in (1, 2, 3, 4):
            all_grams = Counter(tuple(text[i : i + m].tolist()) for i in range(len(text) - m + 1))
            grams = [g for g in all_grams if 0 not in g]
            if not grams:
                continue
            low, high = FmIndex(text, m + 1).intervals(np.array(grams))
            assert [all_grams[g] for g in grams] == (high - low).tolist()
            at = np.array([next(i for i in range(len(text)) if tuple(text[i : i + m].tolist()) == g) for g in grams])
            gram, word, start, counts, places = grow_left(text, at, m)
            got = {(int(w), *grams[g]): int(c) for g, w, c in zip(gram, word, counts)}
            want = Counter(tuple(text[i : i + m + 1].tolist()) for i in range(len(text) - m))
            assert got == {g: c for g, c in want.items() if 0 not in g}
            assert all(tuple(text[s : s + m + 1].tolist()) == (w, *grams[g]) for g, w, s in zip(gram, word, start))
            small, moved = shrunk(text, places, m + 1)
            assert all((small[moved[p] : moved[p] + m + 1] == text[p : p + m + 1]).all() for p in places)
            assert Counter(tuple(small[i : i + m + 1].tolist()) for i in range(len(small) - m) if 0 not in small[i : i + m + 1]) == {g: c for g, c in want.items() if 0 not in g}


@pytest.mark.parametrize(("shard_words", "part_hashes"), [(3 << 20, 4 << 20), (400, 97)])
def test_phrases_equal_brute_force(spark, monkeypatch, shard_words, part_hashes):
    monkeypatch.setattr(module, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(module, "PART_HASHES", part_hashes)
    rows = sentences(1, 300, ["new", "york", "the", "of", "à", "漢字", "x-y", "(z)", "\x1c"])
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(3)
    for options in ({"min_count": 5}, {"min_count": 3, "share": 60}, {"min_count": 2, "longest": 3, "best": 20}):
        assert result(docs, **options) == brute(rows, **options)


def test_messy_rows_repeats_and_empty_tables(messy):
    rows = [(r.lang, r.text) for r in messy.select("lang", "text").collect()]
    assert result(messy, min_count=2) == brute(rows, min_count=2)
    assert collocations(messy.limit(0)).count() == 0
    assert collocations(messy, min_count=10**6).count() == 0


def test_packed_numbers_come_back():
    for kind, numbers in (("<u8", [0, 2**64 - 1, 5]), ("<i4", [-1, 0, 2**31 - 1]), ("<u4", [])):
        assert module._unpack(module._pack(np.array(numbers, kind)), kind).tolist() == numbers


def test_scores_beyond_64_bits_are_exact(spark):
    a = 3_037_000_500
    table = spark.createDataFrame([("en", "a b", a, None, 1, a, a + 1, 9 * a)], "lang string, phrase string, a long, longer long, k int, l long, r long, n long")
    scored = table.mapInArrow(module._scores, table.schema.simpleString()[7:-1].replace(":", " ") + ", score long")
    assert scored.first().score == 1000 * a * 9 * a // (a * (a + 1))


def test_query_equals_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"select lang, text from '{sf_dir}/documents.parquet'").fetchall()
    got = QUERIES["op13_collocations"](spark, sf_dir).collect()
    assert Counter((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute(rows)


def test_places_take_little_room_and_what_was_sent_goes_before_texts_are_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = np.concatenate([[0], rng.integers(1, 4000, 50_000), [0]]).astype(np.int32)
    words = [b"", *(b"w%d" % i for i in range(1, 4000))]
    at = rng.permutation(np.arange(1, 50_000))  # in no order, as n-grams come
    state = module._state("0-0", "en", text, words, at, np.ones(len(at), np.int64), 2, 3)
    own = state.slice(0, 1)
    assert len(own["at"][0].as_py()) < len(at) // 4  # as places in the order of hashes: 2 bytes each
    places = np.cumsum(module._unpack(own["at"][0].as_py(), "<i4"), dtype=np.int64)
    hashes = module.phrase_hashes(text, places, 2, words, "en")[0]
    sent = np.concatenate([np.cumsum(module._unpack(h.as_py(), "<u8"), dtype=np.uint64) for h in state["hashes"][1:]])
    assert (np.sort(hashes) == sent).all()

    gone = []
    monkeypatch.setattr(module, "discard", lambda *paths: (gone.extend(paths), discard(*paths)))
    docs = spark.createDataFrame(sentences(1, 50, ["new", "york", "the", "of"]), "lang string, text string")
    module.frequent_phrases(docs, 3, 5)
    assert [p.rsplit("/", 1)[1] for p in gone if "kind=" in p] == ["kind=sent"] * 3
