from __future__ import annotations

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np

from flowrill.llm import lexical_search
from flowrill.llm.lexical_search import PostingList, best_first, build_index, search
from flowrill.llm.queries import QUERIES
from flowrill.llm.words import words


def brute(docs, items, k):
    """Rows (item_id, rank, doc_id, score) from scoring every document."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in bags]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in bags for t in c)
    queries = defaultdict(set)
    for item, text in items:
        queries[item] |= set(words(text))
    out = []
    for item, terms in queries.items():
        scored = []
        for (doc_id, bag), n in zip(bags, lengths):
            score = 0
            for t in terms & bag.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 10 + 90 * n * n_docs // n_terms
                score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        ranked = sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        out += [(item, place + 1, doc_id, -score) for place, (score, _, doc_id) in enumerate(ranked)]
    return Counter(out)


def found(index, items, k=10):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in search(index, items, k).collect())


def test_range_maxima_and_best_first_equal_a_full_scan():
    rng = np.random.default_rng(3)
    for n_docs in (1, 2, 7, 100):
        lists, scores = [], Counter()
        for _ in range(6):
            docs = np.flatnonzero(rng.random(n_docs) < rng.random()).astype(np.int32)
            impacts = rng.integers(0, 4, len(docs))
            for d, x in zip(docs.tolist(), impacts.tolist()):
                scores[d] += x
            lists.append(PostingList(docs, impacts))
            for a in range(len(docs)):
                for b in range(a + 1, len(docs) + 1):
                    top = lists[-1].top(a, b)
                    assert (top >> 23, len(docs) - 1 - (top & 0x7FFFFF)) == (max(impacts[a:b]), a + int(np.argmax(impacts[a:b])))
        for k in (1, 3, 200):
            want = sorted(((s, d) for d, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
            assert best_first(lists, n_docs, k) == want


def test_search_equals_brute_force_on_messy_rows(spark, messy, monkeypatch):
    docs = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    items = [
        (1, "plain words of one text"), (2, None), (3, ""), (4, "REPEATED row row"), (4, "text"), (None, "ünï 漢字 x"),
        (5, "nothing-that-occurs"), (6, "several words of one very long text end a"),
    ]
    table = spark.createDataFrame([(*r, "x", 0) for r in items], "item_id long, text string, term string, block int")
    for chars in (1 << 25, 40):  # all in a few blocks; nearly every document a block of its own
        monkeypatch.setattr(lexical_search, "BLOCK_CHARS", chars)
        for batch in (256, 2):
            monkeypatch.setattr(lexical_search, "BATCH_ITEMS", batch)
            for k in (1, 10):
                assert found(build_index(messy), table, k) == brute(docs, items, k)


def test_ties_come_in_order_of_ids_and_hot_terms_do_not_hide_them(make_docs, spark):
    docs = [(i, "same words here") for i in range(200, 0, -1)] + [(999, "same words here rare")]
    items = spark.createDataFrame([("q", "same rare"), ("p", "words")], "item_id string, text string")
    assert found(build_index(make_docs(*docs)), items) == brute(docs, [("q", "same rare"), ("p", "words")], 10)


def test_empty_tables(make_docs, messy, spark):
    items = spark.createDataFrame([(1, "text")], "item_id long, text string")
    assert search(build_index(messy.limit(0)), items).count() == 0
    assert search(build_index(messy), items.limit(0)).count() == 0
    assert search(build_index(make_docs((1, None), (2, "..."))), items).count() == 0


def test_query_equals_brute_force(spark, sf_dir, documents):
    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    rows = QUERIES["op12_lexical_search"](spark, sf_dir).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in rows) == brute(documents, items, 10)
