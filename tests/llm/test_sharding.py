from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowrill.llm import queries
from flowrill.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards


def test_hypergeometric_matches_its_distribution():
    from math import comb

    rng = random.Random(4)
    good, bad, draws, n = 12, 30, 9, 20_000
    seen = Counter(hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(10):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


@pytest.mark.parametrize("good,bad,draws", [(0, 5, 3), (5, 0, 3), (5, 5, 0), (5, 5, 10), (10**11, 10**12, 10**8)])
def test_hypergeometric_bounds(good, bad, draws):
    x = hypergeometric(random.Random(1), good, bad, draws)
    assert max(0, draws - bad) <= x <= min(good, draws)


def test_matrix_has_its_margins():
    matrix = communication_matrix([5, 0, 17, 100], [41, 41, 40], 7)
    assert [sum(line) for line in matrix] == [5, 0, 17, 100]
    assert [sum(c) for c in zip(*matrix)] == [41, 41, 40]


def test_exact_sizes_and_slots(docs_table):
    docs = docs_table.unionByName(docs_table)  # repeated rows
    rows = shuffle_into_shards(docs.select("doc_id", "source"), 7, n_blocks=13, n_cells=5).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert sorted(shards) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_spreads_uniformly(spark):
    docs = spark.range(16_000, numPartitions=5).selectExpr("id as doc_id")
    rows = shuffle_into_shards(docs, 16).collect()
    first_half = Counter(r.shard for r in rows if r.doc_id < 8000)
    assert sum((first_half[s] - 500) ** 2 / 250 for s in range(16)) < 40  # chi-square, 15 degrees
    slots = [r.slot for r in rows if r.doc_id < 8000]
    assert abs(sum(slots) / len(slots) - 499.5) < 12


def test_odd_rows(messy, make_docs):
    got = shuffle_into_shards(messy, 16)
    assert got.columns == [c for c in messy.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    rows = got.collect()
    assert len(rows) == messy.count() and all(r.slot == 0 for r in rows)
    assert shuffle_into_shards(make_docs(), 16).count() == 0


def test_query_deals_out_whole_texts(spark, sf_dir, documents, monkeypatch):
    """What the query says of a text is taken from the text that came through the exchange."""
    seen = []

    def marked(docs, *args):
        seen.append(shuffle_into_shards(docs, *args))
        return seen[0].withColumn("text", F.concat("text", F.lit("!")))

    monkeypatch.setattr(queries, "shuffle_into_shards", marked)
    rows = queries.op5_shard(spark, sf_dir).collect()
    expected = Counter((i, len(f"{t}!".encode()) + 1, zlib.crc32(f"{t}!".encode())) for i, t in documents)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    assert sorted((r.doc_id, r.text) for r in seen[0].collect()) == sorted(documents)
