from __future__ import annotations

import math
from collections import Counter

from flowrill.llm import frames, queries
from flowrill.llm.mixing import poisson_steps, replicate, source_rates


def test_steps_are_the_poisson_distribution(spark):
    rates = spark.createDataFrame([("a", 0.3), ("b", 4.0), ("c", 900.0), ("d", 0.0), (None, 1.0)], "source string, rate double")
    got = {r.source: r.steps for r in poisson_steps(rates).collect()}
    assert set(got) == {"a", "b", "c", None}
    for source, rate in (("a", 0.3), ("b", 4.0), (None, 1.0)):
        total = 0.0
        for k in range(8):
            total += math.exp(-rate) * rate**k / math.factorial(k)
            assert abs(got[source][k] - total) < 1e-12
    assert abs(got["c"][-1] - 1) < 1e-9 and got["c"] == sorted(got["c"])


def test_target_weights(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id < 4000, 'big', if(id < 5500, 'mid', null)) as source")
    rows = replicate(docs, {"big": 1.0, "mid": 1.0, None: 2.0}, total=8000.0).collect()
    seen = Counter(r.source for r in rows)
    assert abs(seen["big"] - 2000) < 200 and abs(seen["mid"] - 2000) < 200 and abs(seen[None] - 4000) < 300
    keys = [r.order_key for r in rows]
    assert keys == sorted(keys)
    ids = [r.doc_id for r in rows]
    assert abs(sum(i < 4000 for i in ids[:4000]) - 1000) < 150  # shuffled over sources
    copies = Counter(r.doc_id for r in rows)
    assert all(sorted(r.copy for r in rows if r.doc_id == i) == list(range(1, copies[i] + 1)) for i in list(copies)[:20])


def test_rates_follow_the_exponent(spark):
    docs = spark.range(500).selectExpr("if(id < 400, 'a', 'b') as source")
    assert {r.source: round(r.rate, 9) for r in source_rates(docs, exponent=1.0).collect()} == {"a": 1.0, "b": 1.0}
    assert {r.source: round(r.rate, 9) for r in source_rates(docs, exponent=0.0).collect()} == {"a": 0.625, "b": 2.5}


def test_odd_rows(messy, make_docs):
    got = replicate(messy, exponent=1.0, total=600.0)
    assert got.columns == [c for c in messy.columns if c not in ("copy", "order_key")] + ["copy", "order_key"]
    rows = got.collect()
    assert abs(len(rows) - 600) < 200 and {r.source for r in rows} == {"s", "t", None}
    again = replicate(messy, exponent=1.0, total=600.0).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert replicate(make_docs()).count() == 0
    assert replicate(messy, {"other": 1.0}).count() == 0


def test_queries_mix_whole_documents(spark, sf_dir, docs_table, documents, monkeypatch):
    """The narrow query stores a corpus with texts; the other one returns it."""
    paths, text = [], dict(documents)

    def watched(*args):
        out = frames.stored(*args)
        paths.append(out[1])
        return out

    monkeypatch.setattr(queries, "stored", watched)
    narrow = queries.op10_mix_sources(spark, sf_dir).collect()
    assert [r.order_key for r in narrow] == sorted(r.order_key for r in narrow)
    for whole in (spark.read.parquet(paths[0]), queries.op10_mixed_texts(spark, sf_dir)):
        assert whole.columns == [*docs_table.columns, "copy", "order_key"]
        rows = whole.collect()
        assert all(r.text == text[r.doc_id] for r in rows)
        assert Counter((r.doc_id, r.source, r.copy, r.order_key) for r in rows) == Counter(map(tuple, narrow))
