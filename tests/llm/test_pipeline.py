from __future__ import annotations

import corpus_pipeline
from flowrill.llm.decontaminate import contamination
from flowrill.llm.near_dups import near_classes
from flowrill.llm.quality import quality_scores


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before, seen = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns
        seen.append((name, before, after))
        before = after
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    name, old, new = seen[0]
    scores = quality_scores(old, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(new) == ids(scores.where("predicted = 1"))
    name, old, new = seen[1]
    assert ids(new) == ids(near_classes(old).where("keep"))
    name, old, new = seen[2]
    assert ids(new) == ids(contamination(old, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated"))
    name, old, new = seen[3]
    assert set(ids(new)) <= set(ids(old)) and len({r.source for r in new.collect()}) > 1
    files = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert ids(files) == ids(before)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_mixing_keeps_columns_named_as_its_own(spark, messy, sf_dir):
    mixed = corpus_pipeline.mixing(spark, messy, sf_dir)
    assert mixed.columns == messy.columns
    rows = mixed.collect()
    assert rows and {(r.copy, r.order_key) for r in rows} == {("x", "x")}


def tables(docs, folder, labels, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    docs.sparkSession.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs.sparkSession.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_empty_and_messy_tables(spark, make_docs, messy, tmp_path):
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    empty = corpus_pipeline.run(spark, tables(make_docs(), tmp_path / "empty", [], []))
    assert empty.columns == columns and empty.count() == 0
    sf_dir = tables(messy, tmp_path / "messy", [(1, 1), (2, 1), (5, 1), (8, 0)], [(0, "a text without id"), (1, None)])
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert all(r.n_tokens > 0 and r.ids_crc32 is not None for r in rows)
    spans = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_a_stage_that_drops_everything(spark, make_docs, tmp_path):
    """All documents are benchmark texts."""
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = make_docs(*[(i, f"{item} {i}") for i in range(5)])
    assert corpus_pipeline.run(spark, tables(docs, tmp_path / "t", [(0, 1), (1, 1)], [(7, item)])).count() == 0
