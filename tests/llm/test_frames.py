from __future__ import annotations

from flowrill.llm import frames, near_dups
from flowrill.llm.frames import discard, kept, stored


def test_a_worker_keeps_one_thing_only():
    first = kept("a", list)
    assert kept("a", list) is first
    kept("b", dict)
    assert list(frames._KEPT) == ["b"]
    assert kept("a", list) is not first


def test_word_hashes_are_bounded_and_unchanged(monkeypatch):
    text = " ".join(f"w{i}" for i in range(300))
    elements, counts = near_dups.shingle_counts(text)
    kept("other", list)
    monkeypatch.setattr(near_dups, "KEPT_WORDS", 50)
    again = near_dups.shingle_counts(text)
    assert (again[0] == elements).all() and (again[1] == counts).all()
    assert len(kept("word hashes", dict)) <= 51


def test_shuffle_files_go_when_a_table_is_stored(spark):
    before = spark.conf.get(frames._CLEANUP, None)
    seen = []
    shuffled = spark.range(1000).repartition(7, "id")
    write = type(shuffled.write).parquet

    def watched(self, *args, **options):
        seen.append(spark.conf.get(frames._CLEANUP))
        return write(self, *args, **options)

    type(shuffled.write).parquet = watched
    try:
        table, path = stored(shuffled.selectExpr("id", "id % 2 as odd"), "test", by="odd")
    finally:
        type(shuffled.write).parquet = write
    assert seen == ["true"] and spark.conf.get(frames._CLEANUP, None) == before
    assert table.count() == 1000 and shuffled.count() == 1000
    discard(f"{path}/odd=1")
    assert table.where("odd = 0").count() == 500
    discard(path)
