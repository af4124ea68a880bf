from __future__ import annotations

import hashlib

from flowrill.llm.decontaminate import contamination, drop_contaminated
from flowrill.llm.words import words


def brute(text, items, window=13):
    own, hit, found = words(text), set(), set()
    for item_id, item in items:
        item = words(item)
        n = min(window, len(item))
        for a in range(len(item) - n + 1 if n else 0):
            for b in range(len(own) - n + 1):
                if own[b : b + n] == item[a : a + n]:
                    hit.update(range(b, b + n))
                    found.add("null" if item_id is None else str(item_id))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)


ITEMS = [
    (1, "What is the sum of all the odd numbers from one up to twenty? Four hundred."),
    (2, "Short question"), (10, "the odd numbers from one up to twenty"), (3, None), (4, ""),
    (None, "nameless item"), (2, "short Answer"),
]


def texts():
    a = ITEMS[0][1]
    return [
        (1, f"Before. {a.upper()} After it all " + "filler " * 200), (2, a), (3, a[: len(a) // 2]),
        (4, "short, QUESTION! and short   answer; nameless-item"), (5, "filler " * 900 + "short question"),
        (6, "the odd numbers from one up to twenty the odd numbers from one up to twenty"), (7, None), (8, ""),
        (9, "Äh short question öh"), (9, "Äh short question öh"), (None, "short question"),
    ]


def rows(df):
    return sorted(
        str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in df.collect()
    )


def test_same_as_brute_force(spark, make_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = sorted(str((i, *brute(t, ITEMS))) for i, t in texts())
    docs = make_docs(*texts())
    assert rows(contamination(docs, bench)) == expected
    for max_windows in (1, 2, 3):  # many blocks
        assert rows(contamination(docs, bench, max_windows=max_windows)) == expected
    kept = drop_contaminated(docs, bench, max_windows=3)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not brute(t, ITEMS)[-1] for _, t in texts())


def test_passages_are_in_the_original(spark, make_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r.passages for r in contamination(make_docs(*texts()[:9]), bench).collect()}
    text = texts()[0][1]
    assert [text[p.first : p.last + 1] for p in got[1]] == [ITEMS[0][1].upper().rstrip(".")]
    text = texts()[3][1]
    assert [text[p.first : p.last + 1] for p in got[4]] == ["short, QUESTION", "short   answer; nameless-item"]


def test_odd_rows(spark, messy, make_docs):
    bench = spark.createDataFrame([(1, "repeated row"), (2, "several words of one very long text several words")], "item_id long, text string")
    got = rows(contamination(messy, bench))
    items = [(r.item_id, r.text) for r in bench.collect()]
    short = [(r.doc_id, r.text) for r in messy.collect() if len(r.text or "") < 1000]
    assert set(str((i, *brute(t, items))) for i, t in short) <= set(got)
    assert len(got) == messy.count()
    assert contamination(messy, bench.where("false")).where("n_hit > 0 or contaminated").count() == 0
    assert contamination(make_docs(), bench).count() == 0
