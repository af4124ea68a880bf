from __future__ import annotations

import hashlib
from collections import Counter

from flowrill.llm.line_dedup import drop_common_lines
from flowrill.llm.queries import QUERIES
from flowrill.llm.words import LOWER, UPPER

FOLD = str.maketrans(UPPER, LOWER)


def brute(texts, min_docs, min_chars):
    """Kept text, lines and dropped lines per text."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    cut = [(t or "").split("\n") for t in texts]
    n = Counter(k for lines in cut for k in {key(x) for x in lines})
    gone = {k for k, v in n.items() if v >= min_docs and len(k) >= min_chars}
    out = []
    for lines in cut:
        kept = [x for x in lines if key(x) not in gone]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def result(docs, **options):
    rows = drop_common_lines(docs, **options).select("doc_id", "text", "kept_text", "n_lines", "n_dropped").collect()
    return Counter((r.doc_id, r.text, r.kept_text, r.n_lines, r.n_dropped) for r in rows)


def expected(rows, min_docs, min_chars):
    return Counter((r[0], r[1], *b) for r, b in zip(rows, brute([r[1] for r in rows], min_docs, min_chars)))


def test_common_lines_go_from_every_document(make_docs):
    rows = [
        (1, "Menu\nfirst\n  MENU\t\n"), (2, "menu \n\nsecond"), (3, "\x0bmEnu\r\nthird"), (4, "menü\nfirst"),
        (5, None), (6, ""), (7, "menu"), (None, "menu\nx"), (8, "first\nÀ"), (8, "à\nfirst"),
    ]
    docs = make_docs(*rows)
    for min_docs, min_chars in ((3, 1), (2, 1), (2, 0), (1, 2), (99, 1)):
        assert result(docs, min_docs=min_docs, min_chars=min_chars) == expected(rows, min_docs, min_chars)


def test_a_line_counts_once_per_document_and_repeated_rows_count(make_docs):
    rows = [(1, "a\na\na\na"), (2, "b\nc"), (2, "b\nc"), (2, "b\nc"), (3, "c\nd")]
    assert result(make_docs(*rows), min_docs=3) == expected(rows, 3, 1)


def test_very_long_texts_and_messy_rows(messy, make_docs):
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    assert result(messy, min_docs=2) == expected(rows, 2, 1)
    long = [(i, "\n".join(["shared", f"own {i} {j}"][j % 2] for j in range(60_000))) for i in range(2)]
    assert result(make_docs(*long), min_docs=2) == expected(long, 2, 1)


def test_clashing_columns_stay_and_empty_tables_work(make_docs, messy):
    out = drop_common_lines(messy)
    assert out.columns == [*messy.columns, "kept_text", "n_lines", "n_dropped"]
    clash = messy.withColumnRenamed("w", "kept_text").withColumnRenamed("key", "places")
    again = drop_common_lines(clash, min_docs=2).collect()
    assert all(r["places"] == "x" and r["kept_text"] != "x" for r in again)
    assert drop_common_lines(messy.limit(0)).count() == 0


def test_query_equals_brute_force_and_stays_on_the_jvm(spark, sf_dir, documents):
    out = QUERIES["op11_line_dedup"](spark, sf_dir)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Pandas" not in plan
    want = {
        i: (n, gone, hashlib.sha256(kept.encode()).hexdigest())
        for (i, _), (kept, n, gone) in zip(documents, brute([t for _, t in documents], 10, 1))
    }
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in out.collect()} == want
    assert any(gone for _, gone, _ in want.values())
