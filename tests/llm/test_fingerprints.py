from __future__ import annotations

import hashlib

import numpy as np

from flowrill.llm.fingerprints import differences, edited, fingerprint_documents, likeness, paragraph_digests


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        changed = edited(text, following)
        a, b, c = (set(paragraph_digests(t).tolist()) for t in (text, changed, following))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        yield str((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9)))


def check(df, rows):
    got = df.collect()
    values = [str((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))) for r in got]
    assert sorted(values) == sorted(expected(rows))
    return got


def test_whole_table(docs_table, documents):
    got = check(fingerprint_documents(docs_table), [(i, t or "") for i, t in documents])
    by_text = {}
    for r in got:
        by_text.setdefault(dict(documents)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    assert len({p for prints in by_text.values() for p in prints}) == len(by_text)


def test_edit_takes_the_beginning_of_the_next():
    assert edited("abcdef", "XYZW") == "abcXYZ"
    assert edited("abcde", "X") == "abcX"
    assert edited("a", "XYZ") == "a" and edited("", "XYZ") == ""


def test_peeling_retries_with_larger_tables():
    rng = np.random.default_rng(5)
    shared, left, right = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (3000, 900, 40))
    a, b = np.concatenate([shared, left]), np.concatenate([right, shared])
    only_a, only_b = differences([a, a, b], [b, a, b])
    assert list(only_a) == [900, 0, 0] and list(only_b) == [40, 0, 0]
    empty = np.zeros(0, np.uint64)
    assert list(likeness([empty, empty, a], [empty, a, a])) == [1.0, 0.0, 1.0]


def test_repeated_paragraphs_count():
    one, two = paragraph_digests("Same line.\n"), paragraph_digests("Same line.\nSame line.\n")
    assert len(set(two.tolist())) == 2 and one[0] in two
    marks = "".join(f"{c}{m}" * 300 for c in "ab1" for m in "!.?\n")  # many short ones
    digests = paragraph_digests(marks)
    assert len(set(digests.tolist())) == len(digests) == 3600
    assert differences([digests], [one]) == ([3600], [1])


def test_odd_rows(messy, make_docs):
    texts = [(1, "One."), (2, None), (3, ""), (4, "Ünï çödé 漢字 🙂."), (6, "a b. " * 30_000), (None, "no id")]
    check(fingerprint_documents(make_docs(*texts)), [(i, t or "") for i, t in texts])
    assert fingerprint_documents(messy).count() == messy.count()
    check(fingerprint_documents(make_docs((1, "alone. here"))), [(1, "alone. here")])
    assert fingerprint_documents(make_docs()).count() == 0
