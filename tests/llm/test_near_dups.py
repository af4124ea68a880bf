from __future__ import annotations

import random
from collections import Counter

import numpy as np

from flowrill.llm.dart_minhash import DartMinHash
from flowrill.llm.near_dups import drop_near_copies, near_classes, occurrence_codes, outlines, shingle_counts
from flowrill.llm.words import words


def shingles(text):
    own = words(text)
    if len(own) < 5:
        return Counter([tuple(own)] if own else [])
    return Counter(zip(own, own[1:], own[2:], own[3:], own[4:]))


def brute(rows):
    """Class of each (doc_id, text): smallest doc_id reachable by links, all pairs compared."""
    bags = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            common, total = sum((a & b).values()), sum(a.values()) + sum(b.values())
            if 9 * common >= 4 * total and (total or a == b):
                parent[find(i)] = find(j)
    classes = {}
    for i, (doc_id, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        own = classes[find(i)]
        known = [d for d in own if d is not None]
        out.append(str((doc_id, min(known) if known else None, len(own))))
    return sorted(out), len(classes)


def check(df, rows):
    got = near_classes(df).collect()
    expected, n = brute(rows)
    assert sorted(str((r.doc_id, r.class_id, r.class_size)) for r in got) == expected
    assert sum(r.keep for r in got) == n
    assert all(r.class_id == r.doc_id for r in got if r.keep)


def test_small_table(docs_table, documents):
    check(docs_table, documents)


def test_hub_whose_copies_are_far_from_each_other(make_docs):
    """Copies link to one text only, which is not among the first pivots of every bucket."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        copy = base[:]
        for at in rng.sample(range(300), 5):
            copy[at] = f"x{i}v{at}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(50))) for i in range(20)]
    check(make_docs(*rows), rows)


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    one, two = rng.integers(1, 20, 300).astype(float), rng.integers(1, 20, 300).astype(float)
    true = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    seen = [
        (d.signature(elements, one) == d.signature(elements, two)).mean()
        for d in (DartMinHash(128, seed) for seed in range(40))
    ]
    assert abs(np.mean(seen) - true) < 0.02
    single = DartMinHash(64).signature(elements[:1], np.array([1.0]))
    assert len(set(single.tolist())) == 64  # every coordinate is filled


def test_codes_count_occurrences():
    a, b = (occurrence_codes(*shingle_counts(t)) for t in ("a a a a a a a", "a a a a a a b"))
    assert len(a) == 3 and len(set(a.tolist()) & set(b.tolist())) == 2


def test_odd_rows(messy, make_docs):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    check(messy, rows)
    kept = drop_near_copies(messy)
    assert kept.columns == messy.columns
    assert kept.count() == brute(rows)[1]
    assert Counter(r.doc_id for r in kept.collect() if r.text == "repeated row") == {5: 1}
    assert near_classes(make_docs()).count() == 0 and drop_near_copies(make_docs()).count() == 0


def test_many_sets_are_signed_as_one_by_one():
    rng = np.random.default_rng(4)
    sets = [(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), None) for n in (1, 0, 3, 700, 20_000, 2)]
    sets = [(e, rng.integers(1, 9, len(e)).astype(float)) for e, _ in sets]
    dart = DartMinHash(192)
    rows = dart.signatures(np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]), np.array([len(e) for e, _ in sets]))
    assert [r.tolist() for r in rows] == [dart.signature(e, w).tolist() if len(e) else [0] * 192 for e, w in sets]


def test_few_darts_are_thrown_for_a_large_set(monkeypatch):
    thrown = []
    own = DartMinHash._darts
    monkeypatch.setattr(DartMinHash, "_darts", lambda self, *a: thrown.append(own(self, *a)) or thrown[-1])
    elements = np.random.default_rng(6).integers(0, 2**63, 20_000).astype(np.uint64)
    DartMinHash(192).signature(elements, np.ones(20_000))
    assert sum(len(dart) for dart, _, _ in thrown) < 4000


def test_outlines_never_rule_out_a_link():
    rng = random.Random(7)
    for _ in range(200):
        a = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 300))]
        b = a[:]
        for _ in range(rng.randrange(0, 20)):
            b[rng.randrange(len(b))] = f"v{rng.randrange(400)}"
        codes = [occurrence_codes(*shingle_counts(" ".join(x))) for x in (a, b)]
        bits = [np.unpackbits(outlines(c, np.array([len(c)])).view(np.uint8)) for c in codes]
        total, common = sum(map(len, codes)), len(set(codes[0].tolist()) & set(codes[1].tolist()))
        assert (bits[0] != bits[1]).sum() <= total - 2 * common
        if 9 * common >= 4 * total:
            assert 9 * (bits[0] != bits[1]).sum() <= total


def test_exact_comparison_gives_the_same_classes(docs_table):
    plain, exact = (near_classes(docs_table, deviations=d).select("doc_id", "class_id").collect() for d in (4.0, None))
    assert Counter(plain) == Counter(exact)
