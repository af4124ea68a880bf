from __future__ import annotations

import public_tokenizers

from flowrill.llm.token_counts import MARK, TokenCounter, load_pieces, token_counts, zipf_scores

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, scores, byte):
    """Best segmentation of one pre-token, without sharing."""
    path = MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(path) + 1):
        n = len(path[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, best[end - 1][1] + n)]
        options += [
            (best[start][0] + scores[path[start:end]], best[start][1] + 1)
            for start in range(max(0, end - 40), end) if path[start:end] in scores
        ]
        top = max(o[0] for o in options)
        best.append(next(o for o in options if o[0] == top))
    return best[-1][1]


def test_same_as_brute_force(docs_table, documents, messy):
    scores = zipf_scores(load_pieces(MODEL))
    byte = min(scores.values()) - 10
    cache = {}

    def count(word):
        if word not in cache:
            cache[word] = brute(word, scores, byte)
        return cache[word]

    for df in (docs_table.limit(60), messy):
        expected = [(r.doc_id, len(r.text or ""), len((r.text or "").split()), sum(map(count, (r.text or "").split()))) for r in df.collect()]
        assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in token_counts(df, MODEL).collect())


def test_forgetting_and_order_change_nothing():
    scores = zipf_scores(["▁a", "a", "ab", "b", "▁ab", "c"])
    lists = [["ab", "abc", "a"], ["abab", "ab", "é"], [], ["c" * 5000]]
    whole, small = TokenCounter(scores), TokenCounter(scores, limit=0)
    expected = whole.count(lists)
    assert [small.count([x])[0] for x in reversed(lists)] == expected[::-1]
    assert expected[2] == 0 and expected[3] == 5003  # mark has three bytes


def test_empty_table(make_docs):
    assert token_counts(make_docs(), MODEL).count() == 0
