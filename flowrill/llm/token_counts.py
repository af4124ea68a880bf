"""Token counts by a unigram model: forward scores shared along a trie of pre-tokens.

A text is cut at white space into pre-tokens, each led by the piece mark. The best segmentation of
a pre-token into pieces maximises the sum of piece scores; characters that no piece covers cost one
token a byte. The best score of a prefix does not depend on what follows it, so distinct pre-tokens
are put in a trie and each of its nodes is scored once; a terminal node's token count is stored for
all later uses of the pre-token.

Null and empty texts have no tokens. Rows are counted one by one: repeated rows repeat their
counts, very long texts and pre-tokens are whole, and nothing is exchanged between tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
_COUNTS = "doc_id long, n_chars long, n_pretokens long, n_tokens long"


def zipf_scores(pieces: Iterable[str]) -> dict[str, float]:
    """Log probabilities of pieces by their rank, for vocabularies that carry no frequencies."""
    ranked = list(dict.fromkeys(pieces))
    total = math.fsum(1 / (rank + 2.7) for rank in range(1, len(ranked) + 1))
    return {p: -math.log((rank + 2.7) * total) for rank, p in enumerate(ranked, 1)}


def load_pieces(model_file: str) -> list[str]:
    """Text pieces of a sentencepiece model in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]


class TokenCounter:
    """Token counts of pre-tokens. At most ``limit`` of them are remembered, then the memory starts
    anew, which changes no count."""

    def __init__(self, scores: dict[str, float], limit: int = 1_000_000) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=-1.0) - 10
        self.limit = limit
        self.terminal: dict[str, int] = {}

    def insert(self, pretokens: Iterable[str]) -> None:
        """Score the trie of these pre-tokens.

        In sorted order they are the trie's terminals in preorder, so only the path to the current
        node is held: best score and token count of each of its prefixes.
        """
        get, longest = self.scores.get, self.longest
        best, count = [0.0], [0]
        before = ""
        for word in sorted(pretokens):
            path = MARK + word
            shared = 0
            for a, b in zip(before, path):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(path) + 1):
                n_bytes = len(path[end - 1].encode("utf-8"))
                top, tokens = best[end - 1] + n_bytes * self.byte, count[end - 1] + n_bytes
                for start in range(max(0, end - longest), end):
                    score = get(path[start:end])
                    if score is not None and best[start] + score > top:
                        top, tokens = best[start] + score, count[start] + 1
                best.append(top)
                count.append(tokens)
            self.terminal[word] = count[-1]
            before = path

    def count(self, texts: list[list[str]]) -> list[int]:
        """Tokens of each list of pre-tokens."""
        if len(self.terminal) > self.limit:
            self.terminal = {}
        known = self.terminal
        self.insert({w for words in texts for w in words if w not in known})
        return [sum(map(known.__getitem__, words)) for words in texts]


_COUNTERS: dict[str, TokenCounter] = {}


def counter(model_file: str) -> TokenCounter:
    """One counter per model in a worker process."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = TokenCounter(zipf_scores(load_pieces(model_file)))
    return _COUNTERS[model_file]


def token_counts(docs: DataFrame, model_file: str, block_chars: int = 2_000_000) -> DataFrame:
    """``doc_id, n_chars, n_pretokens, n_tokens`` per row; other columns are ignored.

    Texts are counted in blocks of about ``block_chars`` characters, which bounds a task's memory.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model_file)

        def block(ids: list, chars: list[int], texts: list[list[str]]) -> pa.RecordBatch:
            columns = [ids, chars, list(map(len, texts)), tokens.count(texts)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "n_chars", "n_pretokens", "n_tokens"],
            )

        for batch in batches:
            ids, chars, texts, held = [], [], [], 0
            for doc_id, scalar in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = scalar.as_py() or ""
                ids.append(doc_id)
                chars.append(len(text))
                texts.append(text.split())
                held += len(text)
                if held >= block_chars:
                    yield block(ids, chars, texts)
                    ids, chars, texts, held = [], [], [], 0
            if ids:
                yield block(ids, chars, texts)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(count, _COUNTS)
