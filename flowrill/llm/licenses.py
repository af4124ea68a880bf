"""Licence scans with a positional index of rare words.

Licence templates are word lists with postings (word, template, position). In each file the
template words it holds with the highest inverse document frequency are looked up; postings of
different words that agree on where the template would begin are an alignment, and an alignment
counts if all mandatory key phrases of the template stand at their places. A base phrase is a
template that is itself one key phrase: every place of its rarest word is tried, so all its places
are found.

Null and empty texts have no words, no labels and score 0. Every row is judged alone, whole, and
nothing but the document frequencies of template words (fewer rows than template words) is
exchanged, so hot groups, repeated rows and very long texts need no special care. Columns other
than ``doc_id`` and ``text`` are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowrill.llm.words import word_array


@dataclass(frozen=True)
class Template:
    """A licence text and the phrases in it that must be present; words are blank-separated."""

    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_places(self) -> list[tuple[int, list[str]]]:
        """First position and words of each key phrase."""
        words, places = self.words, []
        for key in self.keys:
            own = key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
            places.append((at, own))
        return places


# Phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

TEMPLATES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except "
        "in compliance with the license",
        ("apache license version 2 0",),
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of "
        "the gnu general public license as published by the free software foundation",
        ("redistribute it and or modify it", "gnu general public license"),
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of "
        "the gnu lesser general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Template(
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution",),
    ),
)


def base_templates(phrases: dict[str, str]) -> list[Template]:
    return [Template(label, phrase, (phrase,)) for phrase, label in phrases.items()]


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents in all, and how many hold each word of the (small) vocabulary."""
    present = F.array_intersect(word_array(F.col("text")), F.array(*map(F.lit, vocabulary)))
    rows = (
        docs.select(F.explode(F.array_append(present, F.lit(""))).alias("word"))  # "" counts documents
        .groupBy("word").agg(F.count("*").alias("n")).collect()
    )
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def _literals(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def _anchors(template: Template, ids: dict[str, int], n: int) -> Column:
    """The ``n`` rarest of the template's words that the file holds; ids count up from the rarest."""
    own = sorted({ids[w] for w in template.words})
    return F.slice(F.array_intersect(_literals(own), "present"), 1, n)


def _postings(template: Template, ids: dict[str, int], anchors: str) -> Column:
    """Sorted numbers of (start, word): where the template would begin for each posting of an anchor.

    Files that lack a word of a key phrase, or hold too few anchors to agree, have none.
    """
    at = {}
    for place, word in enumerate(template.words):
        at.setdefault(ids[word], []).append(place)
    places = F.create_map(*[c for i, own in at.items() for c in (F.lit(i), _literals(own))])
    keys = sorted({ids[w] for key in template.keys for w in key.split()})

    def numbers(hit: Column) -> Column:
        start = lambda place: (hit["at"] - place).cast("long")
        return F.transform(F.element_at(places, hit["id"]), lambda p: F.shiftleft(start(p), 32) + hit["id"])

    possible = (F.size(F.array_except(_literals(keys), "present")) == 0) & (F.size(anchors) >= _needed(template))
    own = F.filter("hits", lambda h: F.array_contains(anchors, h["id"]))
    return F.when(possible, F.sort_array(F.flatten(F.transform(own, numbers)))).otherwise(
        F.array().cast("array<bigint>")
    )


def _needed(template: Template) -> int:
    """How many different words must agree on a start."""
    return min(2, len(set(template.words)))


def _agreed(template: Template, postings: str) -> Column:
    """Starts on which enough different words agree: in the sorted numbers they are neighbours."""

    def agrees(number: Column, i: Column) -> Column:
        after = F.get(postings, i + 1)
        return (F.shiftright(after, 32) == F.shiftright(number, 32)) & (after != number)

    numbers = F.filter(postings, agrees) if _needed(template) > 1 else F.col(postings)
    return F.array_distinct(F.transform(numbers, lambda number: F.shiftright(number, 32).cast("int")))


def _stands(start: Column, at: int, phrase: list[str]) -> Column:
    """Whether the phrase stands ``at`` words after ``start``."""
    first = start + F.lit(at)
    return reduce(
        Column.__and__,
        [first >= 0] + [F.get("w", first + F.lit(i)).eqNullSafe(F.lit(word)) for i, word in enumerate(phrase)],
    )


def _base_places(template: Template, ids: dict[str, int]) -> Column:
    """Every place where the phrase stands, by its rarest word, with its label."""
    rarest = min(template.words, key=ids.get)
    hits = F.filter("hits", lambda h: h["id"] == F.lit(ids[rarest]))

    def starts(at: int) -> Column:
        return F.transform(hits, lambda h: h["at"] - F.lit(at))

    every = reduce(F.concat, [starts(at) for at, word in enumerate(template.words) if word == rarest])
    places = F.filter(every, lambda s: _stands(s, 0, template.words))
    return F.transform(places, lambda s: F.struct(s.cast("long").alias("at"), F.lit(template.label).alias("label")))


def _best_share(template: Template, agreed: Column, idf: dict[str, float]) -> Column:
    """Largest share of the template's weight in its place over the verified alignments, else 0."""
    weight = sum(idf[w] for w in template.words)

    def share(start: Column) -> Column:
        parts = [
            F.when(_stands(start, at, [word]), F.lit(idf[word] / weight)).otherwise(0.0)
            for at, word in enumerate(template.words)
        ]
        return reduce(Column.__add__, parts)

    def verified(start: Column) -> Column:
        return reduce(Column.__and__, [_stands(start, at, key) for at, key in template.key_places()])

    return F.coalesce(F.array_max(F.transform(F.filter(agreed, verified), share)), F.lit(0.0))


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] | None = None, templates: tuple[Template, ...] = TEMPLATES,
    n_rare: int = 4,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Of each template, the ``n_rare`` rarest words that the file holds are looked up in it; the
    template's alignment needs two of them in agreement and all its key phrases. ``score`` is the largest share of a found
    template's weight (inverse document frequencies of its words) that stands in its place, 1 for a
    base phrase, 0 if nothing is found.
    """
    base = base_templates(BASE_PHRASES if phrases is None else phrases)
    vocabulary = sorted({w for t in [*base, *templates] for w in t.words})
    n_docs, frequency = document_frequencies(docs.select("text"), vocabulary)
    idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1e-9 for w in vocabulary}

    ids = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (-idf[w], w)), start=1)}
    by_id = F.array(*map(F.lit, ids))

    found = docs.select("doc_id", word_array(F.col("text")).alias("w")).withColumn(
        "hits",
        F.filter(
            F.transform("w", lambda word, i: F.struct(i.alias("at"), word.alias("word"))),
            lambda h: h["word"].isin(vocabulary),
        ),
    )
    found = found.withColumn(
        "hits",
        F.transform(
            "hits",
            lambda h: F.struct(h["at"].alias("at"), F.array_position(by_id, h["word"]).cast("int").alias("id")),
        ),
    )
    found = found.withColumn("present", F.array_distinct(F.transform("hits", lambda h: h["id"])))
    found = found.withColumn("base", reduce(F.concat, [_base_places(t, ids) for t in base]))

    columns = []
    for number, template in enumerate(templates):
        anchors, postings, share = f"anchors{number}", f"postings{number}", f"share{number}"
        columns.append((template.label, share))
        found = (
            found.withColumn(anchors, _anchors(template, ids, n_rare))
            .withColumn(postings, _postings(template, ids, anchors))
            .withColumn(share, _best_share(template, _agreed(template, postings), idf)).drop(anchors, postings)
        )

    own = F.filter(
        F.array(*[F.when(F.col(c) > 0, F.lit(label)) for label, c in columns]), lambda x: x.isNotNull()
    )
    labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    at = F.transform("base", lambda b: b["at"])
    best = F.greatest(*[F.col(c) for _, c in columns], F.when(F.size("base") > 0, 1.0).otherwise(0.0))
    return found.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, own)), ",").alias("labels"),
        F.least(best, F.lit(1.0)).alias("score"),
    )
