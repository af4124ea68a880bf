from __future__ import annotations

from flowrill.llm.licenses import BASE_PHRASES, TEMPLATES, Template, scan_licenses
from flowrill.llm.words import words


def brute(text):
    own = [w.decode() for w in words(text)]
    places = [
        (at, label) for phrase, label in BASE_PHRASES.items() for at in range(len(own))
        if own[at : at + len(phrase.split())] == phrase.split()
    ]
    starts = [p[0] for p in places]
    return (
        len(own), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({label for _, label in places})),
    )


def check(got, rows):
    expected = sorted(map(str, [(i, *brute(t)) for i, t in rows]))
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == expected


def test_base_places(docs_table, documents):
    check(scan_licenses(docs_table).collect(), documents)


def test_templates_need_key_phrases_in_place(make_docs):
    mit = TEMPLATES[0].text
    rows = [
        (1, "Header. " + mit.upper() + " and more"),
        (2, mit.replace("permission is hereby granted", "permission was hereby granted")),
        (3, mit.replace("this software", "this fine software")),  # second key phrase is shifted
        (4, "MIT License, Apache-License and apache license; CC-BY cc by. mıt license"),
        (5, mit + " " + mit),
        (6, mit.replace("associated", "related")),
        (7, "granted permission software charge obtaining"),
    ]
    got = {r.doc_id: r for r in scan_licenses(make_docs(*rows)).collect()}
    check(got.values(), rows)
    assert [got[i].labels for i in range(1, 8)] == ["mit", "", "", "apache,cc-by,mit", "mit", "mit", ""]
    assert got[1].score == 1 and got[2].score == 0 and 0.8 < got[6].score < 1


def test_own_templates(make_docs):
    template = (Template("own", "alpha beta gamma delta", ("beta gamma",)),)
    got = scan_licenses(make_docs((1, "x alpha beta gamma delta"), (2, "alpha beta")), {"x y": "xy"}, template)
    assert {r.doc_id: r.labels for r in got.collect()} == {1: "own", 2: ""}


def test_odd_rows(messy, make_docs):
    got = scan_licenses(messy).collect()
    check(got, [(r.doc_id, r.text) for r in messy.collect()])
    assert scan_licenses(make_docs()).count() == 0


def test_anchors_are_words_the_file_holds(make_docs):
    """Notices of little more than the key phrases: most template words occur in no document."""
    rows = [
        (1, "see the Apache License, Version 2.0 for details"),
        (2, "redistribution and use in source and binary forms is fine if following conditions are met"),  # not in place
        (3, "Covered by the Mozilla Public License"),
        (4, "mozilla, public and license; apache 2.0 version license"),
        (5, "the of is this " * 5000 + "mozilla public license"),
        (6, "license version 2 0 apache"),
        (7, "License Version 2.0 the Apache License Version 2.0"),  # cut at the beginning
        *[(i, "the of is this") for i in range(8, 14)],  # common words
    ]
    got = {r.doc_id: r for r in scan_licenses(make_docs(*rows)).collect()}
    check(got.values(), rows)
    assert [got[i].labels for i in range(1, 8)] == ["apache", "", "mpl", "", "mpl", "", "apache"]
    assert 0 < got[3].score < 1 and got[4].score == 0


def test_agreement_needs_different_words(make_docs):
    template = (Template("own", "alpha x alpha beta gamma", ("alpha",)),)
    got = scan_licenses(make_docs((1, "alpha y alpha"), (2, "alpha y alpha beta")), {"u v": "uv"}, template)
    assert {r.doc_id: r.labels for r in got.collect()} == {1: "", 2: "own"}
