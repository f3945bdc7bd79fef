"""License scans by a positional index of rare licence words, in DataFrame operations only.

The templates' words, without function words, form the licence vocabulary. Their document
frequencies over all files give each word's IDF. Each template is looked up by the words of highest
IDF of its mandatory key phrase: each place of the first of them, less the word's place in the
template, proposes a start; starts that the postings of the others share are kept. Such a start
counts when the key phrase stands at its place, word for word. A key phrase that stands in a file
has all of these words in their places, so no template and no place is missed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import let, lower_ascii

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base count and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, text and mandatory key phrase of each template, in lower case. Public licence wording.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "this library is licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "this work is licensed under the gnu affero general public license", "affero general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("apache-2.0", "licensed under the apache license v2 0", "apache license v2 0"),
    ("gpl-2.0", "licensed under the gnu gpl v2", "gnu gpl v2"),
    ("gpl-3.0", "licensed under the gnu gpl v3", "gnu gpl v3"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", "lesser general public license version 2 1"),
    ("lgpl-3.0", "gnu lesser general public license version 3", "lesser general public license version 3"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("apache-2.0", "spdx license identifier apache 2 0", "spdx license identifier apache 2 0"),
    ("gpl-2.0", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2 0"),
    ("gpl-3.0", "spdx license identifier gpl 3 0", "spdx license identifier gpl 3 0"),
    ("mpl-2.0", "spdx license identifier mpl 2 0", "spdx license identifier mpl 2 0"),
    ("bsd-2-clause", "spdx license identifier bsd 2 clause", "bsd 2 clause"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause", "bsd 3 clause"),
)
#: Words of the templates that are not indexed.
FUNCTION_WORDS = frozenset("a and any are by for free in is of or provided that the this to under use v with without work 0 1 2 3 4".split())


def words(text: Column) -> Column:
    """Words of the lower-cased text; none for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()} - FUNCTION_WORDS)


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many files each licence word stands, and the number of files. As many rows as the vocabulary has words."""
    listed = F.array(*map(F.lit, vocabulary()))
    # The posting list of a word that no file has is never used; one pass with map-side sums.
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(listed, words(F.col(text))))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in found.collect()}
    return counts, counts.pop("", 0)


def _array_of(values: list) -> Column:
    return F.array(*(F.lit(v) for v in values))


def scan(docs: DataFrame, text: str = "text", rare_words: int = 4, counts: tuple[dict[str, int], int] | None = None) -> DataFrame:
    """The columns of docs, with n_words, places, base_labels, labels and score.

    places lists (start, label) of the base phrases in order of start; base_labels and labels are
    sorted arrays without repeats; score is the best share of a verified template's words that stand
    where the template has them, 0.0 without one. A null or empty text has no words, no places and
    no labels. Ties in IDF go by the word. rare_words licence words of each template's key phrase (one
    at least) are looked up at all of their places; texts are never cut. Columns of docs that clash with these names are replaced.
    """
    frequency, n = counts or document_frequency(docs, text)
    idf = {w: math.log((n + 1) / (frequency.get(w, 0) + 1)) for w in vocabulary()}
    places_of: list[list[tuple[int, str]]] = []  # of each template its looked-up words, the rarest first, with their places
    for _, said, key in TEMPLATES:
        at, rare = len(said[: f" {said} ".index(f" {key} ")].split()), sorted(set(key.split()) - FUNCTION_WORDS, key=lambda w: (-idf[w], w))
        places_of.append([(at + key.split().index(w), w) for w in rare[: max(1, rare_words)]])
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, ((at, w), *_) in enumerate(places_of):
        postings.setdefault(w, []).append((k, at))
    index = F.create_map(*(x for w in postings for x in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("t"), F.lit(at).alias("at")) for k, at in postings[w])))))
    rarest = F.array(*(F.array(*(F.struct(F.lit(at).alias("at"), F.lit(w).alias("x")) for at, w in of)) for of in places_of))
    said = F.array(*(_array_of(t.split()) for _, t, _ in TEMPLATES))
    must = F.array(*(_array_of(p.split()) for _, _, p in TEMPLATES))
    must_at = _array_of([len(t[: f" {t} ".index(f" {p} ")].split()) for _, t, p in TEMPLATES])
    names = _array_of([label for label, _, _ in TEMPLATES])

    def stands(w: Column, p: Column) -> Column:
        right = F.transform(F.get(must, p["t"]), lambda x, k: F.coalesce(F.get(w, p["start"] + F.get(must_at, p["t"]) + k) == x, F.lit(False)))
        return F.forall(right, lambda ok: ok)

    def share(w: Column, p: Column) -> Column:
        right = F.transform(F.get(said, p["t"]), lambda x, k: F.coalesce(F.get(w, p["start"] + k) == x, F.lit(False)))
        return F.size(F.filter(right, lambda ok: ok)) / F.size(right)

    def proposals(w: Column, rare: Column) -> Column:
        """Each place of a template's rarest word proposes a start of the template."""
        hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: F.array_contains(rare, h["x"]))
        return F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["x"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["at"]).alias("start")))))

    def shared(w: Column, p: Column) -> Column:
        """The template's other looked-up words propose this same start."""
        return F.forall(F.get(rarest, p["t"]), lambda r: F.coalesce(F.get(w, p["start"] + r["at"]) == r["x"], F.lit(False)))

    def aligned(w: Column, rare: Column) -> Column:
        kept = F.filter(F.filter(proposals(w, rare), lambda p: shared(w, p)), lambda p: stands(w, p))
        return F.transform(kept, lambda p: F.struct(F.get(names, p["t"]).alias("label"), share(w, p).alias("share")))

    def found(w: Column, rare: Column) -> Column:
        nothing = F.array().cast("array<struct<label:string,share:double>>")
        return F.when(F.size(rare) > 0, aligned(w, rare)).otherwise(nothing)

    def base(w: Column) -> Column:
        places = F.flatten(F.array(*(_phrase_places(w, phrase.split(), label) for phrase, label in PHRASES)))
        return F.when(F.array_contains(w, "license"), F.array_sort(places)).otherwise(F.array().cast("array<struct<start:int,label:string>>"))

    def result(w: Column) -> Column:
        rare = F.array_intersect(_array_of(list(postings)), w)
        return F.struct(F.size(w).cast("long").alias("n_words"), base(w).alias("places"), let(rare, lambda r: found(w, r)).alias("found"))

    out = docs.withColumn("_scan", let(words(F.col(text)), result))
    places, hits = F.col("_scan.places"), F.col("_scan.found")
    base_labels = F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"])))
    return out.withColumns({
        "n_words": F.col("_scan.n_words"),
        "places": places,
        "base_labels": base_labels,
        "labels": F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(hits, lambda f: f["label"])))),
        "score": F.coalesce(F.array_max(F.transform(hits, lambda f: f["share"])), F.lit(0.0)),
    }).drop("_scan")


def _phrase_places(w: Column, phrase: list[str], label: str) -> Column:
    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: _all([F.get(w, i + k) == x for k, x in enumerate(phrase)]))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _all(tests: list[Column]) -> Column:
    out = F.coalesce(tests[0], F.lit(False))
    for t in tests[1:]:
        out = out & F.coalesce(t, F.lit(False))
    return out
