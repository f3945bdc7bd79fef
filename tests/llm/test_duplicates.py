from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import minhash_dedup, parse_dedup


def near_copies(seed=2, families=12, size=12):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6)))
    out = []
    for _ in range(families):
        base = [word() for _ in range(120)]
        for k in range(size):
            copy = list(base)
            for _ in range(k // 2):
                copy[draw.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out + ["a b", "a b", "A B", "", None, "solo"]


def sets_of(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(texts, n):
    sets = [sets_of(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 5)  # many cells for each bucket
    texts = near_copies()
    want, sizes = brute(texts, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.lit("clash"))
    for hubs in (True, False):
        got = minhash_dedup.link(docs, hubs=hubs).orderBy("doc_id").collect()
        assert [r.component_id for r in got] == want and [r.n_shingles for r in got] == sizes
        assert [r.kept for r in got] == [i == w for i, w in enumerate(want)]


def test_words_that_polynomial_hashes_confuse_stay_apart(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"{word} x y z", f"{other} x y z", word.upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in minhash_dedup.link(docs).orderBy("doc_id").collect()] == [0, 1, 2, 3, 0]


def test_recall_on_documents(spark):
    """Every link that all pairs of the smallest table have is found, and no other."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    for n in (4, 5):
        want, sizes = brute([r.text for r in rows], n)
        got = minhash_dedup.link(docs, n=n).orderBy("doc_id").collect()
        linked = sum(w != i for i, w in enumerate(want))
        found = sum(g.component_id != g.doc_id for g in got)
        print(f"{n} words: {found} of {linked} documents linked to an earlier one")
        assert linked and [g.component_id for g in got] == [rows[w].doc_id for w in want] and [g.n_shingles for g in got] == sizes


def test_near_duplicate_edge_cases(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")]
    got = minhash_dedup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash_dedup.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    draw = random.Random(0)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = defaultdict(lambda: None)

    def find(i):
        root[i] = i if root[i] is None else root[i]
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.component for r in minhash_dedup.components(spark.createDataFrame(edges, "a long, b long"), len(edges))[0].collect()}
    assert all(got.get(i, i) == find(i) for i in list(root))


@pytest.mark.parametrize("chunk", [4096, 3])
def test_repeats_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(parse_dedup, "CHUNK", chunk)  # 3: most triggers have their contexts in several parts
    monkeypatch.setattr(parse_dedup, "BATCH", 7)
    draw = random.Random(4)
    part = lambda n: "".join(draw.choice("abcde é ") for _ in range(n))
    shared = [part(draw.randint(150, 700)) for _ in range(8)]
    texts = ["".join(draw.choice([part(draw.randint(0, 300)), draw.choice(shared), draw.choice(shared)[50:-40]]) for _ in range(draw.randint(0, 5))) for _ in range(80)]
    texts += ["x" * 1000, "ab" * 300, None, "", part(199), *[part(250)] * 2, "y" * 201, "z" * 200]
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(5)
    for r in parse_dedup.remove_repeats(docs).collect():
        d = data[r.doc_id]
        gone = [any(seen[d[i : i + 200]] > 1 for i in range(max(0, j - 199), min(j, len(d) - 200) + 1)) for j in range(len(d))]
        assert bytes(r.kept) == bytes(c for c, g in zip(d, gone, strict=True) if not g), r.doc_id
        assert sum(x.b - x.a for x in r.removed) == sum(gone) and r.n_bytes == len(d)
    assert parse_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_repeats_with_null_and_equal_keys(spark):
    draw = random.Random(9)
    text = "".join(draw.choice("abcdefg ") for _ in range(300))
    rows = [(None, text), (1, text[:250]), (1, "short"), (1, "short")]
    got = sorted((r.text, len(r.kept)) for r in parse_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(text, 50), (text[:250], 0), ("short", 5), ("short", 5)])
