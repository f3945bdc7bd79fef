from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import suffix_tree
from docloom.llm.suffix_tree import Tree
from docloom.llm.words import tokens


def trained(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, tree):
    """The tree by dictionaries over all contexts; returns a row for each document."""
    end = "\n"
    docs = [(i, [*(w for w in re.split(r"[\x20\x09-\x0D]+", lower(t)) if w), end]) for i, t in rows]
    c, follow = Counter(), defaultdict(Counter)
    for i, ws in docs:
        if trained(i):
            c.update(ws)
            for k, w in enumerate(ws):
                for depth in (1, 2):
                    if k >= depth:
                        follow[tuple(ws[k - depth : k])][w] += 1
    n, v = sum(c.values()), len(c)
    states = {}

    def p(context, w):
        while context and context not in states:
            context = context[1:]
        if not context:
            return (c[w] + 1) / (n + v + 1)
        its, suffix = states[context]
        kept = its[w] - tree.discount if its[w] >= tree.symbol else 0
        return kept / its.total() + suffix * p(context[1:], w)

    for context in sorted(follow, key=len):
        its = follow[context]
        total = its.total()
        if total < tree.least or (len(context) == 2 and context[1:] not in states):
            continue
        seen = {w: k for w, k in its.items() if k >= tree.symbol}
        suffix = (total - sum(k - tree.discount for k in seen.values())) / total
        parent = {w: p(context[1:], w) for w in seen}
        nats = sum(k * math.log(((k - tree.discount) / total + suffix * parent[w]) / parent[w]) for w, k in seen.items())
        if nats + (total - sum(seen.values())) * math.log(suffix) >= tree.gain:
            states[context] = its, suffix
    out = []
    for i, ws in docs:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        score = sum(math.log10(p(tuple(ws[max(0, k - 2) : k]), w)) for k, w in enumerate(ws))
        out.append((i, not trained(i), len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return out, states


def close(got, want):
    key = lambda r: (repr(r[0]), r[2], round(r[6], 5))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-6)  # sums are rounded to about 1e-8


def corpus(n=300, seed=5):
    """A Markov chain over few words, with a hot word, a hot pair, copies, odd white space and rare words."""
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "Zz", "x1c"]
    follow = {w: draw.sample(words, 4) for w in [*words, "The"]}
    out = []
    for _ in range(n):
        said, w = [], draw.choice(words)
        for _ in range(draw.choice([0, 1, 2, 3, 30, 120])):
            said.append(w)
            if w == "The":
                w = draw.choice(["sea", "sea", draw.choice(words)])
            else:
                w = "The" if draw.random() < 0.3 else draw.choice(follow.get(w, words)) if draw.random() < 0.85 else draw.choice(words)
        said += [f"rare{draw.randrange(10**6)}"] * draw.randrange(2)
        out.append(draw.choice([" ", "\n", "\t ", "\x0b"]).join(said) + draw.choice(["", " ", "\r\n"]))
    out += [out[5]] * 30 + ["the sea " * 500, "the " * 400, None, "", " \n", "only", "a b"]
    return list(enumerate(out)) + [(None, "no id here"), (4, "twice w1 w2"), (4, "twice w1 w2")]


def test_scores_by_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("score", F.lit("clash")).withColumn("block", F.lit(1))
    tree = Tree(least=4, gain=4.0)
    want, states = brute(rows, tree)
    assert sum(len(s) == 1 for s in states) > 20 and sum(len(s) == 2 for s in states) > 20
    for block, bucket in ((2_000_000, 1_500_000), (500, 2000), (3000, 400)):  # without hot words, with some, and with hot pairs
        close(suffix_tree.score(docs, tree=tree, block=block, bucket=bucket).collect(), want)
    assert sum(r[6] for r in want if r[1]) > sum(r[5] for r in want if r[1])  # better than single words on what was held out


def test_words_of_slices():
    rows = [t for _, t in corpus()]
    every = pa.array(rows)
    want = [[w for w in re.split(r"[\x20\x09-\x0D]+", lower(t)) if w] for t in rows]
    for at, size in ((0, 400), (0, 50), (50, 100), (299, 41), (331, 0)):
        words, sizes = tokens(every.slice(at, size))
        assert words.to_pylist() == sum(want[at : at + size], []) and sizes.tolist() == [len(w) for w in want[at : at + size]]


def test_all_words_of_many_documents_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)  # several slices in a task
    got = {r.doc_id: r.n_tokens for r in suffix_tree.score(docs).collect()}
    assert got == {r.doc_id: 1 + len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]) for r in docs.collect()}


def test_hot_words_are_spread():
    hot = suffix_tree.Hot({7: 4}, frozenset({(7, 7)}), {})
    import numpy as np

    b, a, w = np.full(5000, 7), np.arange(5000), np.zeros(5000, np.int64)
    assert len(set(suffix_tree.dealt(b, a, w, hot, 50).tolist())) == 4
    same = suffix_tree.dealt(b, np.full(5000, 7), np.arange(5000), hot, 50)
    assert len(set(same.tolist())) == 4 and len(set(suffix_tree.dealt(b, b * 0 + 3, w, hot, 50).tolist())) == 1


def test_empty_tables(spark):
    assert suffix_tree.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = suffix_tree.score(spark.createDataFrame([(11, "never learned")], "doc_id long, text string")).first()
    assert not trained(11) and only.n_known == 0 and only.train_tokens == 0 and only.score == only.base_score == 0.0
