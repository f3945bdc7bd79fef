from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import attention_quality, quality_rules

CLEAN = "the of and to in is it for on with as was by at from that this have not are".split()


def corpus(spark, n=240):
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(CLEAN) + draw.choice(["", "ing", "tion", "al", "er"]) for _ in range(draw.randint(30, 120))]
        bad = i % 6 == 0
        text = " ".join(w + draw.choice(["###", "$$$", "***"]) for w in words) if bad else " ".join(words).capitalize() + "."
        rows.append((i, text, "en", "s0" if i % 5 else None))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int")


def brute_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    marked = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    return len(marked)


def test_counts_by_brute_force():
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice(["a ", "b ", "c# ", "\n", "D", " ", "é\t", "\x0b", " ", "!"]) for _ in range(draw.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = dict(zip(quality_rules.COUNTS, quality_rules.counted(text), strict=True))
        assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words)) and got["n_repeat_words"] == brute_repeats(words)
        assert got["n_dup_lines"] == len(lines) - len(set(lines)) and got["n_symbols"] == sum(c in "#*$%&|<>" for c in text)


def test_outliers_go_and_clean_stays(spark):
    docs, labels = corpus(spark)
    got = quality_rules.judge(docs.withColumn("n_words", F.lit("clash"))).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.all() and not got[got.quality == 0].kept.any() and len(got) == 240


def test_estimates_by_brute_force(spark):
    """The same concentration steps with numpy on all rows of each group."""
    docs, _ = corpus(spark)
    every = quality_rules.statistics(docs).withColumn("g", quality_rules.group_key()).withColumn("x", F.array(*quality_rules.vector()))
    made, n = quality_rules.estimates(every.select("g", "x"))
    assert n == 2
    rows = every.select("g", "x").toPandas()
    for r in made.collect():
        x = np.array(rows[rows.g == r.g].x.tolist())
        m, v = np.array(r.m), np.array(r.v).reshape(quality_rules.P, -1)
        d = np.einsum("ij,jk,ik->i", x - m, v, x - m)
        near = x[d <= np.sort(d)[int(np.ceil(quality_rules.SHARE * len(x))) - 1]]
        assert np.allclose(near.mean(0), m, atol=0.15)  # a step more hardly moves the centre
        assert (d > quality_rules.CUTOFF).mean() < 0.25


def test_rules_edge_cases(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "one two " * 30, "en", "a"), (None, " ".join(map(str, range(50))), "en", "a"), (5, "é " * 20000, None, "a")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1].base_failed and got[2].base_failed and got[3].base_failed and got[None].kept and got[5].n_words == 20000
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_classifier_held_out(spark):
    docs, labels = corpus(spark)
    model = attention_quality.train(docs, labels)
    rows = docs.withColumn("score", F.lit("clash"))
    got = attention_quality.score(rows, model).join(labels, "doc_id").withColumn("out", attention_quality.held_out(F.col("doc_id"))).toPandas()
    held = got[got.out]
    assert len(held) > 30 and (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x" * 100_000)], "doc_id long, text string")
    assert attention_quality.score(odd, model).count() == 4 and attention_quality.score(odd.limit(0), model).count() == 0
    assert attention_quality.train(docs, labels.limit(0)) is not None


def test_gradient():
    draw = np.random.default_rng(0)
    each, y = np.array([2, 3, 1]), np.array([1.0, 0.0, 1.0])
    x, w = draw.normal(size=(6, attention_quality.N_FEATURES)), np.full(3, 1 / 3)
    model = attention_quality.Model(hidden=3)
    loss = lambda: float(-(w * (y * np.log(s := model.forward(x, each)[0]) + (1 - y) * np.log(1 - s))).sum())
    for k, g in model._gradient(x, each, y, w).items():
        at = tuple(0 for _ in g.shape)
        old = model.p[k][at]
        model.p[k][at] = old + 1e-5
        up = loss()
        model.p[k][at] = old - 1e-5
        down = loss()
        model.p[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6
