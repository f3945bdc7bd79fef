from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from docloom.llm import middle_fill


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, out[0], len(p), len(m), out[1], text


def cases():
    draw = random.Random(13)
    odd = ["", None, " ", "<P>", "a<", "<S", "<<S", "x<M>y", "P>S>M>", "é \U0001f469‍\U0001f4bb!", "a\nb\r\n\tc", "nul\0here", "﻿bom", "<" * 50, "日本語 text" * 9000]
    made = ["".join(draw.choice(["ab", "Z", "é", "<", "S>", "P>", "\n", " ", "1", "日"]) for _ in range(draw.randrange(60))) for _ in range(400)]
    return list(enumerate(odd + made)) + [(None, "no id"), (7, "twice"), (7, "twice"), (-3, "below zero")]


def test_fill_in_middle_by_brute_force(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("output", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    made = middle_fill.fill_in_middle(docs)
    want = sorted((brute(*r) for r in rows), key=repr)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == sorted((w[:6] for w in want), key=repr)
    back = {(r.form, r.output): r.restored for r in middle_fill.restore(made).collect()}
    assert all(back[w[2], w[5]] == w[6] for w in want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted((tuple(r) for r in middle_fill.digests(docs).collect()), key=repr)
    assert got == sorted(((*w[:5], sha(w[5]), sha(w[6])) for w in want), key=repr)


def test_fill_in_middle_edges(spark):
    assert middle_fill.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    named = spark.createDataFrame([("a-1", "some text here")], "name string, body string")
    assert middle_fill.fill_in_middle(named, "name", "body").columns[0] == "name"
    whole = "word " * 400_000
    row = middle_fill.digests(spark.createDataFrame([(5, whole)], "doc_id long, text string")).first()
    assert row.n == 800_000 and row.restored_sha256 == hashlib.sha256(whole.encode()).hexdigest()
