from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from docloom.operators import claims


def brute(rows, against, n=8):
    said = lambda t: re.findall(r"[a-z0-9é']+", (t or "").lower().replace("’", "'"))
    made = lambda t: {" ".join(w[i : i + n]) for w in [said(t)] for i in range(len(w) - n + 1)}
    out = {}
    for k, t in rows:
        for j, u in against:
            if k is not None and j is not None:
                out.setdefault((k, j), set()).update(made(t) & made(u))
    return {k: len(v) for k, v in out.items() if v}


def test_echoes_by_brute_force(spark):
    draw = random.Random(3)
    word = lambda: draw.choice(["a", "b", "c", "it’s", "d9", "é", "Long"])
    items = [(j, " ".join(word() for _ in range(draw.randrange(30)))) for j in range(12)] + [(99, None), (None, "a " * 20), (98, "")]
    rows = []
    for k in range(60):
        text = " ".join(word() for _ in range(draw.randrange(25)))
        if k % 3 == 0:
            text += ", " + (items[draw.randrange(12)][1] or "") + "! " + word()
        rows.append((k, text))
    rows += [(70, "a " * 40), (70, "b " * 40), (None, rows[0][1]), (71, None), (72, "a​ " * 20)]
    left = spark.createDataFrame(rows, "k long, text string").withColumn("run", F.lit("clash"))
    right = spark.createDataFrame(items, "j long, text string").withColumn("h", F.lit(1))
    want = brute([(k, (t or "").replace("​", "")) for k, t in rows], items)
    assert want
    for few in (claims.FEW_RUNS, 0):
        got = {(r.k, r.j): r.shared for r in claims.echoes(left, right, "k", "j", few=few).collect()}
        assert got == want
    none = spark.createDataFrame([], "j long, text string")
    assert claims.echoes(left, none, "k", "j").count() == 0


def test_validate_tells_exact_echoes(spark):
    told = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    chunks = spark.createDataFrame([(1, "p1", "The tenant shall pay rent.")], "response_id int, chunk_id string, text string")
    padding = "quite other words stand around here in great number so that shares are low " * 2
    said = [f"{padding} five six seven eight nine ten eleven twelve {padding}", f"{padding} five six seven {padding}"]
    rows = spark.createDataFrame([(1, i, t, "shall pay rent", ["p1"]) for i, t in enumerate(said)], "response_id int, claim_index int, text string, quote string, source_chunk_ids array<string>")
    assert [r.reason for r in claims.validate(rows, chunks, [told]).orderBy("claim_index").collect()] == ["instructions-echoed", None]
