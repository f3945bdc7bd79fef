from __future__ import annotations

import itertools
import random
import re

from pyspark.sql import functions as F

from docloom import queries
from docloom.functions.text import ATTACHED, MAX_HEADING_WORDS, SPACE, clause_label, is_heading
from docloom.operators import rules
from docloom.plans.registry import RULES

_GAP = re.compile(SPACE + "+")


def label(text):
    words = _GAP.sub(" ", text).strip(" ").split(" ")
    first, second = words[0], words[1] if len(words) > 1 else None
    mark = re.match("[A-Za-z0-9_]*", second)[0] if second is not None else ""
    if first.lower() in ATTACHED and re.fullmatch("(?i)[ivx]+|[a-z]|[0-9]+", mark):
        return "schedule", f"{first} {mark}"
    lead = re.match("[A-Za-z0-9_.]*", first)[0]
    parts = lead.split(".")
    numbers = list(itertools.takewhile(lambda p: re.fullmatch("[0-9]+", p), parts))
    alone = len(parts) == 2 and parts[1] == "" and lead == first and second is not None
    if len(numbers) > 1:
        return "clause", ".".join(numbers)
    if alone and len(numbers) == 1:
        return "clause", parts[0]
    return ("recital", parts[0]) if alone and re.fullmatch("[A-Z]", parts[0]) else None


def heading(text):
    said = _GAP.sub(" ", text).strip(" ")
    letter = lambda c: c.isalpha()
    ends = any(letter(a) and b in ".!?।" and c in " \n" for a, b, c in zip(said, said[1:], said[2:] + "\n", strict=False))
    return any(c.isupper() for c in said) and not any(c.islower() for c in said) and not ends and len(said.split(" ")) <= MAX_HEADING_WORDS


def test_labels_and_headings_by_hand(spark):
    draw = random.Random(5)
    bits = ["4", "4.", "4.2", "4.2.", "4.a", "A.", "B", "AB.", "Schedule", "ANNEXURE", "iv", "II,", "12)", "x1.2", ".", "END.", "END!", "TERMS", "of", "É", " ", "\n", " ", "\t", "1.2(a)"]
    texts = ["", " ", *("".join(draw.choice(bits) + draw.choice(["", " ", " ", "  "]) for _ in range(draw.randrange(1, 5))) for _ in range(600))]
    texts += [" ".join(["WORD"] * n) + end for n in (11, 12, 13) for end in ("", " ", "\n", ".")]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clause_label(F.col("t")).alias("c"), is_heading(F.col("t")).alias("h")).collect()
    for r in got:
        assert (r.c and tuple(r.c)) == label(r.t) and r.h == heading(r.t), repr(r.t)


def test_candidates_by_hand(spark):
    """One pattern finds all beginnings that any rule has, also those that begin others."""
    begun = {i: rules.beginnings(r) for i, r in enumerate(RULES)}
    draw = random.Random(6)
    words = sorted({b for bs in begun.values() for b in bs or ()}) + ["n", "no", "nov", "x", "_no", "9no", "é", "may"]
    texts = ["".join(draw.choice(words) + draw.choice(["", "x", "tion"]) + draw.choice([" ", "-", "é", "_", ""]) for _ in range(6)) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.candidates(list(enumerate(RULES)), F.col("t")).alias("c")).collect()
    for r in got:
        said = [w for w in re.split("[^a-z0-9_]+", r.t) if w]
        assert r.c == [i for i, bs in begun.items() if bs is None or any(w.startswith(b) for w in said for b in bs)], r.t


def test_texts_are_made_once(spark):
    """A filter over the sentences stays above their window, so it doesn't make each text anew for every test."""
    plan = queries.clauses(spark, "/root/testdata/sf0.001").where(is_heading(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Window") and plan.count("TERMS OF PAYMENT") == 1
