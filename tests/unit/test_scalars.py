from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.functions.dates import find_dates
from docloom.functions.stem import stem
from docloom.functions.text import clause_label, is_heading, match_form, pattern, template, tokens, word_count
from docloom.operators.rules import check
from docloom.plans.registry import RULES


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, tokens, "Don't pay 2,00,000 for a lock-in, § 7!") == ["dont", "pay", "200000", "for", "lock", "in", "7"]
    assert one(spark, tokens, "x" * 65 + " yes") == ["yes"]
    assert one(spark, tokens, "") == []


@pytest.mark.parametrize("text, yes", [("PAYMENT TERMS", True), ("4. LOCK-IN", True), ("NO PETS ARE ALLOWED.", False), ("Payment", False), ("123", False), ("", False), (None, False), ("A " * 13, False)])
def test_heading(spark, text, yes):
    assert one(spark, is_heading, text) is yes


@pytest.mark.parametrize("text, label", [("4.2 Rent", ("clause", "4.2")), ("8. Rent", ("clause", "8")), ("A. Whereas", ("recital", "A")), ("schedule  IV of", ("schedule", "schedule IV")), ("Rent 4.2", None)])
def test_clause_label(spark, text, label):
    got = one(spark, clause_label, text)
    assert (got and tuple(got)) == label


def test_match_form_and_counts(spark):
    assert one(spark, match_form, "  “Rent” –​ due ") == '"rent" - due'
    assert one(spark, word_count, " a b\tc ") == 3 and one(spark, word_count, "") == 0


def test_edges_are_ascii(spark):
    df = spark.createDataFrame([("énotice",), ("xnotice",), ("a notice.",)], "t string")
    assert [r[0] for r in df.select(F.col("t").rlike(pattern(r"\bnotice\b"))).collect()] == [True, False, True]


def test_template(spark):
    got = spark.range(1).select(template("Check {clause}: {amount|the sum}", {"clause": F.lit("clause 4"), "amount": F.lit(None).cast("string")})).first()[0]
    assert got == "Check clause 4: the sum"


def test_dates(spark):
    got = one(spark, find_dates, "On 24th day of February 2026, by March 1, 2026 or 03/04/2026; not 1.2.10, not 30/02/2026, but 25.12.26 and 2026-02-24.")
    d = dt.date
    assert [(m["date"], m["kinds"]) for m in got] == [(d(2026, 2, 24), []), (d(2026, 3, 1), []), (d(2026, 4, 3), ["day-month-order"]), (d(2026, 12, 25), ["two-digit-year"]), (d(2026, 2, 24), [])]
    assert got[2]["alternative"] == d(2026, 3, 4)
    assert one(spark, find_dates, "5 may 1776 and may 30 days") == []


@pytest.mark.parametrize("word, root", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("termination", "termin"), ("adjustment", "adjust"), ("rate", "rate"), ("controll", "control"), ("is", "is")])
def test_stem(word, root):
    assert stem(word) == root


def test_registry():
    check(RULES)
    assert len(RULES) == 34
