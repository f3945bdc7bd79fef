"""Prompts are made once for each document and rule, and rules are tried on the plain form of texts with the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import queries
from docloom.operators import evidence, paragraphs, rules
from docloom.plans.registry import RULES

TEXTS = (
    "4.1 The tenant shall PAY rent of Rs. 18,000/- per month.", "4.2 Mrs 5 and HRs. 7 pay INR 9 monthly, ₹ 12 too.", "A.2 Rs. none is paid", "lıquidated damages, LİQUIDATED DAMAGES",
    "a breaK of ſick leave, unexpired period", "thirty (ſ) days notice to terminate", "Either party may end this by two months' written notice.", "ſubject to documents, or 5 May 2026",
    "No repairs shall be made; maintenance charges", "whereas it is confidential", "", "locK-in of 3 (three) months",
)


def located(spark):
    rows = [(1 + i % 2, i, t) for i, t in enumerate(TEXTS)] + [(3, 1, None)]
    return paragraphs.locate(spark.createDataFrame(rows, "doc_id long, paragraph_index int, text string"))


def test_prompts_are_shuffled_once(spark):
    plan = queries.rule_prompts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_prompts_of_first_places(spark):
    where = located(spark)
    full = evidence.review_prompts(rules.evaluate(where, RULES, "before-signing"))
    few = evidence.review_prompts(rules.evaluate(where.drop("clause"), RULES, "before-signing", details=False), rules=RULES)
    assert few.columns == full.columns
    assert sorted(map(str, few.collect())) == sorted(map(str, full.collect())) != []
    asked = {r.rule_id: r.prompt for r in few.where("doc_id = 1").collect()}
    assert asked["money.payment-terms"] == "Check clause 4.1: is Rs. 18,000/- the sum you expect, and when is it due?"


def test_the_plain_form_fires_the_same_rules(spark):
    text, form = F.col("text"), rules.plain(F.col("text"))
    tried = rules.candidates(list(enumerate(RULES)), form)
    both = [F.struct(rules.fires(r, text).alias("plainly"), (F.array_contains(tried, i) & rules.fires(r, text, form)).alias("quickly")).alias(str(i)) for i, r in enumerate(RULES)]
    for row in spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", *both).collect():
        assert all(row[str(i)].plainly == row[str(i)].quickly for i in range(len(RULES))), row.text
        assert "quidated" not in row.text or row[str([r.id for r in RULES].index("exit.remedies"))].quickly


def test_patterns_that_need_no_case():
    for p in (r"\b(?:rs[.]?|inr|₹)\s*\d(?:[\d,]*\d)?(?:\s*/-)?", r"a\p{L}*[.]?,?[0-9a-z]", r"^whereas\b"):
        assert rules.caseless(p), p
    for p in ("A", r"\w+", r"x\W", r"\p{Lu}", "[!-~]", "[0-_]", "é", r"(.)\1", r"\S"):
        assert not rules.caseless(p), p
