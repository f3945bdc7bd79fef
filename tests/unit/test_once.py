"""What costs most is done once for each text: told from the plans, and by results that must stay."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docloom.functions.dates import find_dates
from docloom.functions.text import tokens
from docloom.operators import ask, evidence, paragraphs, retrieval, rules
from docloom.plans.registry import RULES

TEXTS = ["Due on Monday, 5th day of May 2026, or 7 May 2026. Paid 03/04/2025, not 1.2.3.4 nor 12345/-.", "A. Rao (Ms. B.) met. \"Yes.\" Then he left! No. 5 stays."]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def located(spark):
    rows = [(1, i, t) for i, t in enumerate(TEXTS, 1)] + [(2, 1, None)]
    return paragraphs.locate(spark.createDataFrame(rows, "doc_id long, paragraph_index int, text string"))


def test_places_look_for_a_match_once(spark):
    hits = located(spark).withColumn("matched", F.lit("met"))
    assert plan(ask.places(hits)).count("instr(") == 1
    got = {r.paragraph_index: r.said for r in ask.places(hits.where("text IS NOT NULL")).collect()}
    assert got[1] is None and got[2].text == got[2].quote == "A. Rao (Ms. B.) met."


def test_sentences_are_cut_at_the_same_places(spark):
    one = spark.createDataFrame([(TEXTS[1],)], "t string").select(F.split("t", ask.BETWEEN, -1)).first()[0]
    assert one == ["A. Rao (Ms. B.) met. ", '"Yes." ', "Then he left! ", "No. 5 stays."]
    assert ask.BETWEEN.index("(?=") < ask.BETWEEN.index("{1,32}")  # the long look back comes last


def test_candidates_are_made_once(spark):
    said = plan(rules.evaluate(located(spark), RULES, "before-signing", details=False))
    assert said.count("regexp_extract_all(") == 1


def test_dates_scan_a_text_once_for_each_form(spark):
    found = evidence.dates(located(spark))
    assert plan(found).count("regexp_extract_all(text") == 3
    got = [(r.written, r.date) for r in found.orderBy("at").collect()]
    assert got == [("Monday, 5th day of May 2026", dt.date(2026, 5, 5)), ("7 May 2026", dt.date(2026, 5, 7)), ("03/04/2025", dt.date(2025, 4, 3))]
    assert [r[0] for r in located(spark).orderBy("doc_id", "paragraph_index").select(F.size(find_dates(F.col("text")))).collect()] == [3, 0, 0]


def test_evidence_is_not_joined_with_the_paragraphs(spark):
    where = located(spark)
    found = evidence.evidence(where, rules.evaluate(where, RULES, "before-signing", details=False))
    assert "Join" not in plan(found)
    assert {r.field: r.places for r in found.collect()}["dates"] == [1]


def test_tokens_of_any_length(spark):
    t = "a 1 bb é été 1,234,5 don't " + "x" * 64 + " " + "y" * 65 + " 7a १ ź"
    got = spark.createDataFrame([(t,)], "t string").select(tokens(F.col("t"))).first()[0]
    assert got == ["1", "bb", "été", "12345", "dont", "x" * 64, "7a", "१"]


def test_an_index_tokenises_once(spark):
    chunks = spark.createDataFrame([(1, 1, "ties and a tie of 12 notices"), (1, 2, "Notice 12"), (2, 1, "ti 12")], "doc_id int, paragraph_index int, text string")
    asked = spark.createDataFrame([(1, "tied notices 12"), (2, "ti")], "query_id int, query string")
    terms = retrieval.query_terms(asked)
    built = retrieval.index(chunks, terms=terms)
    assert not any("regexp" in plan(part) for part in built[1:]) and "regexp" not in plan(built[0])
    every = retrieval.index(chunks)
    assert sorted(map(tuple, built[0].collect())) == sorted(tuple(r) for r in every[0].join(terms.select("term").distinct(), "term", "left_semi").select(*built[0].columns).collect())
