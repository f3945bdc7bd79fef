from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from docloom import review_queries
from docloom.operators import ask, claims, evidence, flow, rules
from docloom.operators.rules import Hinted
from docloom.plans.registry import REVIEW_REGISTER, RULES
from docloom.sources import files, resources
from docloom.streaming import state


def shown(text, bounds, focus, most):
    """The window by hand, one step at a time."""
    if bounds[1] - bounds[0] <= most:
        return bounds
    a = max(bounds[0], focus[0] - max(0, most - focus[1] + focus[0]) // 2)
    b = min(bounds[1], a + most)
    a = max(bounds[0], b - most)
    while bounds[0] < a < focus[0] and not text[a - 1].isspace():
        a += 1
    while focus[1] < b < bounds[1] and not text[b].isspace():
        b -= 1
    return min(a, focus[0]), max(b, focus[1])


def test_windows_and_sentences(spark):
    draw, rows = random.Random(1), []
    for _ in range(200):
        text = " ".join("x" * draw.randint(1, 9) for _ in range(draw.randint(3, 30)))
        a = draw.randint(0, len(text) - 1)
        b = draw.randint(a, len(text))
        rows.append((text, a, b, *shown(text, (0, len(text)), (a, b), 30)))
    df = spark.createDataFrame(rows, "text string, a int, b int, start int, end int")
    got = ask.window_around(F.col("text"), ask.span(F.lit(0), F.length("text")), ask.span(F.col("a"), F.col("b")), 30)
    assert df.withColumn("w", got).where("w.start <> start OR w.end <> end").count() == 0
    said = 'Mr. Rao pays Rs. 18,000 to A. B. Sen. He leaves. "Done." End'
    asked = [(said, i) for i in (0, 30, 40, 50, len(said) - 1)] + [("", 0), (None, 0)]
    spans = spark.createDataFrame(asked, "t string, i int").select(ask.cut(F.col("t"), ask.sentence_at(F.col("t"), F.col("i"))).alias("s"))
    assert [r.s for r in spans.collect()] == ["Mr. Rao pays Rs. 18,000 to A. B. Sen.", "Mr. Rao pays Rs. 18,000 to A. B. Sen.", "He leaves.", '"Done."', "End", "", None]


def test_verbatim_is_cut_around_the_match(spark):
    text = "word " * 200 + "needle " + "more " * 200 + "end."
    df = spark.createDataFrame([(text, "needle"), ("Short one. A needle here. More.", "needle"), ("none", "needle"), (None, "x")], "t string, n string")
    long, short, none, null = df.select(ask.verbatim(F.col("t"), ask.span_of(F.col("t"), F.col("n"))).alias("v"), ask.verbatim(F.col("t"), ask.span_of(F.col("t"), F.col("n")), exact=True).alias("e")).collect()
    assert long.v.text.startswith("…") and long.v.text.endswith("…") and len(long.v.text) <= 400 and len(long.v.quote) <= 300
    assert "needle" in long.v.quote and long.v.quote in text and long.e.quote == "needle"
    assert short.v == ("A needle here.", "A needle here.") and none.v is None and null.v is None


def test_ask_has_an_outcome_for_every_question(spark):
    chunks = spark.createDataFrame([(1, 1, "The deposit is two months rent. It is returned."), (1, 2, "Notice is one month."), (2, 1, "Nothing of this."), (2, 2, None)], "doc_id long, paragraph_index int, text string")
    asked = spark.createDataFrame([(1, 1, "deposit  back"), (2, 1, "dinosaurs?"), (3, 2, "notice"), (4, 1, "x" * 501), (5, 1, "notice"), (6, 1, None), (7, 1, "deposit"), (8, 1, "notice")], "query_id long, doc_id long, question string")
    read = ask.passages(chunks, asked)
    said = ask.restated(read).withColumn("confidence", F.when(F.col("response_id") == 7, 0.5).otherwise(0.75)).withColumn("quote", F.when(F.col("response_id") == 8, "not in the text").otherwise(F.col("quote")))
    got = {r.query_id: r for r in ask.answers(asked, read, said, spark.createDataFrame([(5,)], "response_id long")).collect()}
    assert {k: (r.status, r.reason) for k, r in got.items()} == {
        1: ("answered", None), 2: ("not-in-document", "no-evidence"), 3: ("not-in-document", "no-evidence"), 4: ("question-too-long", None),
        5: ("model-unavailable", None), 6: ("not-in-document", "no-evidence"), 7: ("not-in-document", "low-confidence"), 8: ("not-in-document", "nothing-verified"),
    }
    assert got[1].shown[0].quote == "The deposit is two months rent. It is" and got[1].places == [1] and got[2].suggested_question == "dinosaurs?" and got[3].suggested_question == "notice?"
    assert got[7].withheld == 1 and got[7].shown == [] and got[8].withheld == 1
    assert ask.passages(chunks.limit(0), asked).count() == 0


def test_hints_spare_no_rule(spark):
    """Every rule gives the same with and without its hints, on its sentence in any case and between other words."""
    said = [s for s, _ in review_queries.SENTENCES]
    texts = said + [s.upper() for s in said] + [f"So then {s} And more." for s in said] + ["", None, "LocK-in of two weeks", "A lock in of 5 days", "maintenance charges shall be paid", "Maintenance is what he shall do"]
    texts += ["Étermination of the lease", "K\u212ainetic", "sum:Rs.5 rent/fee", "x_terminate", "pre-terminate now with two months' notice"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("found", rules.candidates(list(enumerate(RULES)), rules.plain(F.col("text"))))
    off = [F.count_if(rules.fires(r, F.col("text")) & ~F.array_contains("found", i)).alias(r.id) for i, r in enumerate(RULES)]
    assert set(df.agg(*off).first().asDict().values()) == {0}
    spared = df.where(F.col("text").isNotNull()).agg(F.avg(F.size("found")).alias("n")).first().n
    assert spared < len(RULES) / 4  # most rules are never tried
    assert {r for _, fired in review_queries.SENTENCES for r in fired.split(",")} == {r.id for r in RULES}


def test_a_thousand_rules(spark):
    """On texts without hints no rule of a large registry is tried, and with hints the same ones fire as by trying all."""
    name = lambda k: "".join(chr(97 + (k // 26**d) % 26) for d in range(3))
    many = [rules.Rule(f"money.r{k}", "t", [Hinted(rf"\bq{name(k)}(?:s|ed)?\b", f"q{name(k)}")]) for k in range(1000)]
    many[7] = rules.Rule("money.r7", "t", [r"\bplain\b"])  # no hint: always tried
    texts = ["the river is wide and slow " * 30, f"x q{name(500)}s y", f"q{name(1)} q{name(2)}ed", f"q{name(3)}xx", "so plain", "", f"Q{name(999).upper()}"]
    rows = [(1, i, t, None, False) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, paragraph_index int, text string, clause struct<kind:string,label:string>, heading boolean")
    found = df.select("paragraph_index", rules.candidates(list(enumerate(many)), rules.plain(F.col("text"))).alias("c")).orderBy("paragraph_index").collect()
    assert found[0].c == [7] and found[5].c == [7] and all(len(r.c) < 90 for r in found)
    few = [many[k] for k in (1, 2, 3, 7, 500, 999)]
    hits = {(r.paragraph_index, r.rule_id) for r in rules.evaluate(df, few, details=False).collect()}
    assert hits == {(1, "money.r500"), (2, "money.r1"), (2, "money.r2"), (4, "money.r7"), (6, "money.r999")}


def test_claims_across_and_resolved(spark):
    told = "Say only what the excerpts state and never tell the reader what to do or guess"
    rows = [(1, 0, "Fine words."), (1, 1, "Well: say only what the excerpts"), (1, 2, "state and never tell it"), (2, 0, told), (2, 1, "A sum is due."), (3, 0, None), (3, 1, "")]
    got = {tuple(r) for r in claims.echoes_across(spark.createDataFrame(rows, "response_id long, claim_index int, text string"), [told]).collect()}
    assert {(1, 1), (1, 2)} <= got and (2, 1) not in got - {(2, 0), (2, 1)} and not any(r == 3 for r, _ in got)
    assert claims.echoes_across(spark.createDataFrame(rows, "response_id long, claim_index int, text string"), []).count() == 0
    said = spark.createDataFrame([("Ask about it",), ("The rent is due.",), ("Is it due?",), ("",), (None,), ("The clause does not mention a fee",)], "t string")
    assert [r[0] for r in said.select(claims.in_review_register(F.col("t"))).collect()] == [True, False, True, True, None, True]
    assert len(REVIEW_REGISTER) == 7


def test_registry_files_and_hosts(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"resources": [{"id": i, "title": i, "url": "https://x.gov.in"} for i in ("a", "b", "b", "c")]}, indent=1))
    (tmp_path / "g.json").write_text(json.dumps({"concerns": {"home": ["a", "a", "z"]}, "guidance": {"call": "b"}}, indent=1))
    listed, routes = resources.read(spark, str(tmp_path / "r.json"), str(tmp_path / "g.json"))
    assert {tuple(r) for r in resources.problems(listed, routes).collect()} == {("repeated-resource", None, "b"), ("unknown-resource", "home", "z"), ("repeated-route", "home", "a"), ("unreachable-resource", None, "c")}
    names = ["a/b\\c  d.txt", "​\t", None, "n" * 200 + ".docx", "ok.pdf"]
    kept = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(files.safe_name(F.col("n"))).collect()]
    assert kept == ["c d.txt", "document", "document", "n" * 115 + ".docx", "ok.pdf"]


def test_decisions_days_and_sessions(spark):
    held = spark.createDataFrame([("j1", "before-signing", "urgent-review"), ("j2", None, "awaiting-stage"), ("j3", "problem-started", "safety-escalation"), ("j4", "compare-versions", "review")], "journey_id string, stage string, status string")
    got = {r.journey_id: r for r in flow.decisions(held).collect()}
    assert [got[j].analysis for j in ("j1", "j2", "j3", "j4")] == ["run", "wait", "skip", "run"] and got["j1"].answer_style == "brief" and got["j1"].official_contact
    assert got["j3"].look_for == [] and got["j4"].outputs == ["change-cards", "document-map"] and got["j1"].look_for == flow.look_for("before-signing")
    line = spark.createDataFrame([(1, 1, "2026-05-05", "5 May 2026", 3), (1, 2, "2026-05-05", "5/5/2026", 4), (1, 3, "2026-06-01", "1 June 2026", 1)], "doc_id long, n int, d string, written string, paragraph_index int").withColumn("date", F.to_date("d"))
    assert [(r.day, len(r.entries)) for r in evidence.timeline_days(line).orderBy("date").collect()] == [("5 May 2026", 2), ("1 June 2026", 1)]
    doubts = spark.createDataFrame([(["day-month-order", "two-digit-year"], "2026-02-03"), ([], None)], "k array<string>, a string").select(evidence.doubt(F.col("k"), F.to_date("a")).alias("d")).collect()
    assert "3 February 2026" in doubts[0].d and "two digits" in doubts[0].d and doubts[1].d is None
    sessions = spark.createDataFrame([("s", "before-signing", "nda", 1000), ("t", None, None, 2000)], "session_id string, stage string, document_type string, expires_at_ms long")
    assert [r.session_id for r in state.expired(sessions, 1000).collect()] == ["s"]
    docs = spark.createDataFrame([("s", "primary", "a.txt", 1, 5, 2)], "session_id string, slot string, name string, page_count int, word_count int, paragraph_count int")
    view = {r.session_id: r for r in state.session_view(sessions, docs, spark.createDataFrame([("s", "compare")], "session_id string, kind string")).collect()}
    assert view["s"].outputs.compare and not view["t"].outputs.compare and view["s"].expires_at == "1970-01-01T00:00:01.000Z"
