from __future__ import annotations

from docloom.operators import evidence
from docloom.operators.rules import Rule

HITS = "doc_id long, paragraph_index int, text string, rule_id string, rule_order int"


def test_excerpts_are_picked_in_turns(spark):
    rows = [(1, 1, "a" * 10, "r1", 0), (1, 2, "b" * 10, "r1", 0), (1, 3, "c" * 10, "r1", 0), (1, 4, "d" * 10, "r2", 1), (1, 5, "e" * 10, "r3", 2), (1, 1, "a" * 10, "r3", 2), (2, 7, "f" * 50, "r1", 0), (2, 8, "g", "r2", 1)]
    hits = spark.createDataFrame(rows, HITS)
    got = lambda **more: {r.doc_id: list(r.places) for r in evidence.round_robin(hits, **more).collect()}
    # Paragraph 1 is the first place of two rules, so paragraph 5 is r3's second.
    assert sorted(got()[1]) == [1, 2, 3, 4, 5] and sorted(got(most=2)[1]) == [1, 4] and sorted(got(most=4)[1]) == [1, 2, 4, 5]
    assert sorted(got(chars=25)[1]) == [1, 4] and sorted(got(chars=20)[2]) == [7] and sorted(got(chars=20, excerpt=5)[2]) == [7, 8]
    assert evidence.round_robin(spark.createDataFrame([], HITS)).count() == 0


def test_claims_go_to_their_rule(spark):
    rules = [Rule("money.a", "t", ["x"], category="payment"), Rule("money.b", "t", ["x"], category="penalty"), Rule("exit.c", "t", ["x"], category="remedy")]
    said = [(1, 0, "payment", "p1", 0.6), (1, 1, "payment", "p1", 0.9), (1, 2, "penalty", "p2", 0.5), (1, 3, "other", "p1", 0.9), (1, 4, "other", "p3", 0.4), (1, 5, "payment", "p9", 0.9), (2, 0, "remedy", "p3", 0.7), (2, 1, "remedy", "p3", 0.7)]
    claims = spark.createDataFrame(said, "response_id int, claim_index int, category string, chunk_id string, confidence double")
    credits = spark.createDataFrame([(1, "p1", "money.a"), (1, "p1", "money.b"), (1, "p2", "money.b"), (1, "p3", "exit.c"), (2, "p3", "exit.c")], "response_id int, chunk_id string, rule_id string")
    got = {(r.response_id, r.rule_id): r.claim_index for r in evidence.place_claims(claims, credits, rules).collect()}
    # Claim 3's chunk has two rules and none of its category; claim 5's chunk has no rule.
    assert got == {(1, "money.a"): 1, (1, "money.b"): 2, (1, "exit.c"): 4, (2, "exit.c"): 0}
