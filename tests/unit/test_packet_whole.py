"""A packet cites every place of a field and names what was looked for and not found."""

from __future__ import annotations

from docloom import queries
from docloom.operators.rules import rules_for_stage
from docloom.plans.registry import RULES


def test_packet_cites_all_places_and_names_what_is_missing(spark, tmp_path):
    rows = [(7 * k, 1, 1000.0 + k, 8000 + k) for k in range(10)] + [(4, 2, 1.0, 8000)]  # ten clauses of payments with dates; one on disputes
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, day int")
    orders.selectExpr("o_orderkey", "o_custkey", "o_totalprice", "cast(date_from_unix_date(day) as timestamp_ntz) as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    got = queries.packet_lines(spark, str(tmp_path)).collect()
    said = {(r.doc_id, r.text.split(":")[0]): r.citations for r in got if r.section == "summary"}
    assert len(said[1, "money"].split(",")) == len(said[1, "dates"].split(",")) == 10  # six of each before
    primary = {r.title for r in rules_for_stage(RULES, queries.STAGE) if r.relevance(queries.STAGE) == "primary"}
    for doc, fired in ((1, "money.payment-terms"), (2, None)):
        asked = sorted((r.seq, r.text, r.citations) for r in got if r.doc_id == doc and r.section == "questions")
        absent = [t.removeprefix("Not found: ") for _, t, c in asked if t.startswith("Not found: ") and not c]
        assert set(absent) == primary - {r.title for r in RULES if r.id == fired} and len(absent) == len(set(absent))
        assert [n for n, _, _ in asked] == list(range(1, len(asked) + 1)) and not asked[0][1].startswith("Not found")
