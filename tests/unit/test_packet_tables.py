"""Packets read tables that were written once."""

from __future__ import annotations

from docloom import queries


def test_packet_steps_read_what_was_written_once(spark, tmp_path):
    rows = [(k, 1, 1000.0 + k, 8000 + k) for k in range(14)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, day int")
    orders.selectExpr("o_orderkey", "o_custkey", "o_totalprice", "cast(date_from_unix_date(day) as timestamp_ntz) as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    got = queries.packet_lines(spark, str(tmp_path))
    assert got.inputFiles() and all("/kept-" in f for f in got.inputFiles())
    assert {r.section for r in got.collect()} == {"summary", "dates", "questions"}
