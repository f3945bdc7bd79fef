from __future__ import annotations

import os

import duckdb
import pytest

from docloom.llm import queries
from docloom.llm.suffix_tree import Tree
from tests.llm.test_suffix_tree import brute, close

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    with duckdb.connect() as con:
        for name in os.listdir(SF):
            con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
        yield con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SF)
    want = tables.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    rows = sorted(map(repr, want.fetchall()))
    assert rows and sorted(columns) == sorted(got.columns) and sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == rows


def test_op11_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, states = brute([tuple(r) for r in docs], Tree())
    assert len(states) > 100
    got = queries.op11_suffix_tree(spark, SF).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    close(got.collect(), want)
