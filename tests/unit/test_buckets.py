"""Token buckets of the event table against their SQL."""

from __future__ import annotations

import datetime as dt

import duckdb

from docloom import queries


def test_milliseconds_are_those_of_the_sql(spark, tmp_path):
    t, path = dt.datetime(2024, 1, 1), str(tmp_path / "events.parquet")
    # Half a millisecond behind the second before: the nearest millisecond decides how many seconds are left.
    events = [(1, t, 7), (2, t + dt.timedelta(seconds=29, microseconds=999_500), 7), (3, t + dt.timedelta(seconds=29, microseconds=999_499), 8), (4, t, 8), (5, dt.datetime(1964, 1, 1), 9), (6, dt.datetime(1964, 1, 1, 0, 0, 29, 999_500), 9)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long").write.parquet(path)
    got = {r.event_id: r.retry_after for r in queries.token_bucket(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 30, 3: 31, 4: 0, 5: 0, 6: 31}
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
        assert {e: w for e, _, w in c.execute(queries.TOKEN_BUCKET_SQL).fetchall()} == got
