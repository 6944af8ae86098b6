"""The slowest node of a repository whose model calls took no time."""

from __future__ import annotations

import datetime

import duckdb
import oracle
from __spark_entry__ import oracle_sql, queries


def test_calls_of_no_length_name_a_node(spark, tmp_path):
    """Users 1 and 2 have only calls of 0 ms (user 1 one, user 2 of two nodes, the later one first by name), user 3 also a longer one, user 4 none."""
    rows = [(1, 1, 0.0, 10), (2, 2, 0.0, 11), (3, 2, 0.0, 9), (4, 3, 0.0, 9), (5, 3, 0.01, 12), (6, 4, 5.0, 0)]
    at = datetime.datetime(2024, 1, 2)
    events = [(i, at + datetime.timedelta(seconds=i), user, "view", value, f'{{"k": {k}}}') for i, user, value, k in rows]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = queries()["k13_latency_profile"](spark, str(tmp_path))
    assert oracle.compare(df, con, oracle_sql()["k13_latency_profile"]) is None
    assert {r["repo_id"]: r["bottleneck_node"] for r in df.collect()} == {"repo_1": "agent_research_lead", "repo_2": "agent_writer_crew", "repo_3": "agent_reviewer", "repo_4": ""}
