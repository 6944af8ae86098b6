"""Failure modes cover swallowed errors too, in the query and in its checking SQL."""

from __future__ import annotations

import oracle
from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_swallowed_errors_are_failure_modes(spark):
    rows = queries()["g14_failure_modes"](spark, SF).collect()
    silent = [r for r in rows if r["finding_id"] == "STRAT-SI-001"]
    assert sorted(map(str, silent)) == sorted(map(str, queries()["g14_silent_failure_modes"](spark, SF).select(*silent[0].asDict()).collect()))
    assert any("error_swallowed, silent_error_handling" in r["failure_description"] and r["downstream_impact_observed"] for r in silent)
    cur = oracle.connect(SF).execute(oracle_sql()["g14_failure_modes"])
    at = [d[0] for d in cur.description].index("finding_id")
    assert {r[at] for r in cur.fetchall()} == {r["finding_id"] for r in rows}
