"""Every registered query against its checking SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Plain queries that SQL does not check yet; whatever is not listed here must have SQL. Their operators have unit tests
# or are parts of checked queries.
UNCHECKED = {
    "b24_failure_prevalence", "c11_error_messages", "g4_stop_mechanisms", "g14_silent_failure_modes", "g14_failure_examples", "g32_behavioral_records",
    "h1_patterns", "h11_novel_patterns", "h18_correlations", "i1_fingerprints", "i2_normalized_fingerprints", "i26_i28_match_context",
    "i33_semantic_risk", "j3_json_content_types", "m5_m6_m8_differential", "n16_discovery_sample",
    "n18_coverage_report", "o4_emergent_heuristics", "o6_failure_catalog", "o7_catalog_examples", "o10_prediction_match",
}
PLAIN = {q.name for q in entry.catalog()}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert name in UNCHECKED or name not in PLAIN, "a plain query needs checking SQL"
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "repo_id" and df.count() > 0


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)


def test_unchecked_queries_exist():
    assert UNCHECKED <= PLAIN - set(SQL)
