"""Order graphs travel as keys: the same graphs as the SQL rules, without names or deciding numbers in the shuffles."""

from __future__ import annotations

import re

import duckdb

from spoor.sources import trade

LINES = [  # orderkey, linenumber, partkey, suppkey, quantity, discount, tax, returnflag, linestatus
    (1, 1, 7, 3, 45.0, 0.09, 0.07, "R", "O"), (1, 2, 7, 3, 36.0, 0.0, 0.0, "R", "F"), (1, 3, 18, 4, 11.0, 0.1, 0.08, "N", "F"), (1, 4, None, 5, 46.0, 0.0, 0.0, "N", "O"),
    (2, 1, 18, 4, 47.0, 0.0, 0.0, "A", "O"), (2, 2, 18, None, 38.0, 0.0, 0.001, "R", None), (2, 3, 29, 4, 41.0, 0.0, 0.0, "R", "O"), (3, 1, 7, 3, 10.0, 0.09, 0.08, "N", "O"),
]
ORDERS = [(1, 10, "O"), (2, 10, None), (3, 11, "P"), (4, 12, "F")]


def _written(spark, folder):
    spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_same_graphs_as_sql(spark, tmp_path):
    at = _written(spark, tmp_path)
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    keys = trade.edge_keys(spark, at)
    for got, name in ((trade.trade_edges(keys), "tedges"), (trade.trade_nodes(trade.node_keys(keys)), "tnodes")):
        cols = "repo_id, framework, source, target, edge_type" if name == "tedges" else "repo_id, framework, node_id, node_type, name"
        # `concat` of DuckDB reads null as '', so ends without a value are compared apart
        whole = [r for r in con.execute(f"WITH {trade.sql_trade().rstrip(', ')} SELECT {cols} FROM {name}").fetchall() if not any(str(x).endswith("_") or x in ("agent_s", "cap_p") for x in r)]
        rows = [tuple(r) for r in got.select(*cols.split(", ")).collect()]
        assert sorted(r for r in rows if None not in r) == sorted(whole) and len(rows) == len(set(rows))


def test_numbers_and_names_stay_out_of_shuffles(spark, tmp_path):
    keys = trade.edge_keys(spark, _written(spark, tmp_path))
    plan = spark._jvm.PythonSQLUtils.explainString(keys._jdf.queryExecution(), "formatted")
    shuffled = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert shuffled and not [x for x in shuffled if re.search(r"l_(quantity|tax|discount|returnflag)|repo_id|edge_id", x)]
    assert keys.columns == ["o_custkey", "kind", "source_key", "target_key"]
