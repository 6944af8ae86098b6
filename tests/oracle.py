"""Compare registered queries with their checking SQL on DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

SPENT = [0.0, 0.0]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def kind(t: str) -> str:
    t = t.upper()
    for k, names in {"int": ("BIGINT", "INT", "HUGEINT", "SMALLINT", "TINYINT"), "double": ("DOUBLE", "FLOAT", "DECIMAL"), "text": ("VARCHAR", "STRING"), "bool": ("BOOL",)}.items():
        if t.startswith(names):
            return k + (":" + t if t.startswith(("HUGEINT", "DECIMAL")) else "")
    return t


def compare(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    t0 = time.time()
    got = df.collect()
    t1 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    want = cur.fetchall()
    SPENT[:] = [t1 - t0, time.time() - t1]
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    mine = {c: kind(t) for c, t in df.dtypes}
    bad = {c: (mine[c], types[c]) for c in cols if mine[c] != types[c]}
    if bad:
        return f"types {bad}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}: only spark {list(set(a) - set(b))[:2]} only sql {list(set(b) - set(a))[:2]}"
    if a != b:
        return f"values ({sum(x != y for x, y in zip(a, b))} of {len(a)}): only spark {sorted(set(a) - set(b))[:2]} only sql {sorted(set(b) - set(a))[:2]}"
    return None


def main(argv):
    from spoor.session import local_session
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.01"
    wanted = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf = "/root/testdata/" + a[5:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf), E.oracle_sql(), 0
    for name, fn in E.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                diff = compare(df, con, sqls[name])
                n = "sql"
            else:
                n, diff = f"{df.count()} rows", None
        except Exception as e:  # report and go on
            diff, n = f"{type(e).__name__}: {str(e)[:700]}", ""
        failed += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {name:44s} {time.time() - t:5.1f}s {n} spark={SPENT[0]:.1f} duck={SPENT[1]:.1f} {diff or ''}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
