"""Run registered queries next to their SQL and compare the rows.

    python tests/oracle.py [scale factor] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a description of the difference."""
    df = fn(spark, sf_dir)
    got_names, got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    loose = [r[:2] for r in con.execute("DESCRIBE " + sql).fetchall() if r[1].startswith(("HUGEINT", "DECIMAL"))]
    if loose:
        return f"oracle types {loose}"
    cur = con.execute(sql)
    want_names, want = _sorted([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, oracle {len(want)}; {set(got) ^ set(want) and list(set(got) ^ set(want))[:6]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:3]}" if bad else None


def main():
    from __spark_entry__ import oracle_sql, queries
    from flowmill.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = duck(sf_dir), oracle_sql(), []
    wanted = sys.argv[2:]
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, sf_dir, name, fn, sql[name])
            else:
                n = len(fn(spark, sf_dir).collect())
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {'' if name in sql else '(rows only) '}"
              f"{time.time() - start:.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
