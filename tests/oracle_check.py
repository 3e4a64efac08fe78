"""Run registered queries on Spark and DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    return repr(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), sorted(columns)


def compare(df, con, sql):
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != wcols:
        return False, f"columns {cols} vs {wcols}", len(got)
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return False, f"rows {len(got)} vs {len(want)}; spark only {extra}; sql only {missing}", len(got)
    return True, "", len(got)


def main(sf_dir, names):
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from callbrook.session import build_session
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "12g", "spark.log.level": "ERROR"})
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            if name in oracle:
                ok, why, n = compare(queries[name](spark, sf_dir), con, oracle[name])
            else:
                n, ok, why = queries[name](spark, sf_dir).count(), True, "rows only"
        except Exception as e:  # noqa: BLE001
            ok, why, n = False, f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {n:8d} {time.time() - t:6.1f}s {why[:1500]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
