"""Run registered queries next to their SQL and report differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value + 0.0, 6)
    if isinstance(value, bool):
        return value
    if hasattr(value, "isoformat"):
        return str(value)[:26]
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr), [columns[i] for i in order]


def compare(spark_df, con, sql: str) -> str:
    return compare_rows([tuple(r) for r in spark_df.collect()], spark_df.columns, con, sql)


def compare_rows(spark_rows, spark_columns, con, sql: str) -> str:
    rows, cols = canonical(spark_rows, spark_columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want, want_cols = canonical(result.fetchall(), names)
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(rows) != len(want):
        extra = [r for r in rows if r not in set(want)][:3]
        missing = [r for r in want if r not in set(rows)][:3]
        return f"rows {len(rows)} != {len(want)}; extra {extra}; missing {missing}"
    diff = [(a, b) for a, b in zip(rows, want) if a != b]
    kinds = [
        (c, type(a), type(b))
        for row, other in list(zip(rows, want))[:50]
        for c, a, b in zip(cols, row, other)
        if a is not None and b is not None and type(a) is not type(b)
    ]
    if kinds and not diff:
        return f"types {kinds[:3]}"
    return f"{len(diff)} rows differ, first {diff[:2]}" if diff else ""


def main(argv: list[str]) -> int:
    from catalog import all_queries, all_sql
    from twinlens.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    args = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            args.append(a)
    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sql, bad = all_sql(), 0
    for name, query in all_queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name in sql:
                problem = compare_rows(rows, df.columns, con, sql[name])
                verdict = "ok" if not problem else f"MISMATCH {problem}"
            else:
                verdict, problem = f"rows only: {len(rows)} {df.columns}", ""
        except Exception as error:  # keep going: one report for all queries
            took = time.time() - start
            problem = verdict = f"ERROR {type(error).__name__}: {str(error)[:250]}"
        bad += bool(problem)
        print(f"{name:36s} spark {took:6.2f}s  all {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
