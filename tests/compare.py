"""Run registered queries next to their DuckDB twins: python tests/compare.py [sf_dir] [name prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v) -> str:
    if v is None:
        return "-"
    if isinstance(v, float):
        return "-" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def type_family(name: str) -> str:
    name = name.lower()
    for family, words in {"int": ("bigint", "int", "long", "hugeint"), "float": ("double", "float"), "text": ("string", "varchar"), "bool": ("boolean",)}.items():
        if any(name.startswith(w) for w in words):
            return family
    return name


def check(spark, con, sf_dir: str, name: str, build, sql: str | None) -> str:
    """Empty text when equal, else what differs."""
    df = build(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return "" if got else "no rows"
    rel = con.execute(sql)
    columns, types = [d[0] for d in rel.description], [str(d[1]) for d in rel.description]
    want = rel.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    spark_types = dict(df.dtypes)
    for c, t in zip(columns, types):
        if type_family(spark_types[c]) != type_family(t):
            return f"type of {c}: {spark_types[c]} != {t}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        left, right = set(a) - set(b), set(b) - set(a)
        return f"rows {len(a)} vs {len(b)}; columns {sorted(columns)}; only spark {sorted(left)[:2]}; only oracle {sorted(right)[:2]}"
    return "" if a else "no rows"


def main() -> None:
    from fleetlake.session import local_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark, con = local_session("8"), duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if len(args) > 1 and not any(name.startswith(p) for p in args[1:]):
            continue
        start = time.time()
        try:
            problem = check(spark, con, sf_dir, name, build, oracle.get(name))
        except Exception as e:  # report every query, then fail
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {time.time() - start:5.1f}s {'' if name in oracle else '(rows only) '}{problem}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
