"""Run registered queries beside their oracle SQL and compare the rows.

    python tests/oracle_check.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from quillwork.plans import load_all  # noqa: E402
from quillwork.plans.inputs import TABLES  # noqa: E402
from quillwork.plans.registry import ORACLES, QUERIES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        (tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    names, rows = table_rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return f"rows {len(rows)}"
    cur = con.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want_names, want = table_rows([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"FAIL columns {names} != {want_names}"
    spark_kinds = dict(df.dtypes)
    odd = [f"{c}:{spark_kinds[c]}/{kinds[c]}" for c in names
           if (spark_kinds[c], kinds[c]) not in {
               ("bigint", "NUMBER"), ("bigint", "BIGINT"), ("string", "STRING"), ("string", "VARCHAR"),
               ("double", "NUMBER"), ("double", "DOUBLE"), ("boolean", "bool"), ("boolean", "BOOLEAN")}]
    if odd:
        return f"FAIL types {odd}"
    if len(rows) != len(want):
        return f"FAIL count {len(rows)} != {len(want)} e.g. {rows[:1]} / {want[:1]}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        got_only = set(map(repr, rows)) - set(map(repr, want))
        want_only = set(map(repr, want)) - set(map(repr, rows))
        return (f"FAIL {len(bad)} of {len(rows)} rows differ\n   spark  {sorted(got_only)[:2]}"
                f"\n   oracle {sorted(want_only)[:2]}")
    return f"ok {len(rows)}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    load_all()
    from quillwork.session import build_session
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed = 0
    for name in sorted(QUERIES):
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            result = compare(spark, con, name, args.sf)
        except Exception as error:  # report and go on with the next query
            result = f"FAIL {type(error).__name__}: {str(error)[:700]}"
        failed += result.startswith("FAIL")
        print(f"{name:36s} {time.time() - start:6.2f}s {result}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
