"""Runs registered queries against their SQL: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def compare(df, con, sql: str) -> str | None:
    """None when rows and column types agree, else what differs."""
    want = con.sql(sql)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
             "double": "DOUBLE"}
    got_types = {f.name: kinds.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    want_types = dict(zip(want.columns, map(str, want.types)))
    columns = sorted(got_types)
    if columns != sorted(want_types):
        return f"columns {columns} != {sorted(want_types)}"
    types = {c: (got_types[c], want_types[c]) for c in columns if got_types[c] != want_types[c]}
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    expected = sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=key)
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    bad = [(g, w) for g, w in zip(got, expected) if g != w]
    if bad:
        return f"{len(bad)} rows differ, e.g. {columns}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return f"types {types}" if types else None


def main(sf: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from logevidence.session import build_session

    spark = build_session(
        "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failures = connect(sf), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(query(spark, sf), con, sqls[name]) if name in sqls else (
                None if query(spark, sf).count() >= 0 else "no rows")
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    return failures


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(sf_dir, sys.argv[2:]) > 0)
