"""Run registered queries against their SQL: python -m tests.compare [sf] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(table) -> list[str]:
    names = sorted(table.column_names)
    return sorted(map(repr, zip(*[table.column(name).to_pylist() for name in names])))


def types_of(table) -> dict[str, str]:
    return {name: str(table.schema.field(name).type).replace("large_", "") for name in sorted(table.column_names)}


def compare(spark, connection, sf_dir: str, query, sql: str | None) -> str:
    """An empty string when both give the same columns, types and rows; else the difference."""
    ours = query(spark, sf_dir).toArrow()
    if sql is None:
        return "" if ours.num_rows else "no rows"
    theirs = connection.execute(sql).to_arrow_table()
    if types_of(ours) != types_of(theirs):
        return f"types differ: {types_of(ours)} / {types_of(theirs)}"
    a, b = rows_of(ours), rows_of(theirs)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"{len(a)} rows / {len(b)} rows\n  spark: {only_a}\n  sql:   {only_b}"[:1500]


def main(sf: str = "0.01", *names: str) -> None:
    import __spark_entry__ as entry
    from siren.session import build_session

    spark = build_session("8")
    sf_dir = f"/root/testdata/sf{sf}"
    connection = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    print("SQL without a query:", sorted(set(oracles) - set(queries)))
    for name in names or queries:
        start = time.time()
        try:
            difference = compare(spark, connection, sf_dir, queries[name], oracles.get(name))
        except Exception as error:
            difference = f"{type(error).__name__}: {str(error)[:800]}"
        kind = "" if name in oracles else " (rows only)"
        print(f"{'ok  ' if not difference else 'FAIL'} {name}{kind} {time.time() - start:.1f}s {difference}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
