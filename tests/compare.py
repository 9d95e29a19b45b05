"""Run one query and its SQL and compare names, types and values exactly."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
SAME_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "date": "DATE"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    found = []
    ours = {f.name: f.dataType.simpleString() for f in df.schema}
    if sorted(ours) != sorted(names):
        return [f"columns {sorted(ours)} against {sorted(names)}"]
    for name, kind in ours.items():
        want = SAME_TYPE.get(kind, kind.upper())
        if want != types[name].replace(", ", ","):
            found.append(f"type of {name}: {kind} against {types[name]}")
    order = sorted(names)
    theirs = Counter(
        tuple(row[names.index(n)] for n in order) for row in result.fetchall()
    )
    mine = Counter(tuple(row[n] for n in order) for row in df.collect())
    if mine != theirs:
        only_mine, only_theirs = mine - theirs, theirs - mine
        found.append(
            f"rows {sum(mine.values())} against {sum(theirs.values())}; only ours"
            f" {list(only_mine)[:2]}; only SQL {list(only_theirs)[:2]}"
        )
    return found
