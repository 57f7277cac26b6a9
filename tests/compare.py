"""Run registered queries in Spark and their checks in DuckDB, compare rows."""
from __future__ import annotations

import math
import time

import duckdb

from veilframe.fixtures import TABLES


SECONDS: dict[str, float] = {}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if hasattr(value, "asDict"):
        return tuple((k, _plain(v)) for k, v in sorted(value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((str(k), _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def kinds(spark_types):
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}
    return {n: names.get(t, t) for n, t in spark_types}


def compare(spark, con, folder, query, sql):
    """None if equal, else a message."""
    began = time.time()
    got = query(spark, folder)
    rows = got.collect()
    SECONDS["spark"] = time.time() - began
    mine = rows_of(got.columns, rows)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    theirs = rows_of(names, cur.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} vs {sorted(names)}"
    own = kinds(got.dtypes)
    odd = {n: (own[n], types[n]) for n in names if own[n] != types[n] and "<" not in own[n]}
    if odd:
        return f"types {odd}"
    if len(mine) != len(theirs):
        extra = [r for r in mine[:100000] if r not in set(theirs)][:3]
        lack = [r for r in theirs[:100000] if r not in set(mine)][:3]
        return f"rows {len(mine)} vs {len(theirs)}; only spark {extra}; only duckdb {lack}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, e.g. {bad[0]}"
    if not mine:
        return "no rows"
    return None
