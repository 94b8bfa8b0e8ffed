"""Compare a registered Spark query with its DuckDB answer on one folder of tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        return value
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    return sorted(columns), rows_of(columns, cursor.fetchall())


def differences(df, con, sql) -> list[str]:
    names, got = spark_rows(df)
    wanted_names, wanted = duck_rows(con, sql)
    if names != wanted_names:
        return [f"columns {names} != {wanted_names}"]
    if len(got) != len(wanted):
        only_got = [r for r in got if r not in set(wanted)][:3]
        only_wanted = [r for r in wanted if r not in set(got)][:3]
        return [f"rows {len(got)} != {len(wanted)}; columns {names}; got {only_got}; wanted {only_wanted}"]
    return [f"{names}: {g} != {w}" for g, w in zip(got, wanted) if g != w][:4]
