"""Run queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

DATA = "/root/testdata"


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(pathlib.Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "as_tuple"):
        return float(value) if value % 1 else int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(plain(r[i])) for i in order) for r in rows))


def check(spark, con, name, query, folder):
    """Difference between both results, or None."""
    df = query.run(spark, folder)
    mine = rows_of(df.columns, df.collect())
    if query.sql is None:
        return None if mine else "no rows"
    cursor = con.execute(query.sql)
    columns = [c[0] for c in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if not mine:
        return "no rows"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return (f"rows {len(mine)} and {len(theirs)}; only Spark {sorted(a - b)[:3]}; "
                f"only SQL {sorted(b - a)[:3]}")
    return None


def main(folder: str, names: list[str]) -> int:
    from testpulse.catalog import REGISTRY
    from testpulse.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    bad = 0
    for name, query in REGISTRY.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = check(spark, con, name, query, folder)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'BAD' if problem else 'ok'} {name} {time.time() - start:.1f}s {problem or ''}",
              flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
