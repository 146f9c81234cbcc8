"""Runs a registered query and its SQL and compares them column by column, order of rows aside."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from idscreen.plans.catalogue import QUERIES
from idscreen.plans.expected import SQL
from idscreen.sources.tables import SCHEMAS


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(r[i] for i in order) for r in rows]
    return sorted(picked, key=repr)


def _type(value: object) -> str:
    return "none" if value is None else type(value).__name__


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> list[str]:
    """What differs, as short texts; empty when all is the same."""
    frame = QUERIES[name](spark, sf_dir)
    mine = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    theirs = _rows(columns, cursor.fetchall())
    wrong = []
    if sorted(frame.columns) != sorted(columns):
        wrong.append(f"columns {sorted(frame.columns)} against {sorted(columns)}")
    if len(mine) != len(theirs):
        wrong.append(f"{len(mine)} rows against {len(theirs)}")
    differing = [(a, b) for a, b in zip(mine, theirs) if a != b]
    wrong += [f"{a!r:.300} against {b!r:.300}" for a, b in differing[:3]]
    if not wrong and mine:
        kinds = {(_type(a), _type(b)) for r, s in zip(mine, theirs) for a, b in zip(r, s)}
        wrong += [f"type {a} against {b}" for a, b in kinds if a != b]
    return wrong


def main(sf_dir: str, names: list[str]) -> None:
    from tests.conftest import session

    spark, con = session(), connect(sf_dir)
    for name in names or SQL:
        start = time.time()
        try:
            wrong = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            wrong = [str(error)[:800]]
        print(f"{'same' if not wrong else 'DIFF'} {name} {time.time() - start:.2f}s", *wrong, sep="\n    ", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
