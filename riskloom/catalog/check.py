"""Run registered queries beside their SQL on the same parquet tables and compare."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import pyarrow as pa


def sql_connection(folder: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def _plain_type(kind: pa.DataType) -> str:
    if pa.types.is_large_string(kind) or pa.types.is_string(kind):
        return "string"
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return f"list<{_plain_type(kind.value_type)}>"
    return str(kind)


def _sortable(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, f"{value:.13g}")
    return (1, str(value))


def compare(left: pa.Table, right: pa.Table) -> str:
    """Empty when both tables hold the same rows, else what differs."""
    names = sorted(left.column_names)
    if names != sorted(right.column_names):
        return f"columns {names} != {sorted(right.column_names)}"
    if left.num_rows != right.num_rows:
        return f"rows {left.num_rows} != {right.num_rows}"
    kinds = [(n, _plain_type(left.schema.field(n).type), _plain_type(right.schema.field(n).type)) for n in names]
    wrong = [k for k in kinds if k[1] != k[2]]
    if wrong:
        return f"types {wrong}"
    rows = [
        sorted(zip(*[table.column(n).to_pylist() for n in names]), key=lambda row: [_sortable(v) for v in row])
        for table in (left, right)
    ]
    close = ""
    for a, b in zip(*rows):
        if a == b:
            continue
        for n, x, y in zip(names, a, b):
            if x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)):
                continue
            if isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9):
                close = close or f"inexact {n}: {x!r} ~ {y!r}"
                continue
            return f"{n}: {x!r} != {y!r} in {dict(zip(names, a))!r} / {dict(zip(names, b))!r}"[:1500]
    return close


def main(folder: str, wanted: list[str]) -> int:
    from riskloom.catalog import ORACLES, QUERIES
    from riskloom.session import build_session

    spark = build_session(
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = sql_connection(folder)
    bad = 0
    for name in wanted or QUERIES:
        started = time.time()
        try:
            got = QUERIES[name](spark, folder).toArrow()
            spent = time.time() - started
            if name in ORACLES:
                want = connection.execute(ORACLES[name]).to_arrow_table()
                problem = compare(got, want)
            else:
                problem = "" if got.num_rows else "no rows"
        except Exception as error:  # noqa: BLE001 - reported per query
            spent, problem = time.time() - started, f"{type(error).__name__}: {str(error)[:300]}"
            got = None
        kind = "sql " if name in ORACLES else "rows"
        count = got.num_rows if got is not None else "-"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:28s} {count!s:>8} {spent:6.2f}s {problem}", flush=True)
        bad += bool(problem)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
