"""Compare registered queries with their SQL on DuckDB. Usable as a script:

    python tests/oracle.py <folder> [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(table) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(table.column_names)
    types = [str(table.schema.field(n).type).replace("large_", "") for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    return names, types, sorted(zip(*columns), key=repr) if columns else []


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when names, types and the multiset of rows agree."""
    left = _rows(df.toArrow())
    right = _rows(con.execute(sql).to_arrow_table())
    if left[0] != right[0]:
        return f"columns {left[0]} <> {right[0]}"
    if left[1] != right[1]:
        pairs = [p for p in zip(left[0], left[1], right[1]) if p[1] != p[2]]
        return f"types {pairs}"
    if left[2] != right[2]:
        only = [(a, b) for a, b in zip(left[2], right[2]) if a != b][:3]
        return f"{len(left[2])} rows <> {len(right[2])}; first differences {only}"
    return None


def main() -> None:
    from marginloom import registry
    from marginloom.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(**{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    con = connect(folder)
    failed = 0
    for name in names or sorted(registry.QUERIES):
        start = time.time()
        try:
            df = registry.QUERIES[name](spark, folder)
            sql = registry.ORACLE.get(name)
            if sql is None:
                result, rows = "rows only", df.collect()
                result += f" ({len(rows)}) {rows[:6] if len(rows) < 60 else ''}"
            else:
                result = difference(df, con, sql)
                failed += result is not None
                result = result or f"ok ({df.count()})"
        except Exception as error:  # report and go on with the next query
            failed += 1
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:28} {time.time() - start:6.1f}s {result}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
