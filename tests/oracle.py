"""Compares registered queries with their SQL: columns, types and values.

    python tests/oracle.py /root/testdata/sf0.01 [name …]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "decimal(10,2)": "DECIMAL(10,2)",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    return con


def rows_of(rows: list[tuple]) -> list[tuple]:
    def key(row: tuple) -> tuple:
        return tuple((value is None, value if value is not None else 0) for value in row)

    return sorted((tuple(row) for row in rows), key=key)


def differences(spark, con: duckdb.DuckDBPyConnection, name: str, folder: str) -> tuple[list[str], int]:
    """What differs, in words, and the number of rows."""
    from folioscan.plans import ALL

    query = ALL[name]
    got = query.run(spark, folder)
    want = con.sql(query.sql)
    columns = sorted(got.columns)
    said = []
    if columns != sorted(want.columns):
        return [f"columns {got.columns} / {want.columns}"], 0
    types = {c: TYPES[t] for c, t in got.dtypes}
    wanted = dict(zip(want.columns, (str(t) for t in want.types)))
    said += [f"{c}: {types[c]} / {wanted[c]}" for c in columns if types[c] != wanted[c]]
    left = rows_of(got.select(*columns).collect())
    right = rows_of(want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())
    if len(left) != len(right):
        said.append(f"{len(left)} / {len(right)} rows")
    said += [f"{a} / {b}" for a, b in zip(left, right) if a != b][:3]
    return said, len(left)


def main() -> None:
    from folioscan.plans import ALL
    from folioscan.session import local_session

    folder = sys.argv[1]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in sys.argv[2:] or ALL:
        began = time.time()
        said, rows = differences(spark, con, name, folder)
        failed += bool(said)
        print(f"{'DIFFERS' if said else 'equal':8}{name:22}{rows:8} rows {time.time() - began:6.1f} s")
        for line in said:
            print("    ", line[:1500])
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
