"""Runs a registered query and its SQL on the same tables."""

import decimal
import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(table) -> tuple[list[str], list[tuple]]:
    """Column names in order, and the rows as a sorted bag with plain values."""

    def plain(v):
        if isinstance(v, decimal.Decimal):
            v = float(v)
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        return v if v is None or isinstance(v, int) else str(v)

    names = sorted(table.column_names)
    return names, sorted((tuple(map(plain, r)) for r in zip(*[table.column(c).to_pylist() for c in names], strict=True)), key=str)
