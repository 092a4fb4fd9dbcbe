"""All registered queries of the transit engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from viaduct.plans import context, corridor, joins, live, models, payloads, quality, rail, reliability, risk, schedule, segments, serving

MODULES = (context, corridor, rail, reliability, segments, quality, schedule, joins, serving, models, risk, live, payloads)


def _in_utc(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Instants are epoch numbers; the few steps through timestamps are resolved in UTC when a query is
    built.  The session's own zone is back when it returns."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        zone = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        try:
            return query(spark, sf_dir)
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)

    return run


def _united(parts: list[dict]) -> dict:
    out: dict = {}
    for part in parts:
        if twice := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= part
    return out


QUERIES = {name: _in_utc(query) for name, query in _united([m.QUERIES for m in MODULES]).items()}
ORACLE_SQL = _united([m.ORACLE_SQL for m in MODULES])
