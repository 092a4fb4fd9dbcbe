"""Tables of files by service day: merged day by day, retired day by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.sources.landing import shared_folder

# Tables that are never retired.
FOREVER = ("predictions", "prediction_outcomes", "segment_stats", "trip_summaries")


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path of a folder, wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def days(spark: SparkSession, path: str) -> list[str]:
    """The service days of which a table holds files."""
    fs, where = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n.removeprefix("service_date=") for n in names if n.startswith("service_date="))


def merge_days(path: str, new: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Merges ``new`` (with a column service_date) into the table, reading and writing only the days that it
    touches; returns those.

    ``merge`` takes old and new rows together.  What it gives is cut from its lineage, as a day cannot be
    written while it is read.  A merge that may be repeated makes the whole safe to run again.
    """
    spark = new.sparkSession
    touched = sorted(r[0] for r in new.select("service_date").distinct().collect())  # a row for each day
    there = sorted(set(touched) & set(days(spark, path)))
    rows = new
    if there:
        old = spark.read.schema(new.schema).parquet(path).where(F.col("service_date").isin(there))
        rows = old.select(*new.columns).unionByName(new)
    shared_folder(spark)
    done = merge(rows).checkpoint()
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("service_date").parquet(path)
    return touched


def retire(spark: SparkSession, name: str, path: str, before: str) -> list[str]:
    """Deletes the days of a table before a service day, folder by folder, and returns them; tables that are
    kept for ever lose none."""
    if name in FOREVER:
        return []
    gone = [d for d in days(spark, path) if d < before]
    fs, _ = _folder(spark, path)
    for d in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/service_date={d}"), True)
    return gone
