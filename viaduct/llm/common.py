"""Helpers shared by the corpus operators: bounded Arrow batches, lineage cuts, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, about BATCH_ROWS rows or BATCH_BYTES each.

    Spark bounds a batch by its own settings (64 MB by default, or one row); what Python holds of it
    at a time is bounded here, so no setting of the session has to change.
    """
    for batch in batches:
        parts = max(1, -(-batch.num_rows // BATCH_ROWS), -(-batch.nbytes // BATCH_BYTES))
        step = max(1, -(-batch.num_rows // parts))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def fresh(name: str, *taken: DataFrame) -> str:
    """``name``, lengthened until no column of ``taken`` has it (in any case)."""
    names = {c.lower() for df in taken for c in df.columns}
    while name.lower() in names:
        name += "_"
    return name


def every_column(df: DataFrame) -> list[Column]:
    """All columns by name, whatever signs the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder that the cluster shares, and read it from there.

    Without spark.checkpoint.dir a local session takes a temporary folder; a cluster is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp("-ckpt"))
    return df.checkpoint()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_ROWS = 100_000


def beside(small: DataFrame) -> DataFrame:
    """``small``, which must be cut from its lineage, marked for broadcast if it has at most SMALL_ROWS
    rows; beyond that the join shuffles and Spark splits hot keys."""
    return F.broadcast(small) if small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else small


def running_sums(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``df`` and the sums of the named columns over all rows before, in the given order, as ``<name>_before``.

    Rows are sorted by range into partitions of about the same size, whatever their keys, and
    written, so that partition numbers stay; each then starts from the totals of those before it.
    """
    part = fresh("part", df)
    rows = cut_lineage(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    totals = rows.groupBy(part).agg(*[F.sum(c).alias(f"{k}_part") for k, c in sums.items()])  # a row for each partition
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(part, *[F.coalesce(F.sum(f"{k}_part").over(ahead), F.lit(0)).alias(f"{k}_part") for k in sums])
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{k}_before") for k, c in sums.items()])
    found = found.join(F.broadcast(totals), part)
    return found.select(*every_column(df), *[(F.col(f"{k}_before") + F.col(f"{k}_part")).alias(f"{k}_before") for k in sums])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has long columns ``a`` and ``b``.  Returns one row (``node``, ``root``) for each node
    that has an edge to another node; root is the smallest node of its component.  Alternates the
    large-star and small-star steps until the edge set no longer changes.  The minima of a hub are
    aggregated map-side; its edges meet their minimum in a join whose hot keys the adaptive skew join
    splits.  Self loops are ignored, null ends are dropped.  Every round is cut with a reliable
    checkpoint.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut_lineage(pairs)
    digest = _digest(pairs)
    for _ in range(max_rounds):
        if digest[0] == 0:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, digest = digest, _digest(pairs)
        if digest == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _digest(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
