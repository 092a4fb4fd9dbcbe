"""Scoring of predictions against outcomes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from viaduct.functions.semantics import floor_indices, js_round, running_counts
from viaduct.operators.segments import error_metrics


def export_horizon(seconds: Column) -> Column:
    """Labels with inclusive upper edges."""
    return F.when(seconds <= 300, "0-5m").when(seconds <= 900, "5-15m").when(seconds <= 1800, "15-30m").when(seconds <= 3600, "30-60m").otherwise("60m+")


def bench_horizon(ms_ahead: Column) -> Column:
    """Half-open minute labels on the time to the actual arrival; null before zero."""
    m = ms_ahead / 60000
    return F.when(m < 0, None).when(m < 2, "T-1").when(m < 7, "T-5").when(m < 12, "T-10").when(m < 17, "T-15").when(m < 30, "T-20").otherwise("T-30+")


def backtest_horizon(seconds: Column) -> Column:
    """Index of the horizon bucket on the time to the timetable; a null one counts as an hour."""
    s = F.coalesce(F.greatest(seconds, F.lit(0)), F.lit(3600))
    return F.when(s <= 60, 0).when(s <= 300, 1).when(s <= 600, 2).when(s <= 900, 3).when(s <= 1800, 4).otherwise(5)


def benchmark(scored: DataFrame) -> DataFrame:
    """Error metrics for each horizon and contender (timetable, operator, each model version), with
    the coverage of the models' bands."""
    h = bench_horizon(F.col("actual_arr_epoch") - F.col("generated_at"))
    inside = ((F.col("actual_arr_epoch") >= F.col("our_p10")) & (F.col("actual_arr_epoch") <= F.col("our_p90"))).cast("int")
    contender = F.explode(F.array(*[F.struct(m.alias("model"), F.col(e).alias("error"), c.alias("inside")) for m, e, c in ((F.lit("schedule"), "schedule_error_sec", F.lit(None).cast("int")), (F.lit("operator"), "operator_error_sec", F.lit(None).cast("int")), (F.col("model_version"), "our_error_sec", inside))]))
    rows = scored.withColumn("horizon", h).where("horizon IS NOT NULL").select("horizon", contender.alias("x")).select("horizon", "x.*")
    return error_metrics(rows, ["horizon", "model"], "error", F.round(F.avg("inside"), 4).alias("coverage"))


def verdict(table: DataFrame, least: int = 30) -> DataFrame:
    """The contender with the smallest MAE of each horizon among those with enough rows."""
    best = F.min_by(F.struct("model", "mae"), F.struct("mae", "model"))
    return table.where(F.col("n") >= least).groupBy("horizon").agg(best.alias("b")).select("horizon", F.col("b.model").alias("best_model"), F.col("b.mae").alias("best_mae"))


def conformal(scored: DataFrame, q: float = 0.9, least: int = 60) -> DataFrame:
    """Half width of the band for each horizon bucket."""
    rows = scored.withColumn("bucket", backtest_horizon((F.col("sched_arr_epoch") - F.col("generated_at")) / 1000))
    width = floor_indices(rows, ["bucket"], F.abs("our_error_sec"), {"width": q})
    return rows.groupBy("bucket").agg(F.count("*").alias("n")).join(width, "bucket", "left").select("bucket", F.greatest(F.lit(least).cast("long"), "width").alias("offset_sec"), "n")


def target_encoding(rows: DataFrame, key: str, target: str, shrink: int = 20) -> DataFrame:
    """Shrunken mean of the target for each key, to one decimal."""
    total = rows.agg(F.avg(target).alias("mu"))
    g = rows.groupBy(key).agg(F.count(target).alias("n"), F.sum(target).alias("s")).crossJoin(F.broadcast(total))  # one row
    return g.select(key, "n", (js_round((F.col("s") + shrink * F.col("mu")) / (F.col("n") + shrink) * 10) / 10).alias("encoded"))


def auc(rows: DataFrame, score: str, label: str, buckets: int = 256) -> DataFrame:
    """Area under the ROC curve; tied scores count half.

    Equal scores are summed first, and running sums go over sums of score ranges, so no task holds
    all rows.
    """
    tied = rows.groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    edges = tied.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    placed = tied.crossJoin(F.broadcast(edges)).withColumn("b", F.least(F.lit(buckets - 1), F.floor(F.when(F.col("hi") > F.col("lo"), (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets).otherwise(0))))
    inner = placed.withColumn("below", F.coalesce(F.sum("q").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = inner.groupBy("b").agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    run = per.withColumn("below", F.coalesce(F.sum("q").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most `buckets` rows
    total = run.agg(F.sum(F.col("u") + F.col("p") * F.col("below")).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return total.select(F.round(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))), 6).alias("auc"), F.col("p").alias("positives"), F.col("q").alias("negatives"))


def _cut(rows: DataFrame, at: str, share: float) -> DataFrame:
    """One row: the instant at which the share is reached, and how many of its rows belong to it."""
    counts = running_counts(rows, [], F.col(at))
    edge = F.floor(F.col("total") * F.lit(share))
    return counts.where((F.col("below") < edge) & (edge <= F.col("below") + F.col("n"))).agg(F.max("v").alias("_edge"), F.max(edge - F.col("below")).alias("_take"))


def _edge(rows: DataFrame, at: str, share: float, ranges: int = 1 << 14) -> tuple[int | None, int | None]:
    """What :func:`_cut` tells of whole numbers: rows are counted in ranges, and those of the range in which the
    share is reached in ranges of it, until it is one number.  No row is sorted or shuffled."""
    whole = rows.agg(F.count(at).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    left, lo, hi = math.floor(whole.n * share), whole.lo, whole.hi
    if left <= 0:
        return None, None
    while lo < hi:
        width = -(-(hi - lo + 1) // ranges)
        place = F.expr(f"(`{at}` - ({lo}L)) div {width}L").alias("place")
        counts = rows.where(F.col(at).between(lo, hi)).groupBy(place).count().collect()  # at most ``ranges`` rows
        for place, n in sorted(map(tuple, counts)):
            if left <= n:
                break
            left -= n
        lo, hi = lo + place * width, min(hi, lo + (place + 1) * width - 1)
    return lo, left


def halves(rows: DataFrame, order: list[str], share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The rows that :func:`time_split` marks and the others.  The split is found at once, so that reading a half
    costs no more than its rows."""
    at, rest = order[0], order[1:]
    found = _edge(rows, at, share) if rows.schema[at].dataType in (IntegerType(), LongType()) else _cut(rows, at, share).first()
    edge, take = map(F.lit, found)
    k = F.row_number().over(Window.partitionBy(at).orderBy(*rest)) if rest else F.lit(1)
    on = rows.where(F.col(at) == edge).withColumn("_k", k)
    early, inside = F.coalesce(F.col(at) < edge, F.lit(False)), F.col("_k") <= take
    late = ~early & F.coalesce(F.col(at) != edge, F.lit(True))
    return rows.where(early).unionByName(on.where(inside).drop("_k")), rows.where(late).unionByName(on.where(~inside).drop("_k"))


def time_split(rows: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """Marks the earliest ``share`` of the rows, counted in the total order of ``order``, as training rows.

    Rows of the instant at which the share is reached are told apart by the other columns of the order;
    that instant alone is sorted in one task.
    """
    at, rest = order[0], order[1:]
    marked = rows.crossJoin(F.broadcast(_cut(rows, at, share)))  # one row
    k = F.row_number().over(Window.partitionBy(at).orderBy(*rest)) if rest else F.lit(1)
    on = marked.where(F.col(at) == F.col("_edge")).withColumn("is_train", k <= F.col("_take"))
    off = marked.where(F.coalesce(F.col(at) != F.col("_edge"), F.lit(True))).withColumn("is_train", F.coalesce(F.col(at) < F.col("_edge"), F.lit(False)))
    return off.unionByName(on).drop("_edge", "_take")


def prior_check(t: DataFrame, prior: DataFrame) -> DataFrame:
    """Error of the prior median and share of traversals below its 90th percentile."""
    rows = t.join(prior.where("bucket = 'all'").select("segment_id", "n", "p50_runtime", "p90_runtime"), "segment_id")
    size = F.when(F.col("n") <= 5, "n<=5").when(F.col("n") <= 20, "n6-20").otherwise("n>20")
    return rows.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("runtime_sec") - F.col("p50_runtime"))), 4).alias("mae"), F.round(F.avg((F.col("runtime_sec") <= F.col("p90_runtime")).cast("int")), 4).alias("below_p90"))
