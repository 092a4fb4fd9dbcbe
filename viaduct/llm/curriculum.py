"""Mixing sources by weights that change in the course of training: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.llm.common import beside, cut_lineage, running_sums


def n_words(text: Column) -> Column:
    """Number of stretches without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pieces(knots: Column) -> Column:
    """The pieces of a schedule of knots (at, weight), weights being linear in between, each with what
    the source has been given before it.

    ``knots`` are sorted by ``at``, which runs from 0 to 1.
    """
    empty = F.array().cast("array<struct<at:double,upto:double,from:double,to:double,before:double,after:double>>")

    def extend(done: Column, k: Column) -> Column:
        one, two = F.get(knots, k), F.get(knots, k + 1)
        before = F.coalesce(F.get(done, F.size(done) - 1)["after"], F.lit(0.0))
        after = before + (one["weight"] + two["weight"]) / 2 * (two["at"] - one["at"])
        return F.concat(done, F.array(F.struct(one["at"].alias("at"), two["at"].alias("upto"), one["weight"].alias("from"), two["weight"].alias("to"), before.alias("before"), after.alias("after"))))

    return F.aggregate(F.sequence(F.lit(0), F.size(knots) - 2), empty, extend)


def instant(schedule: Column, demand: Column) -> Column:
    """When in training a source has been given ``demand`` units of weight: the inverse of its integral."""
    piece = F.try_element_at(F.filter(schedule, lambda s: s["before"] <= demand), F.lit(-1))
    rest = demand - piece["before"]
    slope = F.coalesce(F.try_divide(piece["to"] - piece["from"], piece["upto"] - piece["at"]), F.lit(0.0))
    root = F.sqrt(F.greatest(F.lit(0.0), piece["from"] * piece["from"] + 2 * rest * slope))
    return F.when(rest > 0, F.least(piece["upto"], piece["at"] + F.try_divide(2 * rest, piece["from"] + root))).otherwise(piece["at"])


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """(source, source_size, schedule, weight) with each source's target.

    ``share`` of all sizes is dealt out by weight; a target stops at ``most`` times its source's size,
    and the excess goes to the others by weight until none is above.  In the order of size for weight,
    the first source that its part of what is left does not fill sets the rate for itself and all after it.
    """
    capped = sources.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("fills", F.coalesce(F.try_divide("cap", "weight"), F.lit(float("inf"))))
    words, weights = capped.agg(F.sum("source_size"), F.sum("weight")).first()
    ordered = running_sums(capped, [F.col("fills"), F.col("source")], cap=F.col("cap"), weight=F.col("weight"))
    ordered = ordered.withColumn("left", F.lit(float(share) * (words or 0)) - F.col("cap_before")).withColumn("among", F.lit(weights or 0.0) - F.col("weight_before"))
    unfilled = (F.col("weight") > 0) & (F.col("weight") * F.col("left") <= F.col("cap") * F.col("among"))
    rate = ordered.where(unfilled).agg(F.min(F.struct("fills", "source", "left", "among"))).first()[0]
    fair = F.col("weight") * F.lit(rate.left) / F.lit(rate.among) if rate else F.col("cap")
    return ordered.select("source", "source_size", "schedule", "weight", F.least(F.col("cap"), fair).alias("target"))


def mix(docs: DataFrame, schedules: DataFrame, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document, sorted by its first position in training.

    (id_col, source, size, source_size, target, taken, passes, position): ``size`` is the document's
    number of words, ``target`` what its source gives to the mix, ``taken`` what the document gives,
    ``passes`` an array of (pass, position, words) of its uses, ``position`` the first of them.

    ``schedules`` has a row (source, knots) for each source: its weight over training time from 0 to 1,
    linear between knots (at, weight).  The integral is the source's weight; documents stand in the
    order of a hash, pass after pass, and one is due when the integral reaches the words before it.
    A source gives its target rounded down: the last document is cut, none is taken whole more than
    ``most`` times.  Sources without a schedule give nothing.

    Null texts have no words and no position; those come last.  Null sources are a source; null ids are
    ordered by their text, rows equal in all of these are interchangeable; repeated rows count as often
    as they come; very long texts are counted whole; an empty table gives no rows; other columns are
    not read.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), text_col, F.lit("")))
    rows = cut_lineage(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("_key")))
    sizes = cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    plans = schedules.select(F.col("source").alias("_for"), pieces(F.col("knots")).alias("schedule"))
    planned = sizes.join(plans, F.col("source").eqNullSafe(F.col("_for")), "left").drop("_for")
    due = targets(planned.withColumn("weight", F.coalesce(F.element_at("schedule", -1)["after"], F.lit(0.0))), share, most)

    line = running_sums(rows, [F.col("source"), F.col("_key"), F.col("_id"), F.col("size")], size=F.col("size"))
    first = running_sums(sizes, [F.col("source")], source_size=F.col("source_size")).select(F.col("source").alias("_of"), F.col("source_size_before").alias("begins"))
    due = cut_lineage(due.join(first, F.col("source").eqNullSafe(F.col("_of"))).drop("_of").withColumnRenamed("source", "_of"))
    met = line.join(beside(due), F.col("source").eqNullSafe(F.col("_of"))).withColumn("at", F.col("size_before") - F.col("begins"))

    whole = F.floor("target").cast("long")

    def use(k: Column) -> Column:
        at = F.col("at") + k * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - at))
        return F.struct(k.cast("int").alias("pass"), instant(F.col("schedule"), F.try_divide(at, F.col("target")) * F.col("weight")).alias("position"), words.alias("words"))

    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(-int(-most // 1) - 1)), use), lambda x: x["words"] > 0)
    out = met.withColumn("passes", passes).withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda n, x: n + x["words"]))
    out = out.withColumn("position", F.get("passes", F.lit(0))["position"])
    return out.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "taken", "passes", "position").orderBy(F.asc_nulls_last("position"), "_key")


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, source, pass, position, words) for every use of a document, sorted by position."""
    return mixed.select(id_col, "source", F.explode("passes").alias("use")).select(id_col, "source", "use.*").orderBy("position", id_col)
