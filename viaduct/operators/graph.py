"""The directed rail graph: transitions, edge probabilities, likely successors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(obs: DataFrame) -> DataFrame:
    """(from_id, to_id) of consecutive different locations of a run and source; null locations are skipped."""
    w = Window.partitionBy("run_id", "source").orderBy("ts", "id")
    moved = obs.where("location_id IS NOT NULL").withColumn("from_id", F.lag("location_id").over(w))
    return moved.where("from_id <> location_id").select("from_id", F.col("location_id").alias("to_id"))


def edges(pairs: DataFrame) -> DataFrame:
    """Counts of each pair and their share of what leaves ``from_id``; self loops are left out."""
    counted = pairs.where("from_id <> to_id").groupBy("from_id", "to_id").agg(F.count("*").alias("n"))
    return counted.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("from_id")), 6))


def successors(graph: DataFrame, k: int) -> DataFrame:
    """The k likeliest successors of each location, with shares that add up to one again."""
    best = Window.partitionBy("from_id").orderBy(F.desc("n"), "to_id")
    top = graph.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("from_id")), 6)).drop("p")


def slug_key(name: Column) -> Column:
    """``n:`` and the name in capitals with dashes, for places that have only a name; null if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.upper(F.trim(name)), "[^A-Z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s != "", F.concat(F.lit("n:"), s))


def canonical(rows: DataFrame, stops: DataFrame, id_col: str = "location_id", name_col: str = "location_name", into: str = "key") -> DataFrame:
    """Adds the key under which a place stands in the graph, null if it has neither id nor name.

    An id of the timetable is its own key; any other place is the stop of the same name (in any case, the
    smallest id of several), else its id, else the slug of its name.
    """
    known = stops.select(F.col("stop_id").alias("_id")).distinct().withColumn("_is_stop", F.lit(True))
    named = stops.where(F.trim("stop_name") != "").groupBy(F.upper(F.trim("stop_name")).alias("_upper")).agg(F.min("stop_id").alias("_by_name"))
    j = rows.withColumn("_given", F.nullif(F.col(id_col), F.lit(""))).withColumn("_name", F.nullif(F.trim(name_col), F.lit("")))
    j = j.join(known, F.col("_given") == F.col("_id"), "left").join(named, F.upper("_name") == F.col("_upper"), "left")
    key = F.when(F.col("_is_stop"), F.col("_given")).otherwise(F.coalesce("_by_name", "_given", slug_key(F.col("_name"))))
    return j.select(*rows.columns, key.alias(into))


def schedule_pairs(stop_times: DataFrame) -> DataFrame:
    """(from_id, to_id) of consecutive different stops of each trip."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    pairs = stop_times.select(F.lag("stop_id").over(w).alias("from_id"), F.col("stop_id").alias("to_id"))
    return pairs.where("from_id <> to_id")


def rail_graph(stop_times: DataFrame, obs: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (from_id, to_id, scheduled, observed, n, p) and nodes (key, name, kind) of the railway.

    Two families of edges are summed: consecutive stops of the timetable's trips, and consecutive different
    places that one source reports of a run; ``p`` is an edge's share of what leaves ``from_id``.  Sources
    are not mixed, as they disagree on where a train is.  ``obs`` has run_id, source, ts, id, location_id,
    location_name and location_kind.  A node takes the name of its stop, else the first one reported.
    """
    placed = canonical(obs, stops).where("key IS NOT NULL")
    seen = transitions(placed.select("run_id", "source", "ts", "id", F.col("key").alias("location_id"))).withColumn("family", F.lit("observed"))
    both = schedule_pairs(stop_times).withColumn("family", F.lit("scheduled")).unionByName(seen)
    counted = both.groupBy("from_id", "to_id").agg(F.count_if(F.col("family") == "scheduled").alias("scheduled"), F.count_if(F.col("family") == "observed").alias("observed"), F.count("*").alias("n"))
    edges_ = counted.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_id")))
    at, stop = F.struct("run_id", "source", "ts", "id"), stops.groupBy(F.col("stop_id").alias("key")).agg(F.min("stop_name").alias("stop_name"))
    told = F.nullif(F.trim("location_name"), F.lit(""))
    first = placed.groupBy("key").agg(F.min_by(told, F.when(told.isNotNull(), at)).alias("told"), F.min_by("location_kind", at).alias("said"), F.lit(True).alias("was_seen"))
    ends = counted.select(F.col("from_id").alias("key")).union(counted.select("to_id")).distinct().withColumn("in_graph", F.lit(True))
    nodes = stop.withColumn("is_stop", F.lit(True)).join(first, "key", "full").join(ends, "key", "full")
    kind = F.when(F.col("is_stop"), "station").when(F.col("was_seen"), F.when(F.col("said") == "station", "station").otherwise("reporting_point")).otherwise("unknown")
    return edges_, nodes.select("key", F.coalesce("stop_name", "told").alias("name"), kind.alias("kind"))


def inferred(last: DataFrame, edges_: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """``last`` (key, previous) with ``outcome``, ``plausible`` (key, p) and ``segment`` (to, p).

    The k likeliest places after ``key``, with shares that add up to one, and the share of the first one
    among all that leave ``key``.  Where ``previous`` is known it is left out, unless nothing else follows.
    Outcome: ``next``; ``sink`` with an empty list where nothing follows; ``unknown`` with null for a key
    that the graph lacks.
    """
    best = Window.partitionBy("from_id").orderBy(F.desc("n"), "to_id")
    ranked = edges_.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k + 1)  # one more than k, as one may be left out
    after = ranked.groupBy(F.col("from_id").alias("_from")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col("to_id").alias("key"), "p"))), lambda x: F.struct(x["key"].alias("key"), x["p"].alias("p"))).alias("_after"))
    j = last.join(nodes.select(F.col("key").alias("_node")).distinct(), F.col("key") == F.col("_node"), "left").join(after, F.col("key") == F.col("_from"), "left")
    forward = F.filter("_after", lambda x: ~F.coalesce(x["key"] == F.col("previous"), F.lit(False)))
    j = j.withColumn("_top", F.slice(F.when(F.size(forward) > 0, forward).otherwise(F.col("_after")), 1, k))
    total = F.aggregate("_top", F.lit(0.0), lambda s, x: s + x["p"])
    known = F.col("_node").isNotNull() | F.col("_from").isNotNull()
    plausible = F.when(F.col("_from").isNotNull(), F.transform("_top", lambda x: F.struct(x["key"].alias("key"), (x["p"] / total).alias("p")))).when(known, F.array().cast("array<struct<key:string,p:double>>"))
    first = F.get("_top", F.lit(0))
    outcome = F.when(F.col("_from").isNotNull(), "next").when(known, "sink").otherwise("unknown")
    return j.select(*last.columns, outcome.alias("outcome"), plausible.alias("plausible"), F.when(first.isNotNull(), F.struct(first["key"].alias("to"), first["p"].alias("p"))).alias("segment"))
