"""Serving views: trust between sources, ranking of journeys, notices, station search and nearest stations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.semantics import fold_sorted, haversine_km, normal_cdf, type7


def canonical_key(places: DataFrame, stops: DataFrame) -> DataFrame:
    """Adds ``by_id`` and ``by_name``, the stop with a place's ``raw_id`` and that with its ``name_key`` (ties: smaller id)."""
    named = stops.groupBy("name_key").agg(F.min("stop_id").alias("by_name"))
    ids = stops.select(F.col("stop_id").alias("raw_id"), F.col("stop_id").alias("by_id")).distinct()
    return places.join(ids, "raw_id", "left").join(named, "name_key", "left")


def nearest_within(places: DataFrame, stops: DataFrame, limit_km: float, max_lat: float = 60.0, levels: int = 10) -> DataFrame:
    """The nearest stop within ``limit_km`` of each place south of ``max_lat`` (ties to the millimetre: smaller stop_id).

    Places and stops at equal coordinates count once.  Cells of a grid are at least as wide as the limit and are halved
    ``levels`` times.  Some stop of the smallest cell that a place shares with one bounds its distance, and the place
    meets the stops of nine cells of the smallest width that is not below the bound.
    """
    high = limit_km / 111.0
    wide = high / math.cos(math.radians(max_lat))
    km_to = lambda lat, lon: F.round(haversine_km(F.col("lat"), F.col("lon"), F.col(lat), F.col(lon)), 6)
    cell = lambda c, width: F.floor(F.col(c) * F.pow(F.lit(2.0), "_l") / width)
    every = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    spots = stops.groupBy("stop_lat", "stop_lon").agg(F.min("stop_id").alias("stop_id")).withColumn("_l", every)
    spots = spots.withColumn("_y", cell("stop_lat", high)).withColumn("_x", cell("stop_lon", wide))
    some = spots.groupBy("_l", "_y", "_x").agg(F.min(F.struct("stop_lat", "stop_lon")).alias("_one"))
    at = lambda rows: rows.withColumn("_y", cell("lat", high)).withColumn("_x", cell("lon", wide))
    asked = places.select("lat", "lon").distinct()
    own = at(asked.withColumn("_l", every)).join(some, ["_l", "_y", "_x"], "left").groupBy("lat", "lon").agg(F.max_by("_one", F.when(F.col("_one").isNotNull(), F.col("_l"))).alias("_one"))
    bound = F.coalesce(km_to("_one.stop_lat", "_one.stop_lon"), F.lit(limit_km)) + 1e-6
    finest = sum(((bound <= limit_km / 2**k).cast("int") for k in range(1, levels + 1)), F.lit(0))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    near = at(own.select("lat", "lon", finest.alias("_l"))).withColumn("_y", F.explode(F.transform(around, lambda i: F.col("_y") + i))).withColumn("_x", F.explode(F.transform(around, lambda i: F.col("_x") + i)))
    near = near.join(spots, ["_l", "_y", "_x"]).withColumn("km", km_to("stop_lat", "stop_lon")).where(F.col("km") <= limit_km)
    best = near.groupBy("lat", "lon").agg(F.min(F.struct("km", "stop_id")).alias("b"))
    return places.join(best, ["lat", "lon"]).groupBy("place_id").agg(F.min("b").alias("b")).select("place_id", "b.stop_id", "b.km")


def evidence(t: DataFrame, key: str) -> DataFrame:
    """Trains, severe delays, median and maximum of each key's traversals, and its worst segment by median."""
    whole = t.groupBy(key).agg(
        F.count_distinct("run_id").alias("trains"), F.count_if(F.col("delay_delta_sec") >= 600).alias("severe"),
        F.round(type7(F.col("delay_delta_sec"), 0.5), 6).alias("median_delta"), F.max("delay_delta_sec").alias("max_delta"),
    )
    each = t.where("delay_delta_sec IS NOT NULL").groupBy(key, "segment_id").agg(F.round(type7(F.col("delay_delta_sec"), 0.5), 6).alias("m"))
    return whole.join(each.groupBy(key).agg(F.min_by("segment_id", F.struct(-F.col("m"), "segment_id")).alias("worst_segment")), key, "left")


def rank_journeys(options: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranks options by expected arrival plus a thousandfold risk; the first one still boardable is recommended."""
    w = Window.partitionBy(*keys)
    ranked = options.withColumn("rank", F.row_number().over(w.orderBy(F.col("expected") + F.col("risk_sec") * 1000, "dep", "run_id")))
    return ranked.withColumn("recommended", F.coalesce(F.col("rank") == F.min(F.when(F.col("boardable"), F.col("rank"))).over(w), F.lit(False)))


def boardable(status: Column, actual_dep: Column, dep: Column, delay_sec: Column, now: Column) -> Column:
    """Not cancelled, arrived or gone, and leaving, with its delay, no more than half a minute ago."""
    over = F.coalesce(status.isin("cancelled", "arrived"), F.lit(False))
    return ~over & actual_dep.isNull() & (dep + F.coalesce(delay_sec, F.lit(0)) * 1000 >= now - 30_000)


def top_platforms(scores: DataFrame, keys: Sequence[str], score: str, label: str, least: float = 0.1, most: int = 3) -> DataFrame:
    """Adds ``platforms``: of each key's classes the likeliest by softmax, those of at least ``least``, to three decimals."""
    rows = scores.groupBy(*keys).agg(F.collect_list(F.struct(F.col(score).alias("s"), F.col(label).alias("n"))).alias("c"), F.max(score).alias("most"))
    rows = rows.withColumn("c", F.transform("c", lambda x: F.struct(F.exp(x["s"] - F.col("most")).alias("e"), x["n"].alias("n")))).withColumn("total", F.aggregate("c", F.lit(0.0), lambda t, x: t + F.coalesce(x["e"], F.lit(0.0))))
    p = F.transform("c", lambda x: F.struct((-F.floor(x["e"] / F.col("total") * 1000 + 0.5) / 1000).alias("p"), x["n"].alias("n")))
    best = F.slice(F.filter(F.array_sort(p), lambda x: -x["p"] >= least), 1, most)
    return rows.where("total > 0").select(*keys, F.transform(best, lambda x: F.struct(x["n"].alias("platform"), (-x["p"]).alias("p"))).alias("platforms"))


def likely_area(states: DataFrame, events: DataFrame, stops: DataFrame, as_of: int) -> DataFrame:
    """Between which stops a running train is: from where it was seen, else the stop before, to the next one
    without actual times.  ``states`` has run_id, status, location_id and seen_at; runs without both ends are left out."""
    order = Window.partitionBy("run_id").orderBy(F.coalesce("stop_sequence", F.lit(-1)), F.coalesce("sched_arr_epoch", F.lit(-1)), "stop_id")
    e = events.withColumn("before", F.lag("stop_id").over(order)).withColumn("pos", F.row_number().over(order))
    e = e.where("actual_arr_epoch IS NULL AND actual_dep_epoch IS NULL AND coalesce(cancelled, 0) <> 1")
    nxt = e.groupBy("run_id").agg(F.min_by(F.struct("stop_id", "before"), "pos").alias("n")).select("run_id", F.col("n.stop_id").alias("to_stop_id"), "n.before")
    spot = lambda name: stops.select(F.col("stop_id").alias(f"{name}_stop_id"), F.col("stop_lat").alias(f"{name}_lat"), F.col("stop_lon").alias(f"{name}_lon"))
    rows = states.where("status = 'running' AND seen_at IS NOT NULL").join(nxt, "run_id")
    rows = rows.join(spot("seen"), rows["location_id"] == F.col("seen_stop_id"), "left").join(spot("before"), rows["before"] == F.col("before_stop_id"), "left").join(spot("to").withColumnRenamed("to_stop_id", "_to"), rows["to_stop_id"] == F.col("_to"), "left")
    seen = F.when(F.col("seen_stop_id") != F.col("to_stop_id"), F.struct(F.col("seen_stop_id").alias("id"), F.col("seen_lat").alias("lat"), F.col("seen_lon").alias("lon")))
    prior = F.when(F.col("before_stop_id").isNotNull(), F.struct(F.col("before_stop_id").alias("id"), F.col("before_lat").alias("lat"), F.col("before_lon").alias("lon")))
    rows = rows.withColumn("f", F.coalesce(seen, prior)).where(F.col("f.id") != F.col("to_stop_id"))
    age = F.greatest(F.lit(0), F.floor((F.lit(as_of) - F.col("seen_at")) / 1000 + 0.5)).cast("long")
    return rows.select("run_id", F.col("f.id").alias("from_stop_id"), F.col("f.lat").alias("from_lat"), F.col("f.lon").alias("from_lon"), "to_stop_id", "to_lat", "to_lon", age.alias("age_sec"))


def made_probability(slack_sec: Column, transfer_sec: int, sigma_sec: int) -> Column:
    """Probability that a change is made, between .001 and .999."""
    return F.greatest(F.lit(0.001), F.least(F.lit(0.999), normal_cdf((slack_sec - transfer_sec) / F.lit(float(sigma_sec)))))


def notices(changes: DataFrame, moved_ms: int, gap_ms: int) -> DataFrame:
    """Estimates of a run that are told to a traveller: the first, then each that moved by more than ``moved_ms``
    from the one told last, at least ``gap_ms`` after it.  A run's rows are sorted and folded together."""

    def step(told: tuple | None, r) -> tuple[tuple | None, tuple | None]:
        if told is not None and (abs(r.our_p50 - told[0]) <= moved_ms or r.generated_at - told[1] < gap_ms):
            return told, None
        return (r.our_p50, r.generated_at), (r.run_id, r.prediction_id, r.generated_at)

    rows = changes.where("our_p50 IS NOT NULL").select("run_id", "generated_at", "prediction_id", "our_p50")
    return fold_sorted(rows, ["run_id"], ["generated_at", "prediction_id"], step, "run_id long, prediction_id long, generated_at long")


def search_score(name: Column, query: str) -> Column:
    """Sum over the query's words of 10 for a word's beginning, 8 for the initials', 4 for a part, plus the word's
    length; 6 more if the whole name begins with the query; null unless every word matches."""
    low = F.lower(name)
    initials = F.array_join(F.transform(F.split(low, r"\s+"), lambda w: F.substring(w, 1, 1)), "")
    score = F.when(low.startswith(query.lower()), 6).otherwise(0)
    for token in query.lower().split():
        points = F.when(low.startswith(token) | low.contains(f" {token}"), 10).when(initials.startswith(token), 8).when(low.contains(token), 4)
        score = score + points + len(token)
    return score


def expected_arrival(planned: Column, actual: Column, predicted: Column, p50: Column, run_planned: Column, departure_delay_sec: Column) -> tuple[Column, Column]:
    """When a leg arrives and whether that is more than the timetable.

    The actual time, else the operator's for the stop, else the leg's plan moved by our estimate's distance from the
    run's own plan, else by the delay at departure, else the plan.
    """
    live = F.coalesce(actual, predicted, planned + (p50 - run_planned), planned + departure_delay_sec * 1000)
    return F.coalesce(live, planned), live.isNotNull()


def risk_penalty(p50: Column, p90: Column, most_sec: int = 300) -> Column:
    """A fifth of the distance from median to upper quantile in whole seconds, at most ``most_sec``."""
    return F.when(p50.isNotNull() & p90.isNotNull(), F.least(F.lit(most_sec).cast("long"), F.floor(0.2 * (p90 - p50) / 1000 + 0.5).cast("long")))
