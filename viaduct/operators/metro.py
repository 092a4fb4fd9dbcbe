"""Metro passages out of waiting-time frames, and whether vehicles can be followed from stop to stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.semantics import js_round
from viaduct.operators.joins import range_join

# Fixed values of the study: a vehicle is near, linked, or in another's way within these times; and its gate.
NEAR_SEC, LINK_MS, COLLISION_MS = 90, 1_200_000, 90_000
LEAST_CHAIN_PCT, MOST_COLLISION_PCT = 70, 20


def passages(messages: DataFrame, near_sec: int = NEAR_SEC) -> DataFrame:
    """(stop_id, line, passed_at): a line that was near in one frame of a stop and is missing in the next.

    ``messages`` has stop_id, fetched_at, line, seq and eta_sec; a frame is a stop and an instant, and of a
    line's messages in a frame the last one counts.  A frame without messages is one with a null line.
    """
    frames = messages.select("stop_id", "fetched_at").distinct()
    following = F.lead("fetched_at").over(Window.partitionBy("stop_id", F.floor(F.col("at") / 86_400_000)).orderBy("at"))
    # A day at a time with the first frame of the next day: no window holds a stop's whole history.
    day, ms = F.floor(F.col("fetched_at") / 86_400_000), 86_400_000
    first = frames.groupBy("stop_id", day.alias("day")).agg(F.min("fetched_at").alias("at"))
    inside = frames.withColumn("at", F.col("fetched_at")).withColumn("next_at", following).drop("at")
    after = first.withColumn("next_day", F.lead("at").over(Window.partitionBy("stop_id").orderBy("day"))).select("stop_id", F.col("day").alias("_day"), "next_day")  # a row for each day
    inside = inside.withColumn("_day", F.floor(F.col("fetched_at") / ms)).join(after, ["stop_id", "_day"]).select("stop_id", "fetched_at", F.coalesce("next_at", "next_day").alias("next_at"))
    seen = messages.where("line IS NOT NULL").groupBy("stop_id", "fetched_at", "line").agg(F.max_by("eta_sec", "seq").alias("eta_sec"))
    close = seen.where(F.col("eta_sec") <= near_sec).join(inside.where("next_at IS NOT NULL"), ["stop_id", "fetched_at"])
    still = seen.select("stop_id", "line", F.col("fetched_at").alias("next_at"))
    return close.join(still, ["stop_id", "line", "next_at"], "left_anti").select("stop_id", "line", F.col("next_at").alias("passed_at"))


def _followed(p: DataFrame, by: DataFrame, adjacent: DataFrame, within: int) -> DataFrame:
    """Rows of ``p`` that some passage in ``by`` follows at an adjacent stop of the same line."""
    nexts = p.join(adjacent, "stop_id")
    later = by.select(F.col("stop_id").alias("to_stop"), "line", F.col("passed_at").alias("then"))
    met = range_join(nexts, later, ["to_stop", "line"], "passed_at", "then", 1, within, "left_semi")
    return p.join(met.select("stop_id", "line", "passed_at").distinct(), ["stop_id", "line", "passed_at"], "left_semi")


def linked(p: DataFrame, adjacent: DataFrame, within: int = LINK_MS) -> DataFrame:
    """Passages followed within the time at an adjacent stop (stop_id, to_stop) by the same line."""
    return _followed(p, p, adjacent, within)


def chained(p: DataFrame, adjacent: DataFrame, within: int = LINK_MS) -> DataFrame:
    """Passages followed by one that is followed itself."""
    return _followed(p, linked(p, adjacent, within), adjacent, within)


def collisions(p: DataFrame, within: int = COLLISION_MS) -> DataFrame:
    """Passages less than ``within`` after the one before of the same stop and line."""
    rows = p.withColumn("_day", F.floor(F.col("passed_at") / 86_400_000))
    tail = rows.where(F.col("passed_at") % 86_400_000 >= 86_400_000 - within).withColumn("_day", F.col("_day") + 1).withColumn("_tail", F.lit(True))
    w = Window.partitionBy("stop_id", "line", "_day").orderBy("passed_at")
    both = rows.withColumn("_tail", F.lit(False)).unionByName(tail).withColumn("gap", F.col("passed_at") - F.lag("passed_at").over(w))
    return both.where(~F.col("_tail") & (F.col("gap") < within)).select("stop_id", "line", "passed_at", "gap")


def study(p: DataFrame, adjacent: DataFrame) -> DataFrame:
    """One row: passages, shares linked, chained and colliding in percent, and whether vehicles can be followed."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [n(p, "passages"), n(linked(p, adjacent), "link2"), n(chained(p, adjacent), "link3"), n(collisions(p), "hits")]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # one row each
    pct = lambda c: js_round(F.col(c) / F.greatest(F.lit(1), F.col("passages")) * 1000) / 10
    row = row.select("passages", pct("link2").alias("link2_pct"), pct("link3").alias("link3_pct"), pct("hits").alias("collision_pct"))
    return row.withColumn("go", (F.col("link3_pct") >= LEAST_CHAIN_PCT) & (F.col("collision_pct") < MOST_COLLISION_PCT))


def shown_line(name: Column, most: int = 8) -> Column:
    """A line's name if it is short enough to show and without a bracket."""
    return F.when((F.length(name) <= most) & ~name.contains("("), name)


def live_lines(messages: DataFrame, as_of: int, frames: int = 3) -> DataFrame:
    """(stop_id, line, eta_sec, told_at): what the newest of a stop's last frames up to ``as_of`` that names a line
    says of it first."""
    past = messages.where(F.col("fetched_at") <= as_of)
    order = Window.partitionBy("stop_id").orderBy(F.desc("fetched_at"))
    last = past.select("stop_id", "fetched_at").distinct().withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= frames)
    told = past.where("line IS NOT NULL").join(last, ["stop_id", "fetched_at"])
    best = told.groupBy("stop_id", "line").agg(F.min_by(F.struct("eta_sec", F.col("fetched_at").alias("told_at")), F.struct("_k", "seq")).alias("b"))
    return best.select("stop_id", "line", "b.eta_sec", "b.told_at")


def board(departures: DataFrame, messages: DataFrame, as_of: int, now_sec: int, behind_sec: int = 300, ahead_sec: int = 5400, most: int = 40) -> DataFrame:
    """Each stop's next departures (stop_id, line, trip_id, departure_sec) with ``scheduled_in_sec`` and what is told
    of their line, null where nothing is.

    Shown are the first ``most`` from ``behind_sec`` before ``now_sec``, seconds into the service day, to
    ``ahead_sec`` after it.
    """
    due = departures.where(F.col("departure_sec").between(now_sec - behind_sec, now_sec + ahead_sec))
    order = Window.partitionBy("stop_id").orderBy("departure_sec", "trip_id")
    shown = due.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")
    live = live_lines(messages, as_of)
    joined = shown.join(live, ["stop_id", "line"], "left")
    return joined.select("stop_id", "line", "trip_id", (F.col("departure_sec") - now_sec).alias("scheduled_in_sec"), F.col("eta_sec").alias("live_eta_sec"), "told_at")
