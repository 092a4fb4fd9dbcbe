"""Join, graph, fusion and serving queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from viaduct.functions.semantics import name_key
from viaduct.operators import fusion as fu
from viaduct.operators import graph as gr
from viaduct.operators import joins as jn
from viaduct.operators import metro as me
from viaduct.sources import bindings as b
from viaduct.sources.bindings import oracle
from viaduct.streaming import live

#: An instant within the observations.
NOW = 1_705_500_000_000
MINUTE = 60_000


def connection_pairs(s, d):
    """Changes between trains of one service day at a stop within 5 to 30 minutes, and whether two minutes were left."""
    days = b.table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("service_date"))
    e = b.stop_events(s, d).join(days, "run_id")
    a = e.select("stop_id", "service_date", F.col("run_id").alias("a_run"), F.col("sched_arr_epoch").alias("a_arr"), F.col("actual_arr_epoch").alias("a_actual"))
    c = e.select("stop_id", "service_date", F.col("run_id").alias("b_run"), F.col("sched_dep_epoch").alias("b_dep"), F.col("actual_dep_epoch").alias("b_actual"))
    pairs = jn.range_join(a, c, ["stop_id", "service_date"], "a_arr", "b_dep", 5 * MINUTE, 30 * MINUTE).where("a_run <> b_run")
    return pairs.select("stop_id", "a_run", "b_run", ((F.col("b_dep") - F.col("a_arr")) / 1000).cast("long").alias("slack_sec"), (F.col("a_actual") <= F.col("b_actual") - 120_000).alias("made"))


def other_source_delay(s, d, tolerance):
    o = b.observations(s, d)
    theirs = o.where("source = 'viaggiatreno' AND delay_seconds IS NOT NULL").select("run_id", F.col("ts").alias("r_ts"), F.col("id").alias("r_id"), F.col("delay_seconds").alias("other_delay"))
    return jn.asof_backward(o.where("source = 'mia'").select("id", "run_id", "ts"), theirs, ["run_id"], "ts", "r_ts", ["other_delay", "r_id"], "r_id", tolerance).select("id", "other_delay", F.col("r_id").alias("other_id"))


def train_history(s, d):
    """Usual delay of a train number at its destination before each run."""
    r = b.runs(s, d).select("run_id", "train_number", "destination_stop_id", "sched_arr_epoch")
    e = b.stop_events(s, d).select("run_id", F.col("stop_id").alias("destination_stop_id"), "arr_delay_sec", "stop_sequence")
    last = e.join(r, ["run_id", "destination_stop_id"]).groupBy("run_id", "train_number", "sched_arr_epoch").agg(F.max_by("arr_delay_sec", "stop_sequence").alias("delay")).where("delay IS NOT NULL")
    return last.select("run_id", jn.recent_median(last, ["train_number"], ["sched_arr_epoch", "run_id"], "delay", 20, 3).alias("usual_delay_sec"))


def alerts_on_route(s, d):
    """Cancelled stops elsewhere that lie on a run's route, at most ten."""
    e = b.stop_events(s, d)
    alerts = e.where("cancelled = 1").groupBy("stop_id").agg(F.count("*").alias("n"))
    return e.select("run_id", "stop_id").distinct().join(alerts, "stop_id").groupBy("run_id").agg(F.least(F.sum("n"), F.lit(10)).alias("alerts"))


def cancelled_nearby(s, d):
    """Runs cancelled at the same stop within 45 minutes before an arrival."""
    e = b.stop_events(s, d)
    mine = e.select("stop_id", "run_id", "stop_sequence", "sched_arr_epoch")
    gone = e.where("cancelled = 1").select("stop_id", F.col("run_id").alias("c_run"), F.col("sched_arr_epoch").alias("c_arr"))
    return jn.range_join(mine, gone, ["stop_id"], "sched_arr_epoch", "c_arr", -45 * MINUTE, 0).where("c_run <> run_id").groupBy("run_id", "stop_sequence").agg(F.count("*").alias("n"))


def unscored(s, d):
    p = b.predictions(s, d)
    return p.join(b.outcomes(p), "prediction_id", "left_anti").groupBy("model_version").agg(F.count("*").alias("n"))


def run_states(s, d):
    r, o = b.runs(s, d).select("run_id", "train_number"), b.observations(s, d)
    state = fu.latest_by_source(o).groupBy("run_id").agg(F.max("ts").alias("updated_at"))
    return r.join(state, "run_id", "left").select("run_id", "train_number", F.coalesce("updated_at", F.lit(0)).alias("updated_at"))


def named_nearest(s, d):
    """Places named like a stop, up to four kilometres from it; other stops of the name would be candidates too."""
    n = F.col("p_partkey") % 120
    name = F.concat(F.lit("SUPPLIER-"), F.lpad(n.cast("string"), 9, "0"), F.when(F.col("p_partkey") % 3 == 0, " bis").otherwise(""))
    off = (F.col("p_partkey") % 5).cast("double") / F.lit(111.0)
    places = b.table(s, d, "part").select(F.col("p_partkey").alias("place_id"), name_key(name).alias("name_key"), (F.lit(45.0) + (n % 97) / F.lit(100.0) + off).alias("lat"), (F.lit(8.5) + ((n * 7) % 193) / F.lit(100.0)).alias("lon"))
    stops = b.stops(s, d).withColumn("name_key", name_key(F.col("stop_name")))
    return jn.nearest_by_name(places, stops, "name_key", 3.0).select("place_id", "stop_id", F.round("km", 4).alias("km"))


def resolved(s, d):
    r = b.runs(s, d).select("run_id", "service_date", "train_number", "sched_dep_epoch")
    want = r.select(F.col("run_id").alias("want_id"), "service_date", "train_number", (F.col("sched_dep_epoch") + (F.col("run_id") % 3) * 300_000).alias("want_dep"))
    return jn.resolve_runs(want, r)


def newest_connecting_delay(s, d):
    o = b.observations(s, d).where("delay_seconds IS NOT NULL")
    best = o.groupBy("run_id").agg(F.max_by("delay_seconds", F.struct("ts", "id")).alias("delay_seconds"))
    return b.runs(s, d).select("run_id").join(best, "run_id", "left")


def coverage_by_kind(s, d):
    """Quarter hours with observations, located ones and delayed ones side by side: an outer merge of three counts."""
    o = b.observations(s, d)
    parts = [o.select("ts", F.lit("all").alias("source")), o.where("observed_at IS NOT NULL").select("ts", F.lit("observed").alias("source")), o.where("delay_seconds >= 300").select("ts", F.lit("late").alias("source"))]
    counts = live.coverage(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return counts.groupBy("bucket").agg(*[F.coalesce(F.sum(F.when(F.col("source") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in ("all", "observed", "late")])


def network_delay(s, d):
    """Mean delay over the ten minutes up to each observation."""
    o = b.observations(s, d)
    # A day at a time and its predecessor's tail: no window holds the whole table.
    day = 86_400_000
    spread = o.select("id", "ts", "delay_seconds", F.explode(F.array_distinct(F.array(F.floor(F.col("ts") / day), F.floor((F.col("ts") + 10 * MINUTE) / day)))).alias("day"))
    w = Window.partitionBy("day").orderBy("ts").rangeBetween(-10 * MINUTE, 0)
    return spread.withColumn("mean_delay", F.round(F.avg("delay_seconds").over(w), 4)).where(F.floor(F.col("ts") / day) == F.col("day")).select("id", "mean_delay")


def bunching(s, d):
    """Runs of a line that come to a stop less than 90 seconds after the one before."""
    line = b.runs(s, d).select("run_id", F.col("route_id").alias("line"))
    e = b.stop_events(s, d).where("actual_arr_epoch IS NOT NULL").join(line, "run_id").select("stop_id", "line", F.col("actual_arr_epoch").alias("passed_at"))
    return me.collisions(e).groupBy("stop_id", "line").agg(F.count("*").alias("n"))


def eta_velocity(s, d):
    """Change of the estimate in seconds over five minutes, and the change of that."""
    p = b.predictions(s, d)
    w = Window.partitionBy("run_id").orderBy("generated_at", "prediction_id")
    gap, moved = (F.col("generated_at") - F.lag("generated_at").over(w)) / 1000, (F.col("our_p50") - F.lag("our_p50").over(w)) / 1000
    p = p.withColumn("velocity", F.when(gap >= 30, moved / gap * 300))
    return p.select("prediction_id", F.round("velocity", 4).alias("velocity"), F.round(F.col("velocity") - F.lag("velocity").over(w), 4).alias("acceleration"))


def platform_changes(s, d):
    e = b.stop_events(s, d)
    w = Window.partitionBy("run_id").orderBy("stop_sequence").rowsBetween(Window.unboundedPreceding, -1)
    return e.select("run_id", "stop_sequence", F.last(F.when(F.col("cancelled").isNull(), F.col("platform_actual")), True).over(w).alias("previous_platform"))


def platform_modes(s, d):
    """The usual platform of each stop and route, and its share."""
    e = b.stop_events(s, d).join(b.runs(s, d).select("run_id", "route_id"), "run_id")
    n = e.groupBy("stop_id", "route_id", "platform_actual").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stop_id", "route_id")
    ranked = n.withColumn("total", F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "platform_actual")))
    return ranked.where("k = 1").select("stop_id", "route_id", F.col("platform_actual").alias("platform"), F.round(F.col("n") / F.col("total"), 6).alias("share"))


def scope(s, d):
    """First stop not served at the instant of each run's midpoint, and the segments around it."""
    e = b.stop_events(s, d)
    mid = e.groupBy("run_id").agg(F.floor((F.min("sched_arr_epoch") + F.max("sched_arr_epoch")) / 2).alias("at"))
    j = e.join(mid, "run_id")
    nxt = F.min(F.when(F.coalesce(F.col("actual_arr_epoch"), F.col("sched_arr_epoch")) > F.col("at"), F.col("stop_sequence"))).over(Window.partitionBy("run_id"))
    return j.withColumn("next", nxt).where(F.col("stop_sequence").between(F.col("next") - 1, F.col("next") + 2)).select("run_id", "stop_sequence", F.col("next").alias("next_sequence"))


QUERIES = {
    "j06_scored_runs": lambda s, d: b.scored(s, d).join(b.runs(s, d).select("run_id", "train_number", "route_id"), "run_id").groupBy("route_id", "model_version").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("our_error_sec")), 4).alias("mae")),
    "j09_connection_pairs": connection_pairs,
    "j10_asof_tolerance": lambda s, d: other_source_delay(s, d, 3_600_000),
    "j11_asof_latest": lambda s, d: other_source_delay(s, d, None),
    "j12_train_history": train_history,
    "j13_route_alerts": alerts_on_route,
    "j14_runs_with_actuals": lambda s, d: b.runs(s, d).join(b.stop_events(s, d).where("actual_arr_epoch IS NOT NULL"), "run_id", "left_semi").select("run_id"),
    "j15_unscored": unscored,
    "j17_run_states": run_states,
    "j22_named_nearest": named_nearest,
    "j26_cancelled_nearby": cancelled_nearby,
    "j29_newest_delay": newest_connecting_delay,
    "j31_coverage": coverage_by_kind,
    "j32_resolve_run": resolved,
    "a09_source_coverage": lambda s, d: live.coverage(b.observations(s, d)),
    "a12_network_delay": network_delay,
    "a24_platform_modes": platform_modes,
    "t05_successors": lambda s, d: gr.successors(gr.edges(gr.transitions(b.observations(s, d))), 3),
    "w09_latest_by_source": lambda s, d: fu.latest_by_source(b.observations(s, d)),
    "w14_bunching": bunching,
    "w16_eta_velocity": eta_velocity,
    "w19_previous_platform": platform_changes,
    "w20_scope": scope,
    "f02_fused_state": lambda s, d: fu.fuse(b.observations(s, d), NOW),
}

MINE = "mine AS (SELECT id, run_id, ts FROM obs WHERE source = 'mia'), theirs AS (SELECT id, run_id, ts, delay_seconds FROM obs WHERE source = 'viaggiatreno' AND delay_seconds IS NOT NULL)"
ASOF = """best AS (SELECT m.id, arg_max(t.id, t.ts * 1000000 + t.id) AS other_id, max(t.ts) AS at, any_value(m.ts) AS ts FROM mine m JOIN theirs t ON t.run_id = m.run_id AND t.ts <= m.ts GROUP BY m.id)
SELECT m.id, CAST(t.delay_seconds AS INT) AS other_delay, t.id AS other_id FROM mine m LEFT JOIN best x ON x.id = m.id {within} LEFT JOIN theirs t ON t.id = x.other_id"""
LAST = "last AS (SELECT run_id, source, max(ts * 1000000 + id) AS k FROM obs {where} GROUP BY ALL), lat AS (SELECT o.* FROM obs o JOIN last l ON o.run_id = l.run_id AND o.source = l.source AND o.ts * 1000000 + o.id = l.k)"
MOVES = "mv AS (SELECT lag(location_id) OVER (PARTITION BY run_id, source ORDER BY ts, id) AS from_id, location_id AS to_id FROM obs WHERE location_id IS NOT NULL), ed AS (SELECT from_id, to_id, count(*) AS n FROM mv WHERE from_id <> to_id GROUP BY ALL)"

CONNECTIONS = "SELECT a.stop_id, a.run_id AS a_run, b.run_id AS b_run, CAST((b.sched_dep_epoch - a.sched_arr_epoch) // 1000 AS BIGINT) AS slack_sec, a.actual_arr_epoch <= b.actual_dep_epoch - 120000 AS made FROM (SELECT * FROM se JOIN orders ON o_orderkey = run_id) a JOIN (SELECT * FROM se JOIN orders ON o_orderkey = run_id) b ON a.stop_id = b.stop_id AND a.o_orderdate = b.o_orderdate AND a.run_id <> b.run_id AND b.sched_dep_epoch - a.sched_arr_epoch BETWEEN 300000 AND 1800000"

ORACLE_SQL = {
    "j06_scored_runs": oracle("se ends runs pred scored", "SELECT route_id, model_version, count(*) AS n, round(avg(abs(our_error_sec)), 4) AS mae FROM scored JOIN runs USING (run_id) GROUP BY ALL"),
    "j09_connection_pairs": oracle("se", CONNECTIONS),
    "j10_asof_tolerance": oracle("obs", f"WITH {MINE}, {ASOF.format(within='AND x.ts - x.at <= 3600000')}"),
    "j11_asof_latest": oracle("obs", f"WITH {MINE}, {ASOF.format(within='')}"),
    "j12_train_history": oracle("se ends runs", """WITH l AS (SELECT r.run_id, r.train_number, r.sched_arr_epoch, arg_max_null(e.arr_delay_sec, e.stop_sequence) AS delay FROM se e JOIN runs r ON e.run_id = r.run_id AND e.stop_id = r.destination_stop_id GROUP BY ALL HAVING delay IS NOT NULL),
h AS (SELECT run_id, list(delay) OVER (PARTITION BY train_number ORDER BY sched_arr_epoch, run_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ds FROM l)
SELECT run_id, CASE WHEN len(ds) >= 3 THEN list_sort(ds)[len(ds) // 2 + 1] END AS usual_delay_sec FROM h"""),
    "j13_route_alerts": oracle("se", "WITH al AS (SELECT stop_id, count(*) AS n FROM se WHERE cancelled = 1 GROUP BY ALL) SELECT run_id, CAST(least(sum(n), 10) AS BIGINT) AS alerts FROM (SELECT DISTINCT run_id, stop_id FROM se) JOIN al USING (stop_id) GROUP BY run_id"),
    "j14_runs_with_actuals": oracle("se ends runs", "SELECT run_id FROM runs r WHERE EXISTS (SELECT 1 FROM se WHERE se.run_id = r.run_id AND actual_arr_epoch IS NOT NULL)"),
    "j15_unscored": oracle("se ends pred scored", "SELECT model_version, count(*) AS n FROM pred WHERE prediction_id NOT IN (SELECT prediction_id FROM scored) GROUP BY ALL"),
    "j17_run_states": oracle("se ends runs obs", "WITH st AS (SELECT run_id, max(ts) AS u FROM obs GROUP BY ALL) SELECT r.run_id, train_number, coalesce(u, 0) AS updated_at FROM runs r LEFT JOIN st ON st.run_id = r.run_id"),
    "j22_named_nearest": oracle("stops", """WITH q AS (SELECT p_partkey AS place_id, p_partkey % 120 AS n, 'supplier' || lpad(CAST(p_partkey % 120 AS VARCHAR), 9, '0') || CASE WHEN p_partkey % 3 = 0 THEN 'bis' ELSE '' END AS key, CAST(p_partkey % 5 AS DOUBLE) / CAST(111.0 AS DOUBLE) AS o FROM part),
p AS (SELECT place_id, key, CAST(45.0 AS DOUBLE) + (n % 97) / CAST(100.0 AS DOUBLE) + o AS lat, CAST(8.5 AS DOUBLE) + ((n * 7) % 193) / CAST(100.0 AS DOUBLE) AS lon FROM q),
j AS (SELECT place_id, stop_id, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(stop_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(stop_lat)) * pow(sin(radians(stop_lon - lon) / 2), 2))) AS km FROM p JOIN stops ON key = regexp_replace(lower(stop_name), '[^a-z0-9]', '', 'g'))
SELECT place_id, arg_min(stop_id, (km, stop_id)) AS stop_id, round(min(km), 4) AS km FROM j WHERE km <= 3 GROUP BY place_id"""),
    "j26_cancelled_nearby": oracle("se", "SELECT a.run_id, a.stop_sequence, count(*) AS n FROM se a JOIN se c ON c.stop_id = a.stop_id AND c.cancelled = 1 AND c.run_id <> a.run_id AND c.sched_arr_epoch - a.sched_arr_epoch BETWEEN -2700000 AND 0 GROUP BY ALL"),
    "j29_newest_delay": oracle("se ends runs obs", "WITH o AS (SELECT run_id, arg_max(delay_seconds, ts * 1000000 + id) AS delay_seconds FROM obs WHERE delay_seconds IS NOT NULL GROUP BY ALL) SELECT r.run_id, delay_seconds FROM runs r LEFT JOIN o ON o.run_id = r.run_id"),
    "j31_coverage": oracle("obs", "SELECT ts // 900000 * 900000 AS bucket, count(*) AS n_all, count(observed_at) AS n_observed, count(*) FILTER (delay_seconds >= 300) AS n_late FROM obs GROUP BY ALL"),
    "j32_resolve_run": oracle("se ends runs", """WITH w AS (SELECT run_id AS want_id, service_date, train_number, sched_dep_epoch + (run_id % 3) * 300000 AS want_dep FROM runs),
f AS (SELECT want_id, coalesce(min(run_id) FILTER (sched_dep_epoch = want_dep), CASE WHEN count(DISTINCT run_id) = 1 THEN min(run_id) END) AS run_id FROM w JOIN runs r ON r.service_date = w.service_date AND r.train_number = w.train_number AND abs(sched_dep_epoch - want_dep) <= 600000 GROUP BY want_id)
SELECT w.want_id, f.run_id FROM w LEFT JOIN f ON f.want_id = w.want_id"""),
    "a09_source_coverage": oracle("obs", "SELECT ts // 900000 * 900000 AS bucket, source, count(*) AS n FROM obs GROUP BY ALL"),
    "a12_network_delay": oracle("obs", "SELECT id, round(avg(delay_seconds) OVER (ORDER BY ts RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW), 4) AS mean_delay FROM obs"),
    "a24_platform_modes": oracle("se ends runs", "WITH n AS (SELECT stop_id, route_id, platform_actual, count(*) AS n FROM se JOIN runs USING (run_id) GROUP BY ALL) SELECT stop_id, route_id, platform_actual AS platform, round(n / sum(n) OVER (PARTITION BY stop_id, route_id), 6) AS share FROM n QUALIFY row_number() OVER (PARTITION BY stop_id, route_id ORDER BY n DESC, platform_actual) = 1"),
    "t05_successors": oracle("obs", f"WITH {MOVES}, top AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY n DESC, to_id) AS rank FROM ed QUALIFY rank <= 3) SELECT from_id, to_id, n, CAST(rank AS INT) AS rank, round(n / sum(n) OVER (PARTITION BY from_id), 6) AS share FROM top"),
    "w09_latest_by_source": oracle("obs", f"WITH {LAST.format(where='')} SELECT run_id, source, id, ts, delay_seconds, location_id FROM lat"),
    "w14_bunching": oracle("se ends runs", "WITH g AS (SELECT stop_id, route_id AS line, actual_arr_epoch - lag(actual_arr_epoch) OVER (PARTITION BY stop_id, route_id ORDER BY actual_arr_epoch) AS gap FROM se JOIN runs USING (run_id) WHERE actual_arr_epoch IS NOT NULL) SELECT stop_id, line, count(*) AS n FROM g WHERE gap < 90000 GROUP BY ALL"),
    "w16_eta_velocity": oracle("se ends pred", "WITH v AS (SELECT *, (generated_at - lag(generated_at) OVER w) / 1000 AS gap, (our_p50 - lag(our_p50) OVER w) / 1000 AS moved FROM pred WINDOW w AS (PARTITION BY run_id ORDER BY generated_at, prediction_id)), x AS (SELECT *, CASE WHEN gap >= 30 THEN moved / gap * 300 END AS vel FROM v) SELECT prediction_id, round(vel, 4) AS velocity, round(vel - lag(vel) OVER (PARTITION BY run_id ORDER BY generated_at, prediction_id), 4) AS acceleration FROM x"),
    "w19_previous_platform": oracle("se", "SELECT run_id, stop_sequence, last_value(CASE WHEN cancelled IS NULL THEN platform_actual END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY stop_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_platform FROM se"),
    "w20_scope": oracle("se", "WITH m AS (SELECT run_id, (min(sched_arr_epoch) + max(sched_arr_epoch)) // 2 AS t FROM se GROUP BY ALL), x AS (SELECT run_id, stop_sequence, min(CASE WHEN coalesce(actual_arr_epoch, sched_arr_epoch) > t THEN stop_sequence END) OVER (PARTITION BY run_id) AS next_sequence FROM se JOIN m USING (run_id)) SELECT * FROM x WHERE stop_sequence BETWEEN next_sequence - 1 AND next_sequence + 2"),
    "f02_fused_state": oracle("obs", f"""WITH {LAST.format(where=f'WHERE ts <= {NOW}')}, st AS (SELECT run_id, count(*) AS sources, max(ts) AS ts, max(delay_seconds) - min(delay_seconds) AS spread_sec, arg_max_null(source, ts * 1000000 + id) AS source, arg_max_null(delay_seconds, ts * 1000000 + id) AS delay_seconds, arg_max_null(location_id, ts * 1000000 + id) AS location_id FROM lat GROUP BY run_id),
a AS (SELECT *, ({NOW} - ts) // 1000 AS age_sec, coalesce(spread_sec, 0) AS sp FROM st)
SELECT run_id, sources, source, delay_seconds, location_id, spread_sec, age_sec, CASE WHEN sources >= 2 AND age_sec < 120 AND sp <= 120 THEN 'HIGH' WHEN age_sec < 600 AND sp <= 600 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM a"""),
}
