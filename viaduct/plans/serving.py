"""Queries behind the serving views: boards, aliases, trust, notices, evidence, search and health."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from viaduct.functions.semantics import name_key, slug, upper_median
from viaduct.operators import fusion as fu
from viaduct.operators import joins as jn
from viaduct.operators import serving as sv
from viaduct.plans.joins import CONNECTIONS, NOW, connection_pairs
from viaduct.plans.segments import SEG, fi, traversals
from viaduct.sources import bindings as b
from viaduct.sources.bindings import oracle

MINUTE, DAY = 60_000, 86_400_000
QUERY = "co wi"


def named_events(s, d):
    return b.stop_events(s, d).join(b.stops(s, d).select("stop_id", "stop_name"), "stop_id").withColumn("key", name_key(F.col("stop_name")))


def aliased(s, d):
    """Stops that a provider numbers its own way, found again by name on the same run; the first call wins."""
    e = named_events(s, d)
    seen = e.select("run_id", "stop_sequence", F.when(F.col("run_id") % 4 != 0, F.col("stop_id")).otherwise(F.concat(F.lit("X"), "stop_id")).alias("provider_id"), "key")
    known = e.select("run_id", F.col("stop_id").alias("provider_id"), F.col("stop_id").alias("known")).distinct()
    named = e.groupBy("run_id", "key").agg(F.min_by("stop_id", "stop_sequence").alias("named"))
    return seen.join(known, ["run_id", "provider_id"], "left").join(named, ["run_id", "key"], "left").select("run_id", "stop_sequence", "provider_id", F.coalesce("known", "named").alias("stop_id"))


def canonical(s, d):
    k = F.col("s_suppkey")
    raw = F.when(k % 4 == 0, b.sid("s_suppkey")).when(k % 4 < 3, F.concat(F.lit("P"), k.cast("string")))
    places = b.table(s, d, "supplier").select(k.alias("place_id"), raw.alias("raw_id"), F.when(k % 4 == 1, F.upper("s_name")).otherwise(F.concat(F.lit("Place "), k.cast("string"))).alias("name"))
    places = places.withColumn("name_key", name_key(F.col("name")))
    return sv.canonical_key(places, b.stops(s, d).select("stop_id", name_key(F.col("stop_name")).alias("name_key")))


def nearest(s, d):
    k = F.col("p_partkey")
    places = b.table(s, d, "part").select(k.alias("place_id"), (F.lit(45.003) + (k % 97) / F.lit(100.0)).alias("lat"), (F.lit(8.507) + (k % 193) / F.lit(100.0)).alias("lon"))
    return sv.nearest_within(places, b.stops(s, d), 5.0)


def scope_traversals(s, d):
    """Traversals of a run's own segments by others in the 30 days before it starts."""
    t = traversals(s, d)
    mine = t.select("segment_id", "run_id").join(b.runs(s, d).select("run_id", F.col("sched_dep_epoch").alias("as_of")), "run_id")
    theirs = t.select("segment_id", F.col("run_id").alias("t_run"), "entered_at", "delay_delta_sec")
    return jn.range_join(mine, theirs, ["segment_id"], "as_of", "entered_at", -30 * DAY, 0).where("t_run <> run_id")


def event_overlap(s, d):
    """Calendar events in force when a run starts: those of the whole network and those at a stop of its route."""
    k = F.col("s_suppkey")
    start = F.lit(694_224_000_000) + (k * 37 % 2400) * DAY
    ev = b.table(s, d, "supplier").select(k.alias("event_id"), start.alias("start"), (start + (1 + k % 5) * DAY).alias("stop"), F.when(k % 10 == 0, F.array(F.lit("*"))).otherwise(F.array(b.sid("s_suppkey"))).alias("places"))
    days = F.explode(F.sequence(F.floor(F.col("start") / DAY), F.floor((F.col("stop") - 1) / DAY)))
    ev = ev.withColumn("place", F.explode("places")).withColumn("day", days).drop("places")
    r = b.stop_events(s, d).groupBy("run_id").agg(F.min("sched_dep_epoch").alias("at"), F.array_distinct(F.concat(F.array(F.lit("*")), F.collect_set("stop_id"))).alias("places"))
    r = r.select("run_id", "at", F.explode("places").alias("place"), F.floor(F.col("at") / DAY).alias("day"))
    hit = r.join(ev, ["place", "day"]).where((F.col("start") <= F.col("at")) & (F.col("at") < F.col("stop")))
    return hit.select("run_id", "event_id").distinct()


def live_board(s, d):
    """The freshest delay of each source within a run's last three frames, beside the timetable."""
    w = Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("id"))
    frames = b.observations(s, d).withColumn("k", F.row_number().over(w)).where("k <= 3")
    first = frames.groupBy("run_id", "source").agg(F.min_by("delay_seconds", "k").alias("delay_seconds"))
    return b.runs(s, d).select("run_id", "sched_dep_epoch").join(first, "run_id", "left").select("run_id", "source", (F.col("sched_dep_epoch") + F.col("delay_seconds") * 1000).alias("eta"))


def departure_board(s, d, day="1995-03-15", following="1995-03-16"):
    """Departures of two service days with the newest state of their runs."""
    r = b.runs(s, d).where(F.col("service_date").isin(day, following)).select("run_id", "service_date", "train_number", "stop_count")
    e = b.stop_events(s, d).join(r, "run_id").where("stop_sequence < stop_count")
    state = b.observations(s, d).groupBy("run_id").agg(F.max_by("delay_seconds", F.struct("ts", "id")).alias("delay_seconds"))
    return e.join(state, "run_id", "left").select("service_date", "run_id", "train_number", "stop_id", "stop_sequence", "sched_dep_epoch", "platform_actual", "delay_seconds")


def table_counts(s, d):
    parts = [("stop_events", b.stop_events(s, d), "run_id"), ("observations", b.observations(s, d), "source"), ("stops", b.stops(s, d), "stop_id")]
    rows = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct(key).alias("distinct_keys")) for name, df, key in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def upstream_queue(s, d):
    """Worst departure delay and number of late ones at a stop in the 45 minutes before each call."""
    e = b.stop_events(s, d)
    mine = e.select("stop_id", "run_id", "stop_sequence", "sched_arr_epoch")
    theirs = e.select("stop_id", F.col("run_id").alias("t_run"), F.col("sched_dep_epoch").alias("t_dep"), F.col("dep_delay_sec").alias("t_delay"))
    hit = jn.range_join(mine, theirs, ["stop_id"], "sched_arr_epoch", "t_dep", -45 * MINUTE, 0).where("t_run <> run_id")
    g = hit.groupBy("run_id", "stop_sequence").agg(F.max("t_delay").alias("worst"), F.count_if(F.col("t_delay") >= 300).alias("late"))
    return mine.select("run_id", "stop_sequence").join(g, ["run_id", "stop_sequence"], "left")


def rebuilt_locations(s, d):
    """Reported locations counted by id, then merged by the slug of their names."""
    by_id = b.observations(s, d).groupBy("location_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.count("*").alias("c"))
    named = by_id.join(b.stops(s, d).select(F.col("stop_id").alias("location_id"), F.expr("substring(stop_name, 1, length(stop_name) - 1)").alias("name")), "location_id", "left")
    return named.groupBy(slug(F.col("name")).alias("slug")).agg(F.min("a").alias("first_seen"), F.max("z").alias("last_seen"), F.sum("c").alias("n"), F.count("location_id").alias("ids"))


def risk_replay(s, d):
    p = b.scored(s, d)
    fired = ((F.col("our_p50") - F.col("sched_arr_epoch")) >= 120_000) & ((F.col("our_p90") - F.col("our_p10")) <= 480_000)
    backed = F.coalesce(F.col("operator_eta_epoch") - F.col("sched_arr_epoch") >= 60_000, F.lit(False))
    late = F.col("schedule_error_sec") >= 120
    return p.groupBy("model_version").agg(F.count_if(fired).alias("fired"), F.count_if(fired & backed).alias("corroborated"), F.count_if(late).alias("late"), F.count_if(fired & late).alias("caught"))


def change_rate(s, d):
    """Observations and delay reports of each source in the hour before ``NOW``."""
    o = b.observations(s, d).where(F.col("ts").between(NOW - 3_600_000 + 1, NOW))
    return o.groupBy("source").agg(F.count("*").alias("n"), F.count("delay_seconds").alias("delays"))


def source_histogram(s, d):
    return b.observations(s, d).rollup("source").agg(F.count("*").alias("n"), F.grouping("source").alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("source")).alias("source"), "n")


def boardable_run():
    """Whether a run can be boarded at noon of its day: its state, departure and delay follow from its number."""
    status = F.get(F.array(*map(F.lit, ("running", "arrived", "cancelled", "scheduled"))), (F.col("run_id") % 4).cast("int"))
    noon = F.floor(F.col("sched_arr_epoch") / DAY) * DAY + DAY // 2
    return sv.boardable(status, F.when(F.col("run_id") % 5 == 0, F.col("generated_at")), F.col("generated_at"), F.col("run_id") % 7 * 60, noon)


def ranked_journeys(s, d):
    """Trains to a destination on a day, ranked."""
    p = b.predictions(s, d).where("model_version = 'heuristic-v1'")
    risk = F.least(F.lit(300), F.floor(0.2 * (F.col("our_p90") - F.col("our_p50")) / 1000 + 0.5)).cast("long")
    options = p.select("stop_id", F.floor(F.col("sched_arr_epoch") / DAY).alias("day"), "run_id", F.coalesce("operator_eta_epoch", "our_p50").alias("expected"), risk.alias("risk_sec"), F.col("generated_at").alias("dep"), boardable_run().alias("boardable"))
    return sv.rank_journeys(options, ["stop_id", "day"]).select("stop_id", "day", "run_id", "rank", "recommended")


def connection_options(s, d):
    """The three earliest changes from each arriving train and the probability of each."""
    w = Window.partitionBy("stop_id", "a_run").orderBy("slack_sec", "b_run")
    top = connection_pairs(s, d).groupBy("stop_id", "a_run", "b_run").agg(F.min("slack_sec").alias("slack_sec")).withColumn("k", F.row_number().over(w)).where("k <= 3")
    return top.select("stop_id", "a_run", "b_run", "slack_sec", F.round(sv.made_probability(F.col("slack_sec"), 120, 240), 6).alias("p"))


def station_search(s, d):
    used = b.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("popularity"))
    scored = b.table(s, d, "part").select("p_partkey", "p_name", sv.search_score(F.col("p_name"), QUERY).alias("score")).where("score IS NOT NULL")
    return scored.join(used, "p_partkey", "left").select("p_partkey", "score", F.coalesce("popularity", F.lit(0)).alias("popularity")).orderBy(F.desc("score"), F.desc("popularity"), "p_partkey").limit(10)


def frequent_stations(s, d):
    g = b.runs(s, d).groupBy("train_number", "destination_stop_id").agg(F.count("*").alias("uses"), F.max("sched_dep_epoch").alias("last_used"))
    w = Window.partitionBy("train_number").orderBy(F.desc("uses"), F.desc("last_used"), "destination_stop_id")
    return g.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


def boarding_delay(s, d):
    """Delay shown at boarding: what was reported up to 30 minutes ago, else our own estimate."""
    o = b.observations(s, d).where(F.col("ts") <= NOW)
    newest = o.where("delay_seconds IS NOT NULL").groupBy("run_id").agg(F.max("ts").alias("at"), F.max_by("delay_seconds", F.struct("ts", "id")).alias("seen"))
    own = b.predictions(s, d).where("model_version = 'heuristic-v1'").select("run_id", F.floor((F.col("our_p50") - F.col("sched_arr_epoch")) / 1000).alias("own"))
    fresh = F.col("at") >= NOW - 30 * MINUTE
    return own.join(newest, "run_id", "left").select("run_id", F.when(fresh, F.col("seen")).otherwise(F.col("own")).cast("long").alias("delay_sec"), F.coalesce(fresh, F.lit(False)).alias("is_live"))


def health(s, d):
    newest = F.max_by(F.struct("id", "ts", "delay_seconds"), F.struct("ts", "id"))
    return b.observations(s, d).groupBy("source").agg(F.count("*").alias("n"), newest.alias("x")).select("source", "n", F.col("x.id").alias("last_id"), F.col("x.ts").alias("last_ts"), F.col("x.delay_seconds").alias("last_delay"))


QUERIES = {
    "j19_name_alias": aliased,
    "j20_location_match": lambda s, d: canonical(s, d).select("place_id", F.coalesce("by_id", "by_name").alias("stop_id")),
    "j21_canonical_key": lambda s, d: canonical(s, d).select("place_id", F.coalesce("by_id", "by_name", "raw_id", F.concat(F.lit("n:"), slug(F.col("name")))).alias("key")),
    "j23_nearest_within": nearest,
    "j25_scope_traversals": lambda s, d: scope_traversals(s, d).groupBy("run_id").agg(F.count("*").alias("n"), upper_median(F.col("delay_delta_sec")).alias("median_delta")),
    "j28_event_overlap": event_overlap,
    "j30_live_board": live_board,
    "j33_departure_board": departure_board,
    "a10_table_counts": table_counts,
    "a11_upstream_queue": upstream_queue,
    "a13_location_rebuild": rebuilt_locations,
    "a17_risk_replay": risk_replay,
    "a18_evidence": lambda s, d: sv.evidence(traversals(s, d), "from_stop_id"),
    "a21_change_rate": change_rate,
    "a26_source_histogram": source_histogram,
    "t04_journey_ranking": ranked_journeys,
    "f09_connection_options": connection_options,
    "f10_notices": lambda s, d: sv.notices(b.predictions(s, d), 120_000, 10 * MINUTE),
    "f11_station_search": station_search,
    "f12_frequent_stations": frequent_stations,
    "f13_boarding_delay": boarding_delay,
    "f14_health": health,
}

KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed')"
CANON = f"""WITH pl AS (SELECT s_suppkey AS place_id, CASE WHEN s_suppkey % 4 = 0 THEN 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') WHEN s_suppkey % 4 < 3 THEN 'P' || s_suppkey END AS raw_id,
  CASE WHEN s_suppkey % 4 = 1 THEN upper(s_name) ELSE 'Place ' || s_suppkey END AS name FROM supplier),
c AS (SELECT place_id, raw_id, name, (SELECT min(stop_id) FROM stops WHERE stop_id = raw_id) AS by_id, (SELECT min(stop_id) FROM stops WHERE {KEY.format('stop_name')} = {KEY.format('name')}) AS by_name FROM pl)"""
SCOPE = f"WITH {SEG}, sc AS (SELECT m.run_id, t.delay_delta_sec FROM seg m JOIN runs r ON r.run_id = m.run_id JOIN seg t ON t.segment_id = m.segment_id AND t.run_id <> m.run_id AND t.entered_at - r.sched_dep_epoch BETWEEN {-30 * DAY} AND 0)"
CDF = "0.5 * (1 + sign(x) * (1 - (0.254829592 * t - 0.284496736 * t * t + 1.421413741 * t * t * t - 1.453152027 * t * t * t * t + 1.061405429 * t * t * t * t * t) * exp(-z * z)))"
RISK = "CAST(least(300, floor(CAST(0.2 AS DOUBLE) * (our_p90 - our_p50) / 1000 + 0.5)) AS BIGINT)"
FIRED = "our_p50 - sched_arr_epoch >= 120000 AND our_p90 - our_p10 <= 480000"


def _points(token: str) -> str:
    initials = "array_to_string(list_transform(regexp_split_to_array(lower(p_name), '\\s+'), lambda w: w[1:1]), '')"
    return f"(CASE WHEN lower(p_name) LIKE '{token}%' OR lower(p_name) LIKE '% {token}%' THEN 10 WHEN {initials} LIKE '{token}%' THEN 8 WHEN lower(p_name) LIKE '%{token}%' THEN 4 END + {len(token)})"


ORACLE_SQL = {
    "j19_name_alias": oracle("se stops", f"""WITH e AS (SELECT se.run_id, stop_sequence, stop_id, CASE WHEN run_id % 4 <> 0 THEN stop_id ELSE 'X' || stop_id END AS provider_id, {KEY.format('stop_name')} AS key FROM se JOIN stops USING (stop_id)),
n AS (SELECT run_id, key, arg_min(stop_id, stop_sequence) AS named FROM e GROUP BY ALL)
SELECT e.run_id, stop_sequence, provider_id, CASE WHEN e.run_id % 4 <> 0 THEN stop_id ELSE named END AS stop_id FROM e JOIN n ON n.run_id = e.run_id AND n.key = e.key"""),
    "j20_location_match": oracle("stops", f"{CANON} SELECT place_id, coalesce(by_id, by_name) AS stop_id FROM c"),
    "j21_canonical_key": oracle("stops", f"{CANON} SELECT place_id, coalesce(by_id, by_name, raw_id, 'n:' || {SLUG.format('name')}) AS key FROM c"),
    "j23_nearest_within": oracle("stops", """WITH p AS (SELECT p_partkey AS place_id, CAST(45.003 AS DOUBLE) + (p_partkey % 97) / CAST(100.0 AS DOUBLE) AS lat, CAST(8.507 AS DOUBLE) + (p_partkey % 193) / CAST(100.0 AS DOUBLE) AS lon FROM part),
j AS (SELECT place_id, stop_id, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(stop_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(stop_lat)) * pow(sin(radians(stop_lon - lon) / 2), 2))), 6) AS km FROM p, stops)
SELECT place_id, arg_min(stop_id, (km, stop_id)) AS stop_id, min(km) AS km FROM j WHERE km <= 5 GROUP BY place_id"""),
    "j25_scope_traversals": oracle("se ends runs", f"{SCOPE} SELECT run_id, count(*) AS n, {fi('delay_delta_sec', 0.5)} AS median_delta FROM sc GROUP BY run_id"),
    "j28_event_overlap": oracle("se", f"""WITH ev AS (SELECT s_suppkey AS event_id, 694224000000 + (s_suppkey * 37 % 2400) * {DAY} AS a, 694224000000 + (s_suppkey * 37 % 2400 + 1 + s_suppkey % 5) * {DAY} AS z FROM supplier),
r AS (SELECT run_id, min(sched_dep_epoch) AS t0, list(stop_id) AS route FROM se GROUP BY run_id)
SELECT run_id, event_id FROM r JOIN ev ON a <= t0 AND t0 < z AND (event_id % 10 = 0 OR list_contains(route, 'S' || lpad(CAST(event_id AS VARCHAR), 5, '0')))"""),
    "j30_live_board": oracle("se ends runs obs", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, id DESC) AS k FROM obs QUALIFY k <= 3), g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY run_id, source ORDER BY k) = 1)
SELECT r.run_id, source, sched_dep_epoch + CAST(delay_seconds AS BIGINT) * 1000 AS eta FROM runs r LEFT JOIN g ON g.run_id = r.run_id"""),
    "j33_departure_board": oracle("se ends runs obs", """WITH st AS (SELECT run_id, arg_max_null(delay_seconds, ts * 1000000 + id) AS delay_seconds FROM obs GROUP BY run_id)
SELECT service_date, se.run_id, train_number, stop_id, stop_sequence, se.sched_dep_epoch, platform_actual, delay_seconds FROM se JOIN runs r ON r.run_id = se.run_id LEFT JOIN st ON st.run_id = se.run_id WHERE service_date IN ('1995-03-15', '1995-03-16') AND stop_sequence < stop_count"""),
    "a10_table_counts": oracle("se obs stops", "SELECT 'stop_events' AS name, count(*) AS n, count(DISTINCT run_id) AS distinct_keys FROM se UNION ALL SELECT 'observations', count(*), count(DISTINCT source) FROM obs UNION ALL SELECT 'stops', count(*), count(DISTINCT stop_id) FROM stops"),
    "a11_upstream_queue": oracle("se", "SELECT a.run_id, a.stop_sequence, max(t.dep_delay_sec) AS worst, CASE WHEN count(t.run_id) > 0 THEN count(*) FILTER (t.dep_delay_sec >= 300) END AS late FROM se a LEFT JOIN se t ON t.stop_id = a.stop_id AND t.run_id <> a.run_id AND t.sched_dep_epoch - a.sched_arr_epoch BETWEEN -2700000 AND 0 GROUP BY ALL"),
    "a13_location_rebuild": oracle("obs stops", f"SELECT {SLUG.format('substr(stop_name, 1, length(stop_name) - 1)')} AS slug, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, count(DISTINCT location_id) AS ids FROM obs LEFT JOIN stops ON stop_id = location_id GROUP BY 1"),
    "a17_risk_replay": oracle("se ends pred scored", f"SELECT model_version, count(*) FILTER ({FIRED}) AS fired, count(*) FILTER ({FIRED} AND operator_eta_epoch - sched_arr_epoch >= 60000) AS corroborated, count(*) FILTER (schedule_error_sec >= 120) AS late, count(*) FILTER ({FIRED} AND schedule_error_sec >= 120) AS caught FROM scored GROUP BY 1"),
    "a18_evidence": oracle("se", f"""WITH {SEG}, m AS (SELECT from_stop_id, segment_id, round(quantile_cont(delay_delta_sec, 0.5), 6) AS m FROM seg GROUP BY ALL), w AS (SELECT from_stop_id, segment_id AS worst_segment FROM m WHERE m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY from_stop_id ORDER BY m DESC, segment_id) = 1),
g AS (SELECT from_stop_id, count(DISTINCT run_id) AS trains, count(*) FILTER (delay_delta_sec >= 600) AS severe, round(quantile_cont(delay_delta_sec, 0.5), 6) AS median_delta, max(delay_delta_sec) AS max_delta FROM seg GROUP BY 1) SELECT * FROM g LEFT JOIN w USING (from_stop_id)"""),
    "a21_change_rate": oracle("obs", f"SELECT source, count(*) AS n, count(delay_seconds) AS delays FROM obs WHERE ts > {NOW - 3600000} AND ts <= {NOW} GROUP BY 1"),
    "a26_source_histogram": oracle("obs", "SELECT coalesce(source, 'total') AS source, count(*) AS n FROM obs GROUP BY ROLLUP (source)"),
    "t04_journey_ranking": oracle("se ends pred", f"""WITH o AS (SELECT stop_id, sched_arr_epoch // {DAY} AS day, run_id, generated_at, row_number() OVER (PARTITION BY stop_id, sched_arr_epoch // {DAY} ORDER BY coalesce(operator_eta_epoch, our_p50) + {RISK} * 1000, generated_at, run_id) AS rank FROM pred WHERE model_version = 'heuristic-v1')
SELECT stop_id, day, run_id, CAST(rank AS INT) AS rank, coalesce(rank = min(rank) FILTER (run_id % 4 IN (0, 3) AND run_id % 5 <> 0 AND generated_at + (run_id % 7) * 60000 >= day * 86400000 + 43170000) OVER (PARTITION BY stop_id, day), false) AS recommended FROM o"""),
    "f09_connection_options": oracle("se", f"""WITH c AS ({CONNECTIONS}), g0 AS (SELECT stop_id, a_run, b_run, min(slack_sec) AS slack_sec FROM c GROUP BY ALL), g AS (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY stop_id, a_run ORDER BY slack_sec, b_run) <= 3),
x AS (SELECT *, (slack_sec - 120) / CAST(240 AS DOUBLE) AS x FROM g), zt AS (SELECT *, abs(x) / sqrt(2.0) AS z, 1 / (1 + 0.3275911 * abs(x) / sqrt(2.0)) AS t FROM x)
SELECT stop_id, a_run, b_run, slack_sec, round(greatest(0.001, least(0.999, {CDF})), 6) AS p FROM zt"""),
    "f10_notices": oracle("se ends pred", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY generated_at, prediction_id) AS k FROM pred),
f AS (SELECT run_id, k, prediction_id, generated_at, our_p50 AS told, generated_at AS told_at, true AS sent FROM k WHERE k = 1 UNION ALL
  SELECT k.run_id, k.k, k.prediction_id, k.generated_at, CASE WHEN ok THEN k.our_p50 ELSE told END, CASE WHEN ok THEN k.generated_at ELSE told_at END, ok
  FROM f JOIN (SELECT * FROM k) k ON k.run_id = f.run_id AND k.k = f.k + 1, LATERAL (SELECT abs(k.our_p50 - told) > 120000 AND k.generated_at - told_at >= 600000 AS ok) x)
SELECT run_id, prediction_id, generated_at FROM f WHERE sent""").replace("WITH ", "WITH RECURSIVE ", 1),
    "f11_station_search": f"WITH u AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT p_partkey, CASE WHEN lower(p_name) LIKE '{QUERY}%' THEN 6 ELSE 0 END + {' + '.join(map(_points, QUERY.split()))} AS score FROM part) SELECT p_partkey, score, coalesce(n, 0) AS popularity FROM c LEFT JOIN u ON l_partkey = p_partkey WHERE score IS NOT NULL ORDER BY score DESC, popularity DESC, p_partkey LIMIT 10",
    "f12_frequent_stations": oracle("se ends runs", "WITH g AS (SELECT train_number, destination_stop_id, count(*) AS uses, max(sched_dep_epoch) AS last_used FROM runs GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY train_number ORDER BY uses DESC, last_used DESC, destination_stop_id) AS INT) AS rank FROM g QUALIFY rank <= 5"),
    "f13_boarding_delay": oracle("se ends pred obs", f"""WITH n AS (SELECT run_id, max(ts) AS t0, arg_max(delay_seconds, ts * 1000000 + id) AS seen FROM obs WHERE delay_seconds IS NOT NULL AND ts <= {NOW} GROUP BY 1)
SELECT p.run_id, CAST(CASE WHEN t0 >= {NOW - 1800000} THEN seen ELSE (our_p50 - sched_arr_epoch) // 1000 END AS BIGINT) AS delay_sec, coalesce(t0 >= {NOW - 1800000}, false) AS is_live FROM pred p LEFT JOIN n ON n.run_id = p.run_id WHERE model_version = 'heuristic-v1'"""),
    "f14_health": oracle("obs", "SELECT source, count(*) AS n, arg_max(id, ts * 1000000 + id) AS last_id, max(ts) AS last_ts, arg_max_null(delay_seconds, ts * 1000000 + id) AS last_delay FROM obs GROUP BY 1"),
}
