"""Reliability views and trust between sources over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from viaduct.functions.semantics import rome_ymd
from viaduct.operators import fusion as fu
from viaduct.operators import reliability as rl
from viaduct.operators import segments as sg
from viaduct.operators import trust as tr
from viaduct.plans import risk as r
from viaduct.plans.segments import SEG
from viaduct.sources import bindings as b
from viaduct.sources.bindings import oracle

#: Two days of the folded month are too old.
AS_OF = 32 * rl.DAY


def runs(s, d):
    e = b.run_ends(r.events(s, d)).select("run_id", "destination_stop_id", rome_ymd(F.col("sched_dep_epoch")).alias("service_date"))
    o = b.table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 40).cast("string").alias("train_number"), F.when(F.col("o_custkey") % 11 != 0, F.concat(F.lit("R"), (F.col("o_custkey") % 6).cast("string"))).alias("route_id"))
    return e.join(o, "run_id")


def stations(s, d):
    """Names of five of the ten stations."""
    return b.table(s, d, "region").select(F.concat(F.lit("Z"), F.col("r_regionkey").cast("string")).alias("stop_id"), F.col("r_name").alias("stop_name"))


def trains(s, d):
    e = r.events(s, d)
    return rl.train_reliability(e, runs(s, d), sg.traversals(e), stations(s, d), AS_OF)


def said(s, d):
    """(field, id, candidates): what the sources say of delays, positions and arrivals, some of them in trouble."""
    o = fu.latest_by_source(b.observations(s, d).withColumn("run_id", F.col("run_id") % 500)).join(b.observations(s, d).select("id", "observed_at"), "id")
    state = F.when(F.col("id") % 5 == 0, "DEGRADED").when(F.col("id") % 7 == 0, "PAUSED").when(F.col("id") % 2 == 0, "HEALTHY")
    seen = F.when(F.col("id") % 13 != 0, F.coalesce("observed_at", "ts"))
    delay = F.when(F.col("delay_seconds").isNotNull(), tr.candidate(F.col("source"), F.col("delay_seconds").cast("double") / 4, seen, state))
    by_run = o.groupBy("run_id").agg(F.collect_list(delay).alias("delays"), F.collect_list(tr.candidate(F.col("source"), F.col("location_id"), seen, state)).alias("places"))
    p, run = b.predictions(s, d), F.col("run_id")
    late = lambda c: (F.col(c) - F.col("sched_arr_epoch")) / 1000.0
    heard = [
        F.when(F.col("operator_eta_epoch").isNotNull(), tr.candidate(F.lit("gtfsrt"), late("operator_eta_epoch"), F.col("generated_at") - run % 90 * 1000, F.when(run % 3 == 0, "DEGRADED"))),
        F.when(run % 4 != 0, tr.candidate(F.lit("mia"), late("operator_eta_epoch") + 30, F.col("generated_at") - run % 70 * 1000)), tr.candidate(F.lit("ours"), late("our_p50"), F.col("generated_at"), None, run % 100 / 100.0),
    ]
    etas = p.select("prediction_id", F.filter(F.array_compact(F.array(*heard)), lambda c: c["value"].isNotNull()).alias("etas"))
    return by_run, etas


def trust(s, d):
    by_run, etas = said(s, d)
    by_run = tr.resolved(tr.resolved(by_run, "delays", "current_delay", "delay", 60), "places", "position", "place")
    etas = tr.resolved(etas, "etas", "future_eta", "eta")
    part = lambda df, key, field, c: df.where(F.col(c).isNotNull()).select(F.lit(field).alias("field"), F.col(key).cast("long").alias("id"), f"{c}.source", f"{c}.trust", F.col(f"{c}.value").cast("string").alias("value"), f"{c}.observed_at", f"{c}.runner_up", f"{c}.disagreement", f"{c}.reason")
    return part(by_run, "run_id", "current_delay", "delay").unionByName(part(by_run, "run_id", "position", "place")).unionByName(part(etas, "prediction_id", "future_eta", "eta"))


QUERIES = {
    "a07_reliability": trains,
    "a08_stop_reliability": lambda s, d: rl.stop_reliability(r.events(s, d), runs(s, d), AS_OF),
    "f01_trust": trust,
}

RUNS = """rn AS (SELECT run_id, arg_max_null(stop_id, stop_sequence) AS dest, CAST(o_custkey % 40 AS VARCHAR) AS train_number, CASE WHEN o_custkey % 11 <> 0 THEN 'R' || (o_custkey % 6) END AS route_id,
  strftime(timezone('Europe/Rome', make_timestamptz(min(sched_dep_epoch) * 1000)), '%Y-%m-%d') AS service_date FROM se JOIN orders ON o_orderkey = run_id GROUP BY run_id, o_custkey),
rc AS (SELECT * FROM rn WHERE service_date >= '1970-01-03')"""
PCT = "CASE WHEN {1} >= 20 THEN floor({0} / ({1}) * 1000 + 0.5) / 10 END"
AT = "list_sort(list({0}))[1 + least(count(*) - 1, CAST(floor(count(*) * {1}) AS BIGINT))]"
TRAINS = f"""en AS (SELECT train_number, arr_delay_sec AS late FROM se JOIN rc USING (run_id) WHERE stop_id = dest AND arr_delay_sec IS NOT NULL),
cn AS (SELECT train_number, count(*) AS n, count(*) FILTER (late < 180) AS a, count(*) FILTER (late >= 300) AS b, count(*) FILTER (late >= 600) AS c, {AT.format("late", 0.5)} AS median_sec, {AT.format("late", 0.9)} AS p90_sec FROM en GROUP BY 1),
gn AS (SELECT train_number, count(*) AS gone FROM se JOIN rc USING (run_id) WHERE cancelled = 1 GROUP BY 1),
md AS (SELECT train_number, segment_id, from_stop_id, to_stop_id, count(*) AS n, {AT.format("delay_delta_sec", 0.5)} AS m FROM seg JOIN rn USING (run_id) WHERE delay_delta_sec IS NOT NULL AND entered_at >= {AS_OF - 30 * rl.DAY} GROUP BY ALL HAVING count(*) >= 20),
nm AS (SELECT 'Z' || r_regionkey AS stop_id, r_name FROM region),
ms AS (SELECT train_number, segment_id, coalesce(f.r_name, from_stop_id) AS f, coalesce(t.r_name, to_stop_id) AS t, n, m FROM md LEFT JOIN nm f ON f.stop_id = from_stop_id LEFT JOIN nm t ON t.stop_id = to_stop_id),
wo AS (SELECT * FROM ms WHERE m > 30 QUALIFY row_number() OVER (PARTITION BY train_number ORDER BY m DESC, segment_id) = 1),
re AS (SELECT * FROM ms WHERE m < -15 QUALIFY row_number() OVER (PARTITION BY train_number ORDER BY m, segment_id) = 1),
al AS (SELECT train_number FROM cn UNION SELECT train_number FROM gn UNION SELECT train_number FROM ms)
SELECT train_number, coalesce(cn.n, 0) AS completed, {", ".join(f"{PCT.format(x, 'cn.n')} AS {y}" for x, y in (("a", "on_time_pct"), ("b", "late5_pct"), ("c", "late10_pct")))}, {PCT.format("coalesce(gone, 0)", "coalesce(cn.n, 0) + coalesce(gone, 0)")} AS cancelled_pct, median_sec, p90_sec,
  wo.f AS worst_from, wo.t AS worst_to, wo.m AS worst_sec, wo.n AS worst_n, re.f AS recovery_from, re.t AS recovery_to, re.m AS recovery_sec, re.n AS recovery_n
FROM al LEFT JOIN cn USING (train_number) LEFT JOIN gn USING (train_number) LEFT JOIN wo USING (train_number) LEFT JOIN re USING (train_number)"""
STOPS = f"""c AS (SELECT stop_id, route_id, arr_delay_sec AS late FROM se JOIN rc USING (run_id) WHERE arr_delay_sec IS NOT NULL AND route_id IS NOT NULL)
SELECT stop_id, route_id, count(*) AS n, {PCT.format("count(*) FILTER (late < 180)", "count(*)")} AS on_time_pct, CASE WHEN count(*) >= 20 THEN {AT.format("late", 0.5)} END AS median_sec, CASE WHEN count(*) >= 20 THEN {AT.format("late", 0.9)} END AS p90_sec FROM c GROUP BY ALL HAVING count(*) >= 10"""
#: Candidates as rows, ranked by window functions.
TRUST = """lt AS (SELECT id, run_id % 500 AS run_id, source, ts, delay_seconds, location_id, observed_at, CASE WHEN id % 13 <> 0 THEN coalesce(observed_at, ts) END AS seen, CASE WHEN id % 5 = 0 THEN 'DEGRADED' WHEN id % 7 = 0 THEN 'PAUSED' WHEN id % 2 = 0 THEN 'HEALTHY' END AS state FROM obs QUALIFY row_number() OVER (PARTITION BY run_id % 500, source ORDER BY ts DESC, id DESC) = 1),
pd AS (SELECT prediction_id, run_id, generated_at, (operator_eta_epoch - sched_arr_epoch) / 1000 AS op, (our_p50 - sched_arr_epoch) / 1000 AS ours FROM pred),
ca AS (SELECT 'current_delay' AS field, run_id AS id, source, delay_seconds / 4 AS v, NULL AS txt, seen, state, CASE source WHEN 'viaggiatreno' THEN 3 WHEN 'mia' THEN 2 ELSE 1 END AS base FROM lt WHERE delay_seconds IS NOT NULL
  UNION ALL SELECT 'position', run_id, source, NULL, location_id, seen, state, 1 FROM lt
  UNION ALL SELECT 'future_eta', prediction_id, 'gtfsrt', op, NULL, generated_at - run_id % 90 * 1000, CASE WHEN run_id % 3 = 0 THEN 'DEGRADED' END, 3 FROM pd WHERE op IS NOT NULL
  UNION ALL SELECT 'future_eta', prediction_id, 'mia', op + 30, NULL, generated_at - run_id % 70 * 1000, NULL, 2 FROM pd WHERE op IS NOT NULL AND run_id % 4 <> 0
  UNION ALL SELECT 'future_eta', prediction_id, 'ours', ours, NULL, generated_at, NULL, CASE WHEN run_id % 100 >= 75 THEN 3 WHEN run_id % 100 >= 50 THEN 2 ELSE 1 END FROM pd),
le AS (SELECT *, greatest(1, base - CASE state WHEN 'PAUSED' THEN 2 WHEN 'DEGRADED' THEN 1 ELSE 0 END) AS level FROM ca),
rk AS (SELECT *, ['LOW', 'MEDIUM', 'HIGH'][level] AS lv, row_number() OVER (PARTITION BY field, id ORDER BY CASE WHEN field = 'position' THEN 0 ELSE -level END, seen DESC NULLS LAST, -level, source) AS k, row_number() OVER (PARTITION BY field, id ORDER BY seen DESC NULLS LAST, source) AS kf FROM le),
dg AS (SELECT field, id, string_agg(source || ' ' || ['LOW', 'MEDIUM', 'HIGH'][base] || '->' || lv || ' (' || state || ')', ', ' ORDER BY source) FILTER (level <> base) AS lost, string_agg(source || '@' || coalesce(CAST(seen AS VARCHAR), '?'), ' vs ' ORDER BY k) AS ages FROM rk GROUP BY ALL),
pr AS (SELECT a.field, a.id, a.source AS s1, a.v AS v1, a.txt AS t1, a.seen AS e1, a.level AS l1, a.lv AS n1, z.source AS s2, z.v AS v2, z.seen AS e2, z.level AS l2, z.lv AS n2, f.source AS sf, f.v AS vf, f.seen AS ef, f.lv AS nf, a.field = 'current_delay' AND f.source <> a.source AND coalesce(f.seen > a.seen AND abs(f.v - a.v) <= 60, false) AS swap
  FROM rk a LEFT JOIN rk z ON z.field = a.field AND z.id = a.id AND z.k = 2 JOIN rk f ON f.field = a.field AND f.id = a.id AND f.kf = 1 WHERE a.k = 1),
ch AS (SELECT *, CASE WHEN swap THEN sf ELSE s1 END AS source, CASE WHEN swap THEN nf ELSE n1 END AS tl, CASE WHEN swap THEN vf ELSE v1 END AS v, CASE WHEN swap THEN ef ELSE e1 END AS observed_at, CASE WHEN swap THEN s1 ELSE s2 END AS runner_up, CAST(floor(abs(CASE WHEN swap THEN vf - v1 ELSE v1 - v2 END) + 0.5) AS BIGINT) AS disagreement FROM pr)
SELECT field, CAST(id AS BIGINT) AS id, source, CASE WHEN field <> 'position' THEN tl END AS trust, CASE WHEN field = 'position' THEN t1 ELSE CAST(CAST(v AS DOUBLE) AS VARCHAR) END AS value, observed_at, runner_up, disagreement,
  CASE WHEN field = 'position' THEN source || ' wins: freshest infrastructure observation (' || ages || ')' WHEN swap THEN sf || ' fresher and agrees with ' || s1 || ' within 60s (delta ' || CAST(floor(abs(vf - v1) + 0.5) AS BIGINT) || 's); freshness decides (' || field || ')'
    WHEN s2 IS NULL THEN s1 || ': sole candidate (' || field || ', trust ' || n1 || ')' WHEN l1 > l2 THEN s1 || ':' || n1 || ' beats ' || s2 || ':' || n2 || ' (' || field || ' trust table)'
    ELSE s1 || ' and ' || s2 || ' equal trust ' || n1 || CASE WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN ', fresher by ' || CAST(floor((e1 - e2) / 1000 + 0.5) AS BIGINT) || 's' ELSE '' END || '; fresher wins (' || field || ')' END
  || CASE WHEN disagreement IS NOT NULL THEN '; disagreement ' || disagreement || 's' ELSE '' END || CASE WHEN lost IS NOT NULL THEN '; degraded ' || lost ELSE '' END AS reason
FROM ch JOIN dg USING (field, id)"""

ORACLE_SQL = {
    "a07_reliability": f"WITH {r.FOLD}, {SEG}, {RUNS}, {TRAINS}",
    "a08_stop_reliability": f"WITH {r.FOLD}, {RUNS}, {STOPS}",
    "f01_trust": oracle("se ends obs pred", "WITH " + TRUST),
}
