"""Corridors, notices and expected arrivals as they are served, over the folded month."""

from __future__ import annotations

from pyspark.sql import functions as F

from viaduct.operators import risk as rk
from viaduct.operators import segments as sg
from viaduct.operators import serving as sv
from viaduct.plans import risk as r
from viaduct.plans.reliability import stations
from viaduct.plans.segments import SEG, fi
from viaduct.sources import bindings as b

HOUR = 3_600_000
#: Noon of the twelfth day.
AS_OF = 11 * 24 * HOUR + 12 * HOUR


def legs(s, d):
    """The call before the last of each run and its destination, as known half an hour before the arrival there."""
    e = r.events(s, d)
    ends = b.run_ends(e).select("run_id", F.col("sched_arr_epoch").alias("run_planned"), F.col("stop_count"))
    run = F.col("run_id")
    leg = e.join(ends, "run_id").where("stop_sequence = stop_count").withColumn("now", F.col("run_planned") - 1_800_000)
    first = e.where("stop_sequence = 1").select("run_id", F.when(run % 4 != 0, F.col("dep_delay_sec")).alias("departed"))
    leg = leg.join(first, "run_id").withColumn("actual", F.when(F.col("actual_arr_epoch") - (run % 3) * 1_800_000 <= F.col("now"), F.col("actual_arr_epoch")))
    leg = leg.withColumn("predicted", F.when(run % 3 == 0, F.col("sched_arr_epoch") + run % 7 * 60_000)).withColumn("p50", F.when(run % 5 == 0, F.col("run_planned") + run % 11 * 30_000)).withColumn("p90", F.when(run % 10 != 0, F.col("p50") + run % 40 * 60_000))
    planned = F.col("sched_arr_epoch") - run % 2 * 60_000
    at, live = sv.expected_arrival(planned, F.col("actual"), F.col("predicted"), F.col("p50"), F.col("run_planned"), F.col("departed"))
    return leg.select("run_id", at.alias("expected"), live.alias("live"), sv.risk_penalty(F.col("p50"), F.col("p90")).alias("risk_sec"))


QUERIES = {
    "a05_corridor_health": lambda s, d: sg.corridor_health(r.traversals(s, d), AS_OF),
    "a06_corridor_delta": lambda s, d: sg.corridor_delta(r.traversals(s, d), AS_OF),
    "f07_risk_notice": lambda s, d: rk.served_notices(r.scored(s, d), r.scoped(s, d), r.traversals(s, d), stations(s, d)),
    "f08_expected_arrival": legs,
}

NOTICES = """lo AS (SELECT sc.prediction_id, g.segment_id, g.delay_delta_sec AS x, from_stop_id, to_stop_id FROM (SELECT prediction_id, as_of, unnest(segments) AS segment_id FROM sc) sc JOIN seg g ON g.segment_id = sc.segment_id AND g.entered_at BETWEEN as_of - 1200000 AND as_of AND g.delay_delta_sec > 90),
w AS (SELECT prediction_id, count(*) AS n, arg_min({'f': from_stop_id, 't': to_stop_id}, (-x, segment_id)) AS w FROM lo GROUP BY prediction_id HAVING count(*) >= 2),
nm AS (SELECT 'Z' || r_regionkey AS stop_id, r_name FROM region)
SELECT prediction_id, CAST(own AS BIGINT) AS expected_delay_sec, n AS evidence_trains, coalesce(f.r_name, w.w.f) || ' → ' || coalesce(t.r_name, w.w.t) AS segment_name, n || ' trains are already losing time between ' || coalesce(f.r_name, w.w.f) || ' → ' || coalesce(t.r_name, w.w.t) || '.' AS detail
FROM w JOIN pr USING (prediction_id) LEFT JOIN nm f ON f.stop_id = w.w.f LEFT JOIN nm t ON t.stop_id = w.w.t WHERE own >= 60"""
LEGS = """en AS (SELECT run_id, max(sched_arr_epoch) AS planned, count(*) AS k FROM se GROUP BY run_id),
lg AS (SELECT se.*, planned, planned - 1800000 AS now, CASE WHEN run_id % 5 = 0 THEN planned + run_id % 11 * 30000 END AS p50 FROM se JOIN en USING (run_id) WHERE stop_sequence = k),
fi AS (SELECT run_id, CASE WHEN run_id % 4 <> 0 THEN dep_delay_sec END AS departed FROM se WHERE stop_sequence = 1),
al AS (SELECT lg.*, departed, CASE WHEN actual_arr_epoch - (run_id % 3) * 1800000 <= now THEN actual_arr_epoch END AS actual, CASE WHEN run_id % 3 = 0 THEN sched_arr_epoch + run_id % 7 * 60000 END AS predicted, CASE WHEN run_id % 10 <> 0 THEN p50 + run_id % 40 * 60000 END AS p90, sched_arr_epoch - run_id % 2 * 60000 AS plan FROM lg JOIN fi USING (run_id))
SELECT run_id, coalesce(actual, predicted, plan + p50 - planned, plan + departed * 1000, plan) AS expected, coalesce(actual, predicted, p50, departed) IS NOT NULL AS live, CASE WHEN p90 IS NOT NULL THEN least(300, CAST(floor(CAST(0.2 AS DOUBLE) * (p90 - p50) / 1000 + 0.5) AS BIGINT)) END AS risk_sec FROM al"""

ORACLE_SQL = {
    "a05_corridor_health": r.sql(r.FOLD, SEG, f"g AS (SELECT segment_id, count(*) AS n, {fi('delay_delta_sec', 0.5)} AS median_delta, max(delay_delta_sec) AS worst_delta FROM seg WHERE entered_at BETWEEN {AS_OF - HOUR} AND {AS_OF} AND delay_delta_sec IS NOT NULL GROUP BY segment_id)", "SELECT * FROM g WHERE abs(median_delta) >= 60 OR worst_delta >= 180"),
    "a06_corridor_delta": r.sql(r.FOLD, SEG, f"k AS (SELECT * FROM seg WHERE entered_at BETWEEN {AS_OF - 3 * HOUR} AND {AS_OF} AND delay_delta_sec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY entered_at DESC, run_id DESC) <= 3)", f"SELECT segment_id, {fi('delay_delta_sec', 0.5)} AS corridor_delta, count(*) AS n FROM k GROUP BY segment_id"),
    "f07_risk_notice": f"WITH {r.FOLD}, {r.PREDS}, {r.SCOPE}, {SEG}, {NOTICES}",
    "f08_expected_arrival": f"WITH {r.FOLD}, {LEGS}",
}
