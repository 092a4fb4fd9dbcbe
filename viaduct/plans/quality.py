"""Quality and conflict queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from viaduct.functions.semantics import asof_join, greedy_gap, quantiles_of
from viaduct.operators import quality as q
from viaduct.plans.segments import fi
from viaduct.sources import bindings as b
from viaduct.sources.bindings import oracle
from viaduct.streaming import ingest

SOURCES = ("gtfsrt", "mia", "viaggiatreno")


def obs(s, d):
    return b.observations(s, d).withColumn("seq", F.substring("location_id", 2, 5).cast("int") % 20)


def snapshots(s, d):
    """Observations of few runs, every third of which is fetched again unchanged 20 seconds later."""
    o = obs(s, d).withColumn("run_id", F.col("run_id") % 40).withColumn("name", F.lit(None).cast("string"))
    again = o.where("id % 3 = 0").withColumn("ts", F.col("ts") + 20_000).withColumn("id", F.col("id") + 1_000_000_000_000)
    return o.unionByName(again)


def flagged(s, d):
    known = b.table(s, d, "customer").where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("run_id"))
    return q.observation_flags(obs(s, d), known, b.stops(s, d), SOURCES)


def candidates(s, d):
    return q.conflict_candidates(b.observations(s, d), SOURCES)


def emitted(s, d):
    return greedy_gap(candidates(s, d), "run_id", "ts", 300_000)


def estimates(s, d):
    """An estimate and an operator's time with each observation, either of which may be unknown."""
    o = b.observations(s, d)
    eta = F.when(F.col("id") % 17 != 0, F.floor(F.col("ts") / 60000) * 60000 + (F.col("id") % 3) * 20000)
    return o.select("run_id", "ts", "id", (F.col("ts") + F.col("delay_seconds") * 1000).alias("p50"), eta.cast("long").alias("operator_eta"))


def representative(s, d):
    c = candidates(s, d)
    mid = quantiles_of(c, [], F.col("spread_sec"), {"m": 0.5})
    near = c.crossJoin(F.broadcast(mid)).orderBy(F.abs(F.col("spread_sec") - F.col("m")), "ts", "id").limit(1).select(F.lit("typical").alias("kind"), "run_id", "ts", "spread_sec")
    return near.unionByName(c.orderBy(F.desc("spread_sec"), "ts", "id").limit(1).select(F.lit("worst").alias("kind"), "run_id", "ts", "spread_sec"))


def asof(s, d):
    o = b.observations(s, d)
    left = o.where("source = 'gtfsrt'").select("id", "run_id", "ts")
    return asof_join(left, o.where("source = 'mia' AND delay_seconds IS NOT NULL"), ["run_id"], "ts", "ts", F.col("delay_seconds"), "mia_delay")


QUERIES = {
    "w02_observation_flags": lambda s, d: flagged(s, d).select("id", F.concat_ws(",", "flags").alias("flags")),
    "st02_ingest": lambda s, d: ingest.judged(snapshots(s, d)).where("changed").select("id", "run_id", "source", "ts", "flags"),
    "w08_ingest_flags": lambda s, d: q.ingest_flags(b.observations(s, d)),
    "a20_flag_counts": lambda s, d: q.flag_counts(flagged(s, d)),
    "w07_impossible_runtimes": lambda s, d: q.impossible_runtimes(b.stop_events(s, d), b.stops(s, d)),
    "j10_conflict_candidates": candidates,
    "w12_conflict_dedup": emitted,
    "w13_throttle": lambda s, d: q.throttled(estimates(s, d)),
    "a25_conflict_stats": lambda s, d: q.conflict_stats(candidates(s, d), emitted(s, d)),
    "t08_representative_conflicts": representative,
    "j11_asof_delay": asof,
    "j10_asof_quality": lambda s, d: asof_join(b.observations(s, d).where("source = 'gtfsrt'").select("id", "run_id", "ts"), b.observations(s, d).where("source = 'mia' AND delay_seconds IS NOT NULL"), ["run_id"], "ts", "ts", F.col("delay_seconds"), "mia_delay", 86_400_000),
}

OTHERS = " OR ".join(f"(source <> '{s}' AND ts - t{k} <= 90000 AND abs(delay_seconds - d{k}) > 300)" for k, s in enumerate(SOURCES))
LASTS = ", ".join(f"last_value(CASE WHEN source = '{s}' AND delay_seconds IS NOT NULL THEN {{'ts': ts, 'id': id, 'src': source, 'delay': delay_seconds}} END IGNORE NULLS) OVER r AS o{k}" for k, s in enumerate(SOURCES))
WINDOWS = "WINDOW p AS (PARTITION BY run_id, source ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY run_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
FLAGGED = f"""f0 AS (
  SELECT *, last_value(observed_at IGNORE NULLS) OVER p AS seen, last_value(delay_seconds IGNORE NULLS) OVER p AS prev, max(CAST(substr(location_id, 2) AS INT) % 20) OVER r AS far, {LASTS} FROM obs {WINDOWS}
), f1 AS (SELECT *, {", ".join(f"o{k}.ts AS t{k}, o{k}.delay AS d{k}" for k in range(3))} FROM f0),
f AS (SELECT f1.id, list_filter([
    CASE WHEN seen - observed_at >= 1000 THEN 'OUT_OF_ORDER' END, CASE WHEN abs(delay_seconds - prev) > 3600 THEN 'DELAY_JUMP' END, CASE WHEN {OTHERS} THEN 'SOURCE_CONFLICT' END,
    CASE WHEN CAST(substr(location_id, 2) AS INT) % 20 < far THEN 'BACKWARDS_TELEPORT' END, CASE WHEN ts - observed_at > 600000 THEN 'STALE_SOURCE' END,
    CASE WHEN run_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0) THEN 'UNKNOWN_RUN' END,
    CASE WHEN location_id NOT IN (SELECT stop_id FROM stops) THEN 'UNMAPPED_STOP' END], lambda x: x IS NOT NULL) AS flags FROM f1)"""
CAND = f"""c0 AS (SELECT *, {LASTS} FROM obs WHERE delay_seconds IS NOT NULL {WINDOWS.split(", r AS")[0].split("p AS")[0]} r AS{WINDOWS.split(", r AS")[1]}),
c1 AS (SELECT *, list_max(list_filter([o0, o1, o2], lambda o: o IS NOT NULL AND o.src <> source AND o.ts >= c0.ts - 90000)) AS o FROM c0),
cand AS (SELECT run_id, ts, id, source, o.src AS other_source, CAST(abs(delay_seconds - o.delay) AS BIGINT) AS spread_sec FROM c1 WHERE abs(delay_seconds - o.delay) > 120)"""
EMIT = """emit AS (
  SELECT run_id, min(ts) AS ts FROM cand GROUP BY run_id
  UNION ALL SELECT e.run_id, (SELECT min(c.ts) FROM cand c WHERE c.run_id = e.run_id AND c.ts >= e.ts + 300000) FROM emit e
  WHERE EXISTS (SELECT 1 FROM cand c WHERE c.run_id = e.run_id AND c.ts >= e.ts + 300000)
)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE_SQL = {
    "w02_observation_flags": oracle("obs stops", f"WITH {FLAGGED} SELECT id, array_to_string(flags, ',') AS flags FROM f"),
    "st02_ingest": oracle("obs", """WITH sn AS (SELECT id, run_id % 40 AS run_id, source, ts, observed_at, delay_seconds, location_id FROM obs UNION ALL SELECT id + 1000000000000, run_id % 40, source, ts + 20000, observed_at, delay_seconds, location_id FROM obs WHERE id % 3 = 0),
      nu AS (SELECT * FROM sn WINDOW w AS (PARTITION BY run_id, source ORDER BY ts, id) QUALIFY row_number() OVER w = 1 OR (lag(observed_at) OVER w, lag(delay_seconds) OVER w, lag(location_id) OVER w) IS DISTINCT FROM (observed_at, delay_seconds, location_id))
      SELECT id, run_id, source, ts, array_to_string(list_filter([CASE WHEN lag(observed_at) OVER w - observed_at >= 1000 THEN 'OUT_OF_ORDER' END, CASE WHEN abs(delay_seconds - lag(delay_seconds) OVER w) > 3600 THEN 'DELAY_JUMP' END, CASE WHEN ts - observed_at > 600000 THEN 'STALE_SOURCE' END], lambda x: x IS NOT NULL), ',') AS flags
      FROM nu WINDOW w AS (PARTITION BY run_id, source ORDER BY ts, id)"""),
    "w08_ingest_flags": oracle("obs", """SELECT id, array_to_string(list_filter([CASE WHEN lag(observed_at) OVER w - observed_at >= 1000 THEN 'OUT_OF_ORDER' END,
      CASE WHEN abs(delay_seconds - lag(delay_seconds) OVER w) > 3600 THEN 'DELAY_JUMP' END, CASE WHEN ts - observed_at > 600000 THEN 'STALE_SOURCE' END], lambda x: x IS NOT NULL), ',') AS flags
      FROM obs WINDOW w AS (PARTITION BY run_id, source ORDER BY ts, id)"""),
    "a20_flag_counts": oracle("obs stops", f"WITH {FLAGGED} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM f) GROUP BY 1"),
    "w07_impossible_runtimes": oracle("se stops", """WITH r AS (SELECT *, coalesce(actual_arr_epoch, sched_arr_epoch) AS t FROM se JOIN stops USING (stop_id)),
      g AS (SELECT run_id, stop_sequence, stop_id, stop_lat AS b, stop_lon AS y, lag(stop_lat) OVER w AS a, lag(stop_lon) OVER w AS x, (t - lag(t) OVER w) / 1000.0 AS sec FROM r WINDOW w AS (PARTITION BY run_id ORDER BY stop_sequence, sched_arr_epoch, stop_id)),
      k AS (SELECT *, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(y - x) / 2), 2)))) AS km FROM g)
      SELECT run_id, stop_sequence, stop_id, round(km, 6) AS km, round(sec, 3) AS sec FROM k WHERE km > 0.05 AND (sec <= 0 OR km * 3600 > sec * 300)"""),
    "j10_conflict_candidates": oracle("obs", f"WITH {CAND} SELECT * FROM cand"),
    "w12_conflict_dedup": recursive(oracle("obs", f"WITH {CAND}, {EMIT} SELECT * FROM emit")),
    "w13_throttle": recursive(oracle("obs", f"""WITH o AS (SELECT run_id, id, ts, ts + delay_seconds * 1000 AS p, CASE WHEN id % 17 <> 0 THEN ts // 60000 * 60000 + (id % 3) * 20000 END AS e, row_number() OVER (PARTITION BY run_id ORDER BY ts, id) AS k FROM obs),
      t AS (SELECT run_id, k, id, true AS keep, ts AS since, p, e FROM o WHERE k = 1
        UNION ALL SELECT run_id, k, id, due, CASE WHEN due THEN ts ELSE since END, CASE WHEN due THEN np ELSE p END, CASE WHEN due THEN ne ELSE e END
          FROM (SELECT o.run_id, o.k, o.id, o.ts, o.p AS np, o.e AS ne, t.since, t.p, t.e, coalesce(abs(o.p - t.p) > 30000, true) OR coalesce(abs(o.e - t.e) > 30000, true) OR o.ts - t.since > 120000 AS due FROM t JOIN o ON o.run_id = t.run_id AND o.k = t.k + 1))
      SELECT run_id, id FROM t WHERE keep""")),
    "a25_conflict_stats": recursive(oracle("obs", f"WITH {CAND}, {EMIT} SELECT count(*) AS candidates, count(DISTINCT run_id) AS runs, {fi('spread_sec', 0.5)} AS p50_spread, {fi('spread_sec', 0.9)} AS p90_spread, (SELECT count(*) FROM emit) AS emitted FROM cand")),
    "t08_representative_conflicts": oracle("obs", f"WITH {CAND} (SELECT 'typical' AS kind, run_id, ts, spread_sec FROM cand ORDER BY abs(spread_sec - (SELECT quantile_cont(spread_sec, 0.5) FROM cand)), ts, id LIMIT 1) UNION ALL (SELECT 'worst', run_id, ts, spread_sec FROM cand ORDER BY spread_sec DESC, ts, id LIMIT 1)"),
    "j11_asof_delay": oracle("obs", "WITH m AS (SELECT * FROM obs WHERE source = 'mia' AND delay_seconds IS NOT NULL), g AS (SELECT * FROM obs WHERE source = 'gtfsrt') SELECT g.id, g.run_id, g.ts, m.delay_seconds AS mia_delay FROM g ASOF LEFT JOIN m ON g.run_id = m.run_id AND g.ts >= m.ts"),
    "j10_asof_quality": oracle("obs", "WITH m AS (SELECT * FROM obs WHERE source = 'mia' AND delay_seconds IS NOT NULL), g AS (SELECT * FROM obs WHERE source = 'gtfsrt') SELECT g.id, g.run_id, g.ts, CASE WHEN m.ts >= g.ts - 86400000 THEN m.delay_seconds END AS mia_delay FROM g ASOF LEFT JOIN m ON g.run_id = m.run_id AND g.ts >= m.ts"),
}
