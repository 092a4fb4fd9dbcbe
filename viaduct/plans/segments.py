"""Segment and evaluation queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from viaduct.operators import evaluate as ev
from viaduct.operators import segments as sg
from viaduct.sources import bindings as b
from viaduct.sources.bindings import oracle

#: An instant within the data, in place of a wall clock.
AS_OF = 820_454_400_000  # 1996-01-01
#: Imported history ends and live traversals begin.
HISTORY_END = 899_251_200_000  # 1998-07-01


def traversals(spark, d):
    return sg.traversals(b.stop_events(spark, d))


SEG = """seg0 AS (
  SELECT *, lead(stop_id) OVER w AS to_stop_id, lead(actual_arr_epoch) OVER w AS left_at, lead(sched_arr_epoch) OVER w AS to_sched, lead(arr_delay_sec) OVER w AS to_delay, row_number() OVER w AS pos
  FROM se WINDOW w AS (PARTITION BY run_id ORDER BY stop_sequence, sched_arr_epoch, stop_id)
), seg1 AS (
  SELECT stop_id || '>' || to_stop_id AS segment_id, run_id, pos, stop_id AS from_stop_id, to_stop_id, coalesce(actual_dep_epoch, actual_arr_epoch) AS entered_at, left_at,
    (left_at - coalesce(actual_dep_epoch, actual_arr_epoch)) // 1000 AS runtime_sec, (to_sched - sched_dep_epoch) // 1000 AS sched_sec, CAST(dep_delay_sec AS BIGINT) AS entry_delay_sec, CAST(to_delay AS BIGINT) AS exit_delay_sec
  FROM seg0 WHERE to_stop_id IS NOT NULL
), seg AS (
  SELECT * EXCLUDE (pos, sched_sec), exit_delay_sec - entry_delay_sec AS delay_delta_sec FROM seg1
  WHERE left_at > entered_at AND runtime_sec >= greatest(30, sched_sec * 0.25) QUALIFY row_number() OVER (PARTITION BY run_id, segment_id ORDER BY pos) = 1
)"""
HOUR = "hour(timezone('Europe/Rome', make_timestamptz({0} * 1000)))"
PEAK = "({0} IN (7, 8) OR {0} BETWEEN 16 AND 18)"
BUCKET = f"""bk AS (
  SELECT seg.*, unnest(['all', CASE WHEN {PEAK.format(HOUR.format("entered_at"))} THEN 'peak' ELSE 'off' END]) AS bucket FROM seg
)"""
STATS = """stats AS (
  SELECT segment_id, bucket, count(*) AS n, round(quantile_cont(runtime_sec, 0.1), 6) AS p10_runtime, round(quantile_cont(runtime_sec, 0.5), 6) AS p50_runtime, round(quantile_cont(runtime_sec, 0.9), 6) AS p90_runtime,
    round(quantile_cont(delay_delta_sec, 0.5), 6) AS p50_delta, round(quantile_cont(delay_delta_sec, 0.9), 6) AS p90_delta FROM bk GROUP BY ALL HAVING count(*) >= 5
)"""
DWELL = """dw AS (
  SELECT stop_id, least(list_sort(list(d))[count(*) // 2 + 1], 180) AS dwell_sec FROM (SELECT stop_id, (arrival_sec * 7 + stop_sequence * 13) % 2400 - 100 AS d FROM times) WHERE d > 0 AND d < 1800 GROUP BY stop_id
)"""
PAIRS = DWELL + """, hp0 AS (
  SELECT run_id, stop_id, sched_arr_epoch AS s, actual_arr_epoch AS a, lead(stop_id) OVER w AS to_stop_id, lead(sched_arr_epoch) OVER w AS ts, lead(actual_arr_epoch) OVER w AS ta
  FROM se WHERE actual_arr_epoch IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY stop_sequence)
), hp1 AS (
  SELECT *, CAST(floor((ta - a) / 1000.0 + 0.5) AS BIGINT) AS took, CAST(floor((ts - s) / 1000.0 + 0.5) AS BIGINT) AS planned, CAST(floor((a - s) / 1000.0 + 0.5) AS BIGINT) AS da, CAST(floor((ta - ts) / 1000.0 + 0.5) AS BIGINT) AS db FROM hp0 WHERE to_stop_id IS NOT NULL
), hp AS (
  SELECT stop_id || '>' || to_stop_id AS segment_id, run_id, a AS entered_at, greatest(30, took - coalesce(dwell_sec, 0)) AS runtime_sec, db - da AS delay_delta_sec, took - planned AS excess_sec FROM hp1 LEFT JOIN dw USING (stop_id)
  WHERE planned > 0 AND planned <= 3600 AND took <= 7200 AND took >= 30 AND took >= planned * 0.25 AND da BETWEEN -900 AND 14400 AND db BETWEEN -900 AND 14400
)"""
PRIOR = PAIRS + f""", pbk AS (
  SELECT hp.*, unnest(['all', CASE WHEN {PEAK.format(HOUR.format("entered_at"))} THEN 'peak' ELSE 'off' END]) AS bucket FROM hp WHERE {{history}}
), prior AS (
  SELECT segment_id, bucket, count(*) AS n, round(quantile_cont(runtime_sec, 0.1), 6) AS p10_runtime, round(quantile_cont(runtime_sec, 0.5), 6) AS p50_runtime, round(quantile_cont(runtime_sec, 0.9), 6) AS p90_runtime,
    round(quantile_cont(delay_delta_sec, 0.5), 6) AS p50_delta, round(quantile_cont(delay_delta_sec, 0.9), 6) AS p90_delta, round(quantile_cont(excess_sec, 0.5), 6) AS p50_excess FROM pbk GROUP BY ALL HAVING count(*) >= 5
)"""
ALL_PRIOR, OLD_PRIOR = PRIOR.replace("{history}", "true"), PRIOR.replace("{history}", f"entered_at < {HISTORY_END}")
FLOOR = "list_sort(list({x}))[CAST(least(count({x}) - 1, floor(count({x}) * {q})) AS INT) + 1]"


def fi(x: str, q: float) -> str:
    return FLOOR.format(x=x, q=q)


def metrics(e: str) -> str:
    return f"count(*) AS n, round(avg(abs({e})), 4) AS mae, {fi(f'abs({e})', 0.5)} AS median_ae, round(sqrt(avg(CAST({e} * {e} AS DOUBLE))), 4) AS rmse, {fi(f'abs({e})', 0.9)} AS p90_ae, {fi(f'abs({e})', 0.95)} AS p95_ae, round(avg({e}), 4) AS bias"


def _wanted(t):
    return sg.bucketed(t).where("bucket <> 'all'").select("segment_id", "bucket").distinct()


def stop_dwells(spark, d):
    times = b.gtfs_stop_times(spark, d)
    return sg.dwell(times.withColumn("departure_sec", F.col("arrival_sec") + (F.col("arrival_sec") * 7 + F.col("stop_sequence") * 13) % 2400 - 100))


def historical(spark, d):
    return sg.historical_pairs(b.stop_events(spark, d), stop_dwells(spark, d))


def old_priors(spark, d):
    return sg.segment_priors(historical(spark, d).where(F.col("entered_at") < HISTORY_END))


def live(t):
    return t.where(F.col("entered_at") >= HISTORY_END)


def _m02(spark, d):
    t = traversals(spark, d)
    return sg.pick_stats(_wanted(t), sg.segment_stats(live(t)), old_priors(spark, d))


def _j16(spark, d):
    """Segments of the priors that live statistics lack, the best known first."""
    stats = sg.segment_stats(live(traversals(spark, d)))
    missing = old_priors(spark, d).where("bucket = 'all'").join(stats.select("segment_id").distinct(), "segment_id", "left_anti")
    return missing.orderBy(F.desc("n"), "segment_id").limit(100).select("segment_id", "n", "p50_runtime", "p10_runtime", "p90_runtime")


def _labelled(spark, d):
    """Connections: rows with a score and whether the train was early enough."""
    s = b.scored(spark, d)
    return s.select(((F.col("our_p50") - F.col("sched_arr_epoch")) / 1000).cast("long").alias("score"), (F.col("actual_arr_epoch") - F.col("sched_arr_epoch") > 120000).cast("int").alias("label"))


QUERIES = {
    "w01_segment_observations": lambda s, d: traversals(s, d),
    "a02_segment_stats": lambda s, d: sg.segment_stats(traversals(s, d)),
    "a03_segment_priors": lambda s, d: sg.segment_priors(historical(s, d)),
    "p12_historical_pairs": historical,
    "a02_segment_stats_recent": lambda s, d: sg.segment_stats(sg.look_back(traversals(s, d), AS_OF, 1200), 2),
    "j16_prior_only": _j16,
    "a04_dwell": stop_dwells,
    "m02_stats_for_segment": _m02,
    "t01_top_segments": lambda s, d: sg.top_segments(sg.segment_stats(traversals(s, d))),
    "p02_export_horizon": lambda s, d: b.scored(s, d).select("prediction_id", F.floor((F.col("sched_arr_epoch") - F.col("generated_at")) / 1000).cast("long").alias("horizon_sec")).withColumn("horizon", ev.export_horizon(F.col("horizon_sec"))),
    "p03_bench_horizon": lambda s, d: b.scored(s, d).groupBy(ev.bench_horizon(F.col("actual_arr_epoch") - F.col("generated_at")).alias("horizon")).count().withColumnRenamed("count", "n"),
    "p04_backtest_horizon": lambda s, d: b.predictions(s, d).groupBy(ev.backtest_horizon((F.col("sched_arr_epoch") - F.col("generated_at")) / 1000).alias("bucket")).count().withColumnRenamed("count", "n"),
    "a14_error_metrics": lambda s, d: sg.error_metrics(b.scored(s, d), ["model_version"], "our_error_sec"),
    "a15_benchmark": lambda s, d: ev.benchmark(b.scored(s, d)),
    "a15_verdict": lambda s, d: ev.verdict(ev.benchmark(b.scored(s, d))),
    "a16_backtest_mae": lambda s, d: b.scored(s, d).groupBy(ev.backtest_horizon((F.col("sched_arr_epoch") - F.col("generated_at")) / 1000).alias("bucket"), "model_version").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("our_error_sec")), 4).alias("mae")),
    "a23_target_encoding": lambda s, d: ev.target_encoding(b.scored(s, d).join(b.runs(s, d).select("run_id", "route_id"), "run_id"), "route_id", "our_error_sec"),
    "a27_conformal": lambda s, d: ev.conformal(b.scored(s, d)),
    "a28_auc": lambda s, d: ev.auc(_labelled(s, d), "score", "label"),
    "a32_prior_check": lambda s, d: ev.prior_check(live(traversals(s, d)), old_priors(s, d)),
    "w22_time_split": lambda s, d: ev.time_split(b.scored(s, d).select("prediction_id", "generated_at"), ["generated_at", "prediction_id"]),
}

HORIZON = "CASE WHEN {m} < 0 THEN NULL WHEN {m} < 2 THEN 'T-1' WHEN {m} < 7 THEN 'T-5' WHEN {m} < 12 THEN 'T-10' WHEN {m} < 17 THEN 'T-15' WHEN {m} < 30 THEN 'T-20' ELSE 'T-30+' END"
BENCH = HORIZON.format(m="((actual_arr_epoch - generated_at) / 60000.0)")
INDEX = "CASE WHEN {s} <= 60 THEN 0 WHEN {s} <= 300 THEN 1 WHEN {s} <= 600 THEN 2 WHEN {s} <= 900 THEN 3 WHEN {s} <= 1800 THEN 4 ELSE 5 END".format(s="greatest(0, (sched_arr_epoch - generated_at) / 1000.0)")
TABLE = f"""bench0 AS (
  SELECT {BENCH} AS horizon, unnest([{{'model': 'schedule', 'error': schedule_error_sec, 'inside': NULL}}, {{'model': 'operator', 'error': operator_error_sec, 'inside': NULL}},
    {{'model': model_version, 'error': our_error_sec, 'inside': CASE WHEN actual_arr_epoch BETWEEN our_p10 AND our_p90 THEN 1 ELSE 0 END}}], recursive := true) FROM scored
), bench AS (SELECT horizon, model, {metrics("error")}, round(avg(inside), 4) AS coverage FROM bench0 WHERE horizon IS NOT NULL AND error IS NOT NULL GROUP BY ALL)"""

ORACLE_SQL = {
    "w01_segment_observations": oracle("se", f"WITH {SEG} SELECT * FROM seg"),
    "a02_segment_stats": oracle("se", f"WITH {SEG}, {BUCKET}, {STATS} SELECT * FROM stats"),
    "a03_segment_priors": oracle("se times", f"WITH {ALL_PRIOR} SELECT * FROM prior"),
    "p12_historical_pairs": oracle("se times", f"WITH {PAIRS} SELECT * FROM hp"),
    "a02_segment_stats_recent": oracle("se", f"WITH {SEG}, {BUCKET}, {STATS.replace('FROM bk', f'FROM bk WHERE entered_at BETWEEN {AS_OF - 1200 * 86400000} AND {AS_OF}').replace('>= 5', '>= 2')} SELECT * FROM stats"),
    "j16_prior_only": oracle("se times", f"WITH {SEG}, {BUCKET}, {OLD_PRIOR}, lv AS (SELECT segment_id FROM bk WHERE entered_at >= {HISTORY_END} GROUP BY segment_id, bucket HAVING count(*) >= 5) SELECT segment_id, n, p50_runtime, p10_runtime, p90_runtime FROM prior WHERE bucket = 'all' AND segment_id NOT IN (SELECT segment_id FROM lv) ORDER BY n DESC, segment_id LIMIT 100"),
    "a04_dwell": oracle("se times", f"WITH {DWELL} SELECT * FROM dw"),
    "m02_stats_for_segment": oracle("se times", f"""WITH {SEG}, {BUCKET}, {OLD_PRIOR}, live AS (
  SELECT segment_id, bucket, count(*) AS n, round(quantile_cont(runtime_sec, 0.5), 6) AS p50_runtime, round(quantile_cont(runtime_sec, 0.9), 6) AS p90_runtime FROM bk WHERE entered_at >= {HISTORY_END} GROUP BY ALL HAVING count(*) >= 5
), c AS (
  SELECT segment_id, bucket, 1 AS rank, 'live' AS source, n, p50_runtime, p90_runtime FROM live UNION ALL
  SELECT segment_id, bucket, 2, 'prior', n, p50_runtime, round(p50_runtime + 1.3 * (p90_runtime - p50_runtime), 6) FROM prior
), w AS (SELECT DISTINCT segment_id, bucket FROM bk WHERE bucket <> 'all')
SELECT w.segment_id, w.bucket, c.source, c.n, c.p50_runtime, c.p90_runtime FROM w LEFT JOIN c ON c.segment_id = w.segment_id AND c.bucket IN (w.bucket, 'all')
QUALIFY row_number() OVER (PARTITION BY w.segment_id, w.bucket ORDER BY c.rank NULLS LAST, c.bucket = 'all') = 1"""),
    "t01_top_segments": oracle("se", f"WITH {SEG}, {BUCKET}, {STATS} SELECT * FROM stats ORDER BY n DESC, segment_id, bucket LIMIT 50"),
    "p02_export_horizon": oracle("se ends pred scored", "WITH h AS (SELECT prediction_id, (sched_arr_epoch - generated_at) // 1000 AS horizon_sec FROM scored) SELECT *, CASE WHEN horizon_sec <= 300 THEN '0-5m' WHEN horizon_sec <= 900 THEN '5-15m' WHEN horizon_sec <= 1800 THEN '15-30m' WHEN horizon_sec <= 3600 THEN '30-60m' ELSE '60m+' END AS horizon FROM h"),
    "p03_bench_horizon": oracle("se ends pred scored", f"SELECT {BENCH} AS horizon, count(*) AS n FROM scored GROUP BY 1"),
    "p04_backtest_horizon": oracle("se ends pred", f"SELECT CAST({INDEX} AS INT) AS bucket, count(*) AS n FROM pred GROUP BY 1"),
    "a14_error_metrics": oracle("se ends pred scored", f"SELECT model_version, {metrics('our_error_sec')} FROM scored GROUP BY 1"),
    "a15_benchmark": oracle("se ends pred scored", f"WITH {TABLE} SELECT * FROM bench"),
    "a15_verdict": oracle("se ends pred scored", f"WITH {TABLE} SELECT horizon, model AS best_model, mae AS best_mae FROM bench WHERE n >= 30 QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY mae, model) = 1"),
    "a16_backtest_mae": oracle("se ends pred scored", f"SELECT CAST({INDEX} AS INT) AS bucket, model_version, count(*) AS n, round(avg(abs(our_error_sec)), 4) AS mae FROM scored GROUP BY 1, 2"),
    "a23_target_encoding": oracle("se ends runs pred scored", "WITH j AS (SELECT route_id, our_error_sec AS e FROM scored JOIN runs USING (run_id)) SELECT route_id, count(e) AS n, floor((sum(e) + 20 * (SELECT avg(e) FROM j)) / (count(e) + 20) * 10 + 0.5) / 10 AS encoded FROM j GROUP BY 1"),
    "a27_conformal": oracle("se ends pred scored", f"SELECT CAST({INDEX} AS INT) AS bucket, greatest(60, {fi('abs(our_error_sec)', 0.9)}) AS offset_sec, count(*) AS n FROM scored GROUP BY 1"),
    "a28_auc": oracle("se ends pred scored", """WITH r AS (SELECT (our_p50 - sched_arr_epoch) // 1000 AS s, CASE WHEN actual_arr_epoch - sched_arr_epoch > 120000 THEN 1 ELSE 0 END AS y FROM scored),
k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM r)
SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM k"""),
    "a32_prior_check": oracle("se times", f"WITH {SEG}, {OLD_PRIOR} SELECT CASE WHEN n <= 5 THEN 'n<=5' WHEN n <= 20 THEN 'n6-20' ELSE 'n>20' END AS size, count(*) AS n, round(avg(abs(runtime_sec - p50_runtime)), 4) AS mae, round(avg(CASE WHEN runtime_sec <= p90_runtime THEN 1 ELSE 0 END), 4) AS below_p90 FROM seg JOIN prior USING (segment_id) WHERE seg.entered_at >= {HISTORY_END} AND bucket = 'all' GROUP BY 1"),
    "w22_time_split": oracle("se ends pred scored", "SELECT prediction_id, generated_at, row_number() OVER (ORDER BY generated_at, prediction_id) <= floor(0.8 * count(*) OVER ()) AS is_train FROM scored"),
}
