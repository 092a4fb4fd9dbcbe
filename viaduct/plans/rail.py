"""The rail graph of timetable and observations, and where a train goes next."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from viaduct.operators import graph as gr
from viaduct.sources import bindings as b
from viaduct.sources.bindings import oracle


def located(s, d):
    """Observations of few runs; some places have a foreign id and a stop's name, some only a name, some nothing."""
    o, k = b.observations(s, d), F.col("id")
    n = F.substring("location_id", 2, 5).cast("int")
    shown = F.concat(F.lit(" supplier#"), F.lpad(n.cast("string"), 9, "0"))
    place = F.when(k % 5 != 0, F.when(k % 7 == 0, F.concat(F.lit("X"), n.cast("string"))).otherwise(F.col("location_id")))
    name = F.when(k % 5 == 0, F.when(k % 4 == 0, shown).when(k % 4 == 1, F.concat(F.lit("Bivio  d'"), (n % 7).cast("string"))).when(k % 4 == 2, F.lit("  "))).when(k % 7 == 0, shown)
    return o.select((F.col("run_id") % 60).alias("run_id"), "source", "ts", "id", place.alias("location_id"), name.alias("location_name"), F.when(k % 3 == 0, "station").when(k % 3 == 1, "reporting_point").alias("location_kind"))


def graph(s, d):
    return gr.rail_graph(b.gtfs_stop_times(s, d), located(s, d), b.stops(s, d))


def inferred(s, d):
    """The places after the last one of each run, the one before it left out on every other run."""
    edges, nodes = graph(s, d)
    placed = gr.canonical(located(s, d), b.stops(s, d)).where("key IS NOT NULL")
    w = Window.partitionBy("run_id").orderBy("ts", "id")
    moved = placed.withColumn("previous", F.lag("key").over(w)).groupBy("run_id").agg(F.max_by(F.struct("key", "previous"), F.struct("ts", "id")).alias("l"))
    last = moved.select("run_id", "l.key", F.when((F.col("run_id") % 2 == 0) & (F.col("l.previous") != F.col("l.key")), F.col("l.previous")).alias("previous"))
    lost = last.where("run_id % 10 = 0").select((F.col("run_id") + 1000).alias("run_id"), F.lit("nowhere").alias("key"), F.lit(None).cast("string").alias("previous"))
    told = gr.inferred(last.unionByName(lost), edges, nodes)
    rows = told.select("run_id", "key", "outcome", F.col("segment.p").alias("segment_p"), F.posexplode_outer("plausible").alias("pos", "x"))
    return rows.select("run_id", "key", "outcome", F.round("segment_p", 6).alias("segment_p"), "pos", F.col("x.key").alias("to_id"), F.round("x.p", 6).alias("p"))


QUERIES = {
    "a22_rail_graph": lambda s, d: graph(s, d)[0].withColumn("p", F.round("p", 6)),
    "a22_rail_nodes": lambda s, d: graph(s, d)[1],
    "f05_inferred_location": inferred,
}

PLACED = """lo AS (SELECT run_id % 60 AS run_id, source, ts, id, CAST(substr(location_id, 2) AS INT) AS n, location_id AS own FROM obs),
pl AS (SELECT *, CASE WHEN id % 5 <> 0 THEN CASE WHEN id % 7 = 0 THEN 'X' || n ELSE own END END AS location_id, CASE WHEN id % 5 = 0 THEN CASE id % 4 WHEN 0 THEN 'supplier#' || lpad(CAST(n AS VARCHAR), 9, '0') WHEN 1 THEN 'Bivio  d''' || (n % 7) END WHEN id % 7 = 0 THEN 'supplier#' || lpad(CAST(n AS VARCHAR), 9, '0') END AS name,
  CASE id % 3 WHEN 0 THEN 'station' WHEN 1 THEN 'reporting_point' END AS kind FROM lo),
nm AS (SELECT upper(stop_name) AS u, min(stop_id) AS by_name FROM stops GROUP BY 1),
ky AS (SELECT pl.*, CASE WHEN s.stop_id IS NOT NULL THEN pl.location_id ELSE coalesce(by_name, pl.location_id, 'n:' || nullif(regexp_replace(upper(name), '[^A-Z0-9]+', '-', 'g'), '')) END AS key FROM pl LEFT JOIN (SELECT DISTINCT stop_id FROM stops) s ON s.stop_id = pl.location_id LEFT JOIN nm ON u = upper(name)),
kn AS (SELECT * FROM ky WHERE key IS NOT NULL),
mv AS (SELECT lag(key) OVER (PARTITION BY run_id, source ORDER BY ts, id) AS f, key AS t, 0 AS s FROM kn UNION ALL SELECT lag(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence), stop_id, 1 FROM times),
ed AS (SELECT f AS from_id, t AS to_id, count(*) FILTER (s = 1) AS scheduled, count(*) FILTER (s = 0) AS observed, count(*) AS n FROM mv WHERE f <> t GROUP BY ALL),
eg AS (SELECT *, n / sum(n) OVER (PARTITION BY from_id) AS p FROM ed)"""
NODES = """fs AS (SELECT key, arg_min(name, (run_id, source, ts, id)) AS told, arg_min_null(kind, (run_id, source, ts, id)) AS said FROM kn GROUP BY key),
al AS (SELECT stop_id AS key FROM stops UNION SELECT key FROM fs UNION SELECT from_id FROM ed UNION SELECT to_id FROM ed),
nd AS (SELECT al.key, coalesce(s.stop_name, told) AS name, CASE WHEN s.stop_id IS NOT NULL THEN 'station' WHEN fs.key IS NOT NULL THEN CASE WHEN said = 'station' THEN 'station' ELSE 'reporting_point' END ELSE 'unknown' END AS kind FROM al LEFT JOIN (SELECT stop_id, min(stop_name) AS stop_name FROM stops GROUP BY 1) s ON s.stop_id = al.key LEFT JOIN fs ON fs.key = al.key)"""
LAST = """l0 AS (SELECT run_id, key, lag(key) OVER (PARTITION BY run_id ORDER BY ts, id) AS previous, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, id DESC) AS k FROM kn),
la AS (SELECT run_id, key, CASE WHEN run_id % 2 = 0 AND previous <> key THEN previous END AS previous FROM l0 WHERE k = 1 UNION ALL SELECT run_id + 1000, 'nowhere', NULL FROM l0 WHERE k = 1 AND run_id % 10 = 0),
ca AS (SELECT la.run_id, la.key, to_id, n, p, to_id IS NOT DISTINCT FROM previous AS back, count(*) FILTER (to_id IS DISTINCT FROM previous) OVER (PARTITION BY la.run_id) AS ahead FROM la JOIN eg ON from_id = la.key),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, to_id) AS k FROM ca WHERE NOT back OR ahead = 0),
tp AS (SELECT run_id, to_id, CAST(k - 1 AS INT) AS pos, p / sum(p) OVER (PARTITION BY run_id) AS share, max(p) FILTER (k = 1) OVER (PARTITION BY run_id) AS segment_p FROM rk WHERE k <= 3)
SELECT la.run_id, la.key, CASE WHEN tp.run_id IS NOT NULL THEN 'next' WHEN la.key IN (SELECT key FROM nd) THEN 'sink' ELSE 'unknown' END AS outcome, round(segment_p, 6) AS segment_p, pos, to_id, round(share, 6) AS p FROM la LEFT JOIN tp USING (run_id)"""

ORACLE_SQL = {
    "a22_rail_graph": oracle("se stops obs times", f"WITH {PLACED} SELECT * REPLACE (round(p, 6) AS p) FROM eg"),
    "a22_rail_nodes": oracle("se stops obs times", f"WITH {PLACED}, {NODES} SELECT * FROM nd"),
    "f05_inferred_location": oracle("se stops obs times", f"WITH {PLACED}, {NODES}, {LAST}"),
}
