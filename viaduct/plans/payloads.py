"""Queries that read payloads made of the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from viaduct.plans.joins import NOW
from viaduct.sources import bindings as b
from viaduct.sources import payloads as py
from viaduct.sources.bindings import oracle
from viaduct.streaming import live

HOUR = "2024-01-17T14"


def waiting(s, d):
    """Payloads with messages at two depths, one too deep, and one unreadable in ten."""
    k = F.col("o_orderkey")
    inner = F.struct(F.concat(F.lit("C"), (k % 7).cast("string")).alias("Code"), F.lit("in arrivo").alias("WaitMessage"))
    line = F.struct(F.concat(F.lit("L"), (k % 5).cast("string")).alias("Line"), F.concat((k % 20).cast("string"), F.lit(" min")).alias("WaitMessage"), inner.alias("Next"))
    deep = F.lit("x").alias("WaitMessage")
    for name in "gfedcba":
        deep = F.struct(deep).alias(name)
    raw = F.to_json(F.struct(F.array(line).alias("Lines"), deep))
    rows = b.table(s, d, "orders").select(k.alias("id"), F.when(k % 10 != 0, raw).otherwise("{").alias("raw"))
    return rows.select("id", F.posexplode(py.wait_messages(F.col("raw"))).alias("pos", "x")).select("id", "pos", "x.line", "x.message")


def metro(s, d):
    k = F.col("o_orderkey")
    words = F.get(F.array(*map(F.lit, ("Regolare", "Ritardi", "Sospesa", "Chiusa"))), (k % 4).cast("int"))
    node = F.struct(F.concat(F.lit("M"), (k % 5).cast("string")).alias("line"), F.when(k % 3 != 0, words).alias("Status"), F.when(k % 3 != 1, F.lit("Direzione A")).alias("description"))
    rows = b.table(s, d, "orders").select(k.alias("id"), F.to_json(F.struct(F.array(node).alias("data"))).alias("raw"))
    return rows.select("id", F.explode(py.metro_status(F.col("raw"))).alias("x")).select("id", "x.line", "x.direction", "x.status", py.disrupted(F.col("x.direction"), F.col("x.status")).alias("disrupted"))


def matches(s, d):
    k = F.col("c_custkey")
    team = lambda side, name: F.struct(F.lit(side).alias("homeAway"), F.struct(name.alias("displayName")).alias("team"))
    home = F.get(F.array(*map(F.lit, ("Inter Milano", "Roma", "AC MILAN", "Monza"))), (k % 4).cast("int"))
    date = F.when(k % 9 != 0, F.date_format(F.timestamp_millis(F.lit(NOW) + k * 3_600_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    event = F.struct(k.cast("string").alias("id"), date.alias("date"), F.concat(home, F.lit(" - X")).alias("name"), F.array(F.struct(F.array(team("away", F.lit("Inter")), team("home", home)).alias("competitors"))).alias("competitions"))
    raw = b.table(s, d, "customer").select(F.to_json(F.struct(F.array(event).alias("events"))).alias("raw"))
    venues = s.createDataFrame([("San Siro", "inter", 10_800_000, 7_200_000), ("San Siro", "milan", 10_800_000, 7_200_000)], "venue string, team string, before_ms long, after_ms long")
    return py.fixtures(raw, venues)


def rainfall(s, d):
    """Forecasts of all customers' points and gauges of all suppliers' sensors, one of them stale at every other instant."""
    k = F.col("c_custkey")
    point = F.struct(F.struct(F.array(F.lit("2024-01-17T13:00"), F.lit(HOUR + ":00")).alias("time"), F.array(F.lit(9.0), F.when(k % 3 != 0, (k % 50) / 10)).alias("precipitation")).alias("hourly"))
    forecast = py.forecast_rain(b.table(s, d, "customer").select(F.to_json(point, {"ignoreNullFields": "false"}).alias("raw")), HOUR)
    g = F.col("s_suppkey")
    readings = b.table(s, d, "supplier").select(g.alias("sensor"), F.explode(F.array(F.struct(F.lit(1).alias("ts"), ((g % 40) / 10).alias("value")), F.struct(F.lit(2).alias("ts"), F.when(g % 2 == 0, (g % 30) / 10).otherwise(-999.0).alias("value")))).alias("x")).select("sensor", "x.ts", "x.value")
    gauge = py.gauge_rain(readings).withColumnRenamed("rain_mm", "gauge")
    age = F.col("id") * 600_000
    both = s.range(24).crossJoin(F.broadcast(gauge)).crossJoin(F.broadcast(forecast))  # one row each
    return both.select("id", py.rain(F.col("gauge"), F.lit(NOW) - age, F.col("rain_mm"), F.lit(NOW) - age, F.lit(NOW)).alias("rain_mm"))


def watched(s, d):
    """What travellers that watch a run are told of it."""
    o = b.observations(s, d)
    k = F.col("id")
    return live.pushes(o.select(F.concat(F.lit("w"), F.col("run_id").cast("string")).alias("watch"), "ts", "id", F.when(k % 40 == 0, "cancelled").otherwise("running").alias("status"), (F.lit(NOW) + F.col("delay_seconds") * 1000).alias("p50"), (k % 25 == 0).alias("risk")))


QUERIES = {
    "src09_wait_messages": waiting,
    "src10_metro_status": metro,
    "src17_fixtures": matches,
    "src19_rain": rainfall,
    "f10_pushes": watched,
    "st07_flagged": lambda s, d: live.flagged(b.observations(s, d)),
    "st05_sliding_delay": lambda s, d: live.sliding(b.observations(s, d)),
    "st06_sessions": lambda s, d: live.sessions(b.observations(s, d)),
}

ORACLE_SQL = {
    "src09_wait_messages": """SELECT o_orderkey AS id, CAST(pos AS INT) AS pos, CASE pos WHEN 0 THEN 'L' || (o_orderkey % 5) ELSE 'C' || (o_orderkey % 7) END AS line, CASE pos WHEN 0 THEN (o_orderkey % 20) || ' min' ELSE 'in arrivo' END AS message FROM orders, range(2) t(pos) WHERE o_orderkey % 10 <> 0""",
    "src10_metro_status": """WITH n AS (SELECT o_orderkey AS id, 'M' || (o_orderkey % 5) AS line, CASE WHEN o_orderkey % 3 <> 1 THEN 'Direzione A' END AS direction, CASE WHEN o_orderkey % 3 <> 0 THEN ['Regolare', 'Ritardi', 'Sospesa', 'Chiusa'][o_orderkey % 4 + 1] END AS st FROM orders)
      SELECT id, line, direction, coalesce(st, direction) AS status, coalesce(st, '') IN ('Ritardi', 'Sospesa', 'Chiusa') AS disrupted FROM n""",
    "src17_fixtures": f"""SELECT CAST(c_custkey AS VARCHAR) AS external_id, ['Inter Milano', 'Roma', 'AC MILAN', 'Monza'][c_custkey % 4 + 1] || ' - X — San Siro' AS title, ({NOW} + c_custkey * 3600000) // 1000 * 1000 - 10800000 AS start_epoch, ({NOW} + c_custkey * 3600000) // 1000 * 1000 + 7200000 AS end_epoch FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 2 = 0""",
    "src19_rain": """WITH f AS (SELECT round(avg(CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 50) / 10 END), 2) AS v FROM customer),
      g AS (SELECT round(avg(v), 2) AS v FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 30) / 10 ELSE (s_suppkey % 40) / 10 END AS v FROM supplier ORDER BY s_suppkey LIMIT 12))
      SELECT id, CASE WHEN id * 600000 <= 3600000 THEN g.v WHEN id * 600000 <= 10800000 THEN f.v END AS rain_mm FROM range(24) t(id), f, g""",
    "f10_pushes": "WITH RECURSIVE " + oracle("obs", f"""WITH o AS (SELECT 'w' || run_id AS watch, ts, id, id % 40 = 0 AS gone, {NOW} + delay_seconds * 1000 AS p50, id % 25 = 0 AS risk, row_number() OVER (PARTITION BY run_id ORDER BY ts, id) AS k FROM obs),
      t AS (SELECT watch, k, id, CASE WHEN gone THEN 'cancelled' WHEN risk THEN 'risk' END AS kind, p50 AS eta, gone AS c, NOT gone AND risk AS r, CASE WHEN gone OR risk THEN ts END AS since FROM o WHERE k = 1
        UNION ALL SELECT watch, k, id, kind, CASE WHEN wait THEN eta WHEN kind IS NULL THEN coalesce(eta, p50) ELSE coalesce(p50, eta) END, c OR coalesce(kind = 'cancelled', false), r OR coalesce(kind = 'risk', false), CASE WHEN kind IS NULL THEN since ELSE ts END
          FROM (SELECT o.watch, o.k, o.id, o.ts, o.p50, t.eta, t.c, t.r, t.since, coalesce(o.ts - t.since < 600000, false) AS wait,
            CASE WHEN o.ts - t.since < 600000 THEN NULL WHEN o.gone AND NOT t.c THEN 'cancelled' WHEN abs(o.p50 - t.eta) > 120000 THEN 'eta' WHEN o.risk AND NOT t.r THEN 'risk' END AS kind FROM t JOIN o ON o.watch = t.watch AND o.k = t.k + 1))
      SELECT watch, id, kind FROM t WHERE kind IS NOT NULL""").removeprefix("WITH "),
    "st07_flagged": oracle("obs", """WITH p AS (SELECT *, last_value(observed_at IGNORE NULLS) OVER w AS seen, last_value(delay_seconds IGNORE NULLS) OVER w AS prev FROM obs WINDOW w AS (PARTITION BY run_id, source ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT id, concat_ws(',', CASE WHEN seen - observed_at >= 1000 THEN 'OUT_OF_ORDER' END, CASE WHEN abs(delay_seconds - prev) > 3600 THEN 'DELAY_JUMP' END, CASE WHEN ts - observed_at > 600000 THEN 'STALE_SOURCE' END) AS flags FROM p"""),
    "st05_sliding_delay": oracle("obs", "WITH x AS (SELECT source, delay_seconds, ts // 300000 * 300000 - o AS since FROM obs, (VALUES (0), (300000)) v(o)) SELECT since, since + 600000 AS until, source, count(delay_seconds) AS n, round(avg(delay_seconds), 4) AS mean_delay FROM x GROUP BY ALL"),
    "st06_sessions": oracle("obs", "WITH g AS (SELECT run_id, ts, CASE WHEN ts - lag(ts) OVER w >= 900000 THEN 1 ELSE 0 END AS new FROM obs WINDOW w AS (PARTITION BY run_id ORDER BY ts)), n AS (SELECT run_id, ts, sum(new) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT run_id, min(ts) AS since, max(ts) AS until, count(*) AS n FROM n GROUP BY run_id, k"),
}
