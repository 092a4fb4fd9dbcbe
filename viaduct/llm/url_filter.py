"""URL filter by nested host and path rules: sorted sweeps, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.llm.common import every_column

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    found = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(F.substring_index(url.substr(F.instr(url, "://") + 3, F.length(url)), "#", 1), "?", 1)
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substring_index(rest, "/", 1)).otherwise(rest)
    path = F.when(slash > 0, rest.substr(slash, F.length(rest))).otherwise("")
    return F.when(found, F.translate(host, _UPPER, _LOWER)).otherwise(""), F.when(found, path).otherwise("")


def reversed_key(host: Column) -> Column:
    """``blog.example.org`` as ``org.example.blog.``: a host and its subdomains are an interval of keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def outer_host(key: Column, labels: int) -> Column:
    """The first labels of a reversed key, empty if it has fewer."""
    return F.when(F.size(F.split(key, "\\.")) > labels, F.concat(F.substring_index(key, ".", labels), F.lit("."))).otherwise("")


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a table."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def stacks(rules: DataFrame) -> DataFrame:
    """(depth, key, path, open): for each rule, the rules open where it begins.

    Those are the rules of its host whose path starts its own, itself included, the longest first; a
    host that both blocks and allows a path blocks it.
    """
    one = rules.groupBy("host", "path").agg(F.min(F.struct(F.when(F.col("verdict") == "block", 0).otherwise(1), "verdict")).alias("v")).select("host", "path", "v.verdict")
    starts = one.select("host", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).select("host", "path", F.col("path").substr(F.lit(1), F.col("n")).alias("start"))
    outer = one.select("host", F.col("path").alias("start"), "verdict")
    held = starts.join(outer, ["host", "start"]).groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct(F.length("start").alias("n"), F.col("start").alias("path"), "verdict")), asc=False).alias("open"))
    return held.select(F.size(F.split("host", "\\.")).alias("depth"), reversed_key(F.col("host")).alias("key"), "host", "path", "open")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    A rule (host, path, verdict) fits URLs of its host and all subdomains whose path starts with its
    path; the longest rule text wins, then the longest host, then ``block``.  Where none fits, rule
    is null and the verdict is ``default``.

    The first labels of a reversed host and the path make a key in which a rule is an interval.  For
    each number of labels that rule hosts have, URLs and rules are sorted together by that key and one
    sweep carries the stack of rules open at the latest rule's beginning; those that do not start the
    URL's path have closed.  A task's share is a host and a salt; a host with more URLs than an even
    share is dealt to as many salts as it needs, and only its own rules are copied to them.

    Null URLs have an empty host and path; null rule fields drop the rule; rows repeat as they come;
    very long URLs are compared whole; an empty table gives no rows.  Columns of ``pages`` named host,
    path, rule or verdict are replaced; others are kept.
    """
    made = ("host", "path", "rule", "verdict")
    names = [c for c in pages.columns if c not in made]
    kept = [c for c, name in zip(every_column(pages), pages.columns, strict=True) if name in names]
    rules = stacks(rules.dropna(subset=["host", "path", "verdict"]).select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict"))
    depths = sorted(r[0] for r in rules.select("depth").distinct().collect())  # at most 127, the labels of a host
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.struct(*kept).alias("row"), host.alias("host"), path.alias("path"), *[outer_host(reversed_key(host), d).alias(f"key{d}") for d in depths])

    share = max(1024, -(-pages.count() // int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    keys = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"key{d}").alias("key")) for d in depths])).alias("k")) if depths else None
    hot = keys.groupBy("k.depth", "k.key").count().where(F.col("count") > share).collect() if depths else []  # at most as many for a depth as there are shuffle partitions
    salts = pages.sparkSession.createDataFrame([(r[0], r[1], -(-r[2] // share)) for r in hot], "depth int, key string, salts long")
    wins = []
    for d in depths:
        some = F.broadcast(salts.where(F.col("depth") == d).select(F.col("key").alias(f"key{d}"), "salts"))
        urls = rows.join(some, f"key{d}", "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1)))).drop("salts").withColumn("is_url", F.lit(1))
        begins = rules.where(F.col("depth") == d).select(F.col("key").alias(f"key{d}"), F.col("host").alias("rule_host"), "path", "open").join(some, f"key{d}", "left")
        begins = begins.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts").withColumn("is_url", F.lit(0))
        sweep = Window.partitionBy(f"key{d}", "salt").orderBy("path", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = urls.unionByName(begins, allowMissingColumns=True)
        last = F.last(F.when(F.col("is_url") == 0, F.struct("rule_host", "open")), ignorenulls=True).over(sweep)
        swept = both.withColumn("last", last).where("is_url = 1").drop("is_url", "salt", "rule_host", "open")
        first = F.get(F.filter("last.open", lambda r: F.startswith(F.col("path"), r["path"])), 0)
        text = F.concat("last.rule_host", first["path"])
        rows = swept.withColumn(f"win{d}", F.when(first.isNotNull(), F.struct(-F.length(text), F.lit(-d), text.alias("rule"), first["verdict"].alias("verdict")))).drop("last")
        wins.append(f"win{d}")
    won = F.least(*wins) if len(wins) > 1 else F.col(wins[0]) if wins else F.lit(None).cast("struct<rule:string,verdict:string>")
    out = rows.withColumn("won", won)
    return out.select(*[F.col("row")[c].alias(c) for c in names], "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
