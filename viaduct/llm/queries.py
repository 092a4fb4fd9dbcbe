"""The registered queries over the driver's corpus tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm import bpe, curriculum, divergence, embed_dedup, html_extract, langid, packing, periodic, simhash, topk, toxicity, url_filter, warc
from viaduct.llm.common import read_table, running_sums


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


#: (host, path prefix, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_table(spark, URL_RULES)).drop("url")


def remainder(divisor: int) -> Column:
    """crc32 of the id's text, modulo ``divisor``; rows without an id count as held out."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").where(remainder(5) != 0))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder(4) != 2))
    return langid.identify(docs, model).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"), payloads=False).drop("intact")


#: Weights of the sources by code point, repeating.
MIX_WEIGHTS = (3.0, 1.0, 2.0)


def op11_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights fall to half of their mean in every other source and rise to it in the rest."""
    docs = read_table(spark, sf_dir, "documents")
    ranked = running_sums(docs.select("source").distinct(), [F.asc_nulls_last("source")], k=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, MIX_WEIGHTS)), (F.col("k_before") % len(MIX_WEIGHTS) + 1).cast("int"))
    turn = F.when(F.col("k_before") % 2 == 0, 0.5).otherwise(-0.5)
    knots = F.array(*[F.struct(F.lit(at).alias("at"), (weight * (1 + sign * turn)).alias("weight")) for at, sign in ((0.0, 1), (1.0, -1))])
    mixed = curriculum.mix(docs, ranked.select("source", knots.alias("knots")), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs, ["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("longest.start"), F.col("longest.length"), -F.col("longest.period")
    milli = F.floor(1000 * length / period)
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OP1_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM pairs
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM ranked WHERE k <= 5
"""

OP3_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c ON c.vec_id = e.vec_id
"""

OP5_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), rules(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT p.page_id, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM parts p JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rverdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), o AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS owner,
         list_transform([1, 11, 21, 31], lambda a: CAST('0x' || substr(h, a, 10) AS BIGINT)) AS parts FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(parts, lambda x: array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < owner THEN owner END AS refers_to
FROM o
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS left_over, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS among
  FROM s WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rate AS (
  SELECT left_over AS l, among AS a FROM o WHERE w * left_over <= cap * among ORDER BY cap / w, source NULLS FIRST LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(least(cap, w * (SELECT l FROM rate) / (SELECT a FROM rate)), cap) AS target FROM o
), m AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(size, whole - ahead)) + greatest(0, least(size, whole - ahead - source_size)) AS BIGINT) AS taken
FROM m
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), g AS (SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), c AS (
  SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term
), p AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 2)::HUGEINT // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM c
), l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL
), q AS (
  SELECT lang, term, 1 + 1000000000 * (n + 2)::HUGEINT // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM l
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(apart.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM (FROM pairs UNION ALL FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR k <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_simhash": op2_simhash,
    "op3_embed_dedup": op3_embed_dedup,
    "op4_bpe": op4_bpe,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_html": op8_html,
    "op9_langid": op9_langid,
    "op10_warc": op10_warc,
    "op11_curriculum": op11_curriculum,
    "op12_divergence": op12_divergence,
    "op13_runs": op13_runs,
}

ORACLE_SQL: dict[str, str] = {"op1_topk": OP1_SQL, "op3_embed_dedup": OP3_SQL, "op5_url_filter": OP5_SQL, "op10_warc": OP10_SQL, "op11_curriculum": OP11_SQL, "op12_divergence": OP12_SQL}
