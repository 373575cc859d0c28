"""The registered queries: thin forms of the operators that give the contracts' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode
from .common import table
from .exact_dedup import exact_dedup
from .filter_audit import audit
from .html_text import extract
from .katz import katz_scores
from .mixing import mix
from .mtree import top_k
from .repeats import periodic_runs
from .simhash import near_duplicates
from .token_counts import histogram, lengths
from .toxicity import fold, toxicity
from .url_filter import filter_urls, host_of
from .warc import read_records, write_bundles


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM w
"""


def token_digests(tokens: DataFrame, keep_ids: bool = False) -> DataFrame:
    """op3's columns, and the ids if asked for, from what encode(decoded=True) gives."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *([F.col("ids")] if keep_ids else []))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(encode(table(spark, sf_dir, "documents"), decoded=True))


def url_captures(pages: DataFrame) -> DataFrame:
    """pages have no fetch time; the query takes a day of 2024 by page_id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(366)).cast("int"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", day.alias("fetched"))


def url_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries made of the hosts and the urls of the table: by the digits of its md5, each may come onto a list in January to June and leave it 90 days later; two domains have fixed entries."""
    hosts = pages.select(F.lit("domain").alias("kind"), host_of(F.col("url")).alias("pattern")).where("pattern is not null").distinct()
    subjects = hosts.unionByName(pages.select(F.lit("url").alias("kind"), F.col("url").alias("pattern")).where("pattern is not null").distinct()).withColumn("h", F.md5(F.col("pattern").cast("binary")))
    digit = lambda k: F.conv(F.substring("h", k, 1), 16, 10).cast("int")
    at = F.date_add(F.lit("2024-01-01").cast("date"), digit(3) * 11)
    listed = subjects.select("kind", F.when(digit(1) < 5, "block").when(digit(1) < 7, "allow").alias("list"), "pattern", at.alias("at"), (digit(2) < 8).alias("leaves")).where("list is not null")
    added = listed.select("kind", "list", "pattern", F.lit("add").alias("action"), "at")
    removed = listed.where("leaves").select("kind", "list", "pattern", F.lit("remove").alias("action"), F.date_add("at", 90).alias("at"))
    fixed = pages.sparkSession.createDataFrame([("domain", "block", "example.org", "add", "2024-05-01"), ("domain", "block", "example.org", "remove", "2024-08-01"), ("domain", "block", "example.org", "add", "2024-11-01"), ("domain", "allow", "example.net", "add", "2024-10-01")], "kind string, list string, pattern string, action string, at string")
    return added.unionByName(removed).unionByName(fixed.withColumn("at", F.col("at").cast("date")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(url_captures(pages), url_entries(pages))


OP2_SQL = r"""
WITH c AS (
  SELECT page_id, DATE '2024-01-01' + CAST(coalesce(page_id, 0) % 366 AS INTEGER) AS fetched,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)', 1)), '\.+$', ''), '') AS host, url
  FROM pages),
h AS (
  SELECT DISTINCT 'domain' AS kind, host, md5(host) AS h FROM c WHERE host IS NOT NULL
  UNION ALL SELECT DISTINCT 'url', url, md5(url) FROM c WHERE url IS NOT NULL),
d AS (SELECT kind, host, strpos('0123456789abcdef', h[1]) - 1 AS d1, strpos('0123456789abcdef', h[2]) - 1 AS d2, strpos('0123456789abcdef', h[3]) - 1 AS d3 FROM h),
i AS (
  SELECT kind, host AS pattern, CASE WHEN d1 < 5 THEN 'block' ELSE 'allow' END AS list, DATE '2024-01-01' + CAST(d3 * 11 AS INTEGER) AS f,
         CASE WHEN d2 < 8 THEN DATE '2024-01-01' + CAST(d3 * 11 + 90 AS INTEGER) END AS t
  FROM d WHERE d1 < 7
  UNION ALL SELECT 'domain', 'example.org', 'block', DATE '2024-05-01', DATE '2024-08-01'
  UNION ALL SELECT 'domain', 'example.org', 'block', DATE '2024-11-01', NULL
  UNION ALL SELECT 'domain', 'example.net', 'allow', DATE '2024-10-01', NULL),
k AS (SELECT DISTINCT host, url, fetched FROM c),
m AS (
  SELECT k.host, k.url, k.fetched, count(*) FILTER (i.list = 'block') AS n_block, count(*) FILTER (i.list = 'allow') AS n_allow
  FROM k JOIN i ON (i.kind = 'domain' AND (k.host = i.pattern OR k.host LIKE '%.' || i.pattern) OR i.kind = 'url' AND k.url = i.pattern) AND k.fetched >= i.f AND (i.t IS NULL OR k.fetched < i.t)
  GROUP BY k.host, k.url, k.fetched)
SELECT page_id, c.host, CAST(coalesce(n_block, 0) AS BIGINT) AS n_block, CAST(coalesce(n_allow, 0) AS BIGINT) AS n_allow,
       CASE WHEN n_allow > 0 THEN 'allowed' WHEN n_block > 0 THEN 'blocked' ELSE 'unlisted' END AS verdict
FROM c LEFT JOIN m ON m.url = c.url AND m.fetched = c.fetched AND m.host IS NOT DISTINCT FROM c.host
"""

#: The mixture of op4: integer weights of each node among its siblings (one source gets nothing), half of all tokens, two epochs at most.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src7": 0}}


def source_domain() -> Column:
    """documents have no domain; the query takes the number in the source, modulo 4."""
    return F.concat(F.lit("d"), (F.regexp_extract("source", "^src([0-9]{1,9})$", 1).try_cast("int") % 4).cast("string"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), source_domain(), MIX_WEIGHTS, F.floor(F.col("total") / 2), max_epochs=2).drop("row_id")


def _fill_sql(nodes: str, parents: str, child: str, out: str) -> str:
    by = f"PARTITION BY {parents} " if parents else ""
    order = f"{by}ORDER BY capacity / weight, {child}"
    return f"""
{out}_1 AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM {nodes} WHERE weight > 0),
{out} AS (
  SELECT * EXCLUDE (level), CAST(greatest(0, coalesce(least(CAST(capacity AS DOUBLE), floor(weight * first_value(CASE WHEN capacity / weight > level THEN level END IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))), capacity)) AS BIGINT) AS granted
  FROM {out}_1)"""


OP4_SQL = (
    r"""
WITH r AS (
  SELECT doc_id, coalesce('d' || CAST(CAST(nullif(regexp_extract(source, '^src([0-9]{1,9})$', 1), '') AS INTEGER) % 4 AS VARCHAR), '-') AS domain,
         coalesce(lang, '-') AS lang, coalesce(source, '-') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS tokens,
         coalesce(CAST(doc_id AS VARCHAR), '-' || md5(coalesce(text, ''))) AS drawn_by
  FROM documents),
l AS (SELECT domain, lang, source, CAST(sum(r.tokens) AS BIGINT) AS tokens, CAST(sum(CASE WHEN source = 'src7' THEN 0 ELSE r.tokens END) AS BIGINT) AS able FROM r GROUP BY ALL),
n1 AS (
  SELECT domain, CAST(sum(able) * 2 AS BIGINT) AS capacity, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS weight,
         CAST(floor(sum(sum(tokens)) OVER () / 2) AS BIGINT) AS budget
  FROM l GROUP BY domain),"""
    + _fill_sql("n1", "", "domain", "g1")
    + """,
n2 AS (
  SELECT l.domain, l.lang, CAST(sum(able) * 2 AS BIGINT) AS capacity, CASE l.lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight, any_value(g1.granted) AS budget
  FROM l JOIN g1 USING (domain) GROUP BY l.domain, l.lang),"""
    + _fill_sql("n2", "domain", "lang", "g2")
    + """,
n3 AS (SELECT l.domain, l.lang, l.source, l.tokens AS leaf_tokens, able * 2 AS capacity, CASE WHEN l.source = 'src7' THEN 0 ELSE 1 END AS weight, g2.granted AS budget FROM l JOIN g2 USING (domain, lang)),"""
    + _fill_sql("n3", "domain, lang", "source", "g3")
    + """,
b AS (SELECT l.domain, l.lang, l.source, l.tokens AS leaf_tokens, coalesce(g3.granted, 0) AS granted FROM l LEFT JOIN g3 USING (domain, lang, source)),
e AS (
  SELECT r.*, b.granted AS leaf_budget, CASE WHEN leaf_tokens > 0 THEN CAST(granted // leaf_tokens AS BIGINT) ELSE 0 END AS epochs, b.leaf_tokens
  FROM r JOIN b USING (domain, lang, source)),
k AS (SELECT *, leaf_budget - epochs * leaf_tokens AS remain, md5('17:' || epochs || ':' || drawn_by) AS draw FROM e),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY draw, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, domain, lang, source, tokens, CAST(leaf_budget AS BIGINT) AS leaf_budget, CAST(epochs + CASE WHEN remain > 0 AND upto <= remain THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM u
"""
)


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"), held_out=fold(F.col("doc_id"), 7) == 2)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=2).select("doc_id", "fingerprint", "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(table(spark, sf_dir, "documents")))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=10, is_query=F.col("vec_id") % 100 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_bundles(table(spark, sf_dir, "pages")), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM p
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(coalesce(doc_id, 9223372036854775807) > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS BIGINT)) AS good, max(CAST(toxic = 1 AS BIGINT)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, CAST(a AS INTEGER) + 2 * CAST(b AS INTEGER) + 4 * CAST(c AS INTEGER) + 8 * CAST(d AS INTEGER) + 16 * CAST(e AS INTEGER) AS mask,
         count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT k, 1 << k AS bit, substr('ABCDE', k + 1, 1) AS letter FROM (SELECT unnest(range(5))::INTEGER AS k)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)),
r AS (SELECT part, filter_order, step, s.bit, n, good, toxic, mask & s.bit <> 0 AS fails, mask & before <> 0 AS gone, mask = s.bit AS alone FROM m, s),
t AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant,
         sum(n) FILTER (alone) AS unique_fails, sum(good) FILTER (fails AND NOT gone) AS good_lost, sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (coalesce(sum(removed) OVER (PARTITION BY part, bit), 0))::BIGINT AS shapley
FROM t
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_katz": op5_katz,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_top_k": op8_top_k,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_html_text": op11_html_text,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op2_url_filters": OP2_SQL, "op4_mixing": OP4_SQL, "op8_top_k": OP8_SQL, "op9_warc": OP9_SQL, "op13_filter_audit": OP13_SQL}
