"""Registered queries over the benchmark tables, and the SQL that must agree.

Every query runs an operator of this library over whole tables; the tables stand in for
the news tables (events for documents in time, line items for links, pages for addresses,
embeddings for title vectors). Doubles are rounded at the output edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text, times, urls
from newsloom.operators import attention, evaluation, families, filters, partition, postings, ranking, responses, similarity, vectors
from newsloom.operators.components import connected_components
from newsloom.plans import explorer, ingest, prototypes, search, serving
from newsloom.plans.cutpoint import materialize, release

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: str | Column, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _time(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz").alias(c)


def _joined(c: Column, sep: str = "|") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as documents: type for story, user for outlet, group of users for country."""
    return _t(spark, d, "events").select(
        "event_type", F.concat(F.lit("G"), (F.col("user_id") % 8).cast("string")).alias("publisher_country"), F.col("ts").cast("timestamp").alias("observed_time"),
        F.col("user_id").alias("source_domain"), F.col("user_id").alias("domain"), F.get_json_object("props", "$.k").alias("wire_group"), F.col("event_id").alias("document_id"),
        "value", F.lit(1.0).alias("publisher_country_confidence"), F.lit(True).alias("is_primary"),
    )


_DOCS = """docs AS (SELECT event_type, 'G' || (user_id % 8)::VARCHAR AS publisher_country, ts AS observed_time, user_id AS source_domain,
  json_extract_string(props, '$.k') AS wire_group, event_id AS document_id, value FROM events)"""


def _onset_sql(name: str, keys: str, src: str = "docs") -> str:
    """CTEs ending in ``name``: keys, third_source_seen, p10_seen, onset."""
    return f"""
{name}_h AS (SELECT {keys}, source_domain, date_trunc('hour', observed_time) AS b FROM {src}),
{name}_f AS (SELECT {keys}, source_domain, min(b) AS m FROM {name}_h GROUP BY ALL),
{name}_k AS (SELECT {keys}, m, row_number() OVER (PARTITION BY {keys} ORDER BY m, source_domain) AS k FROM {name}_f),
{name}_q AS (SELECT {keys}, list_sort(list(b)) AS l FROM {name}_h GROUP BY ALL),
{name} AS (SELECT {keys}, m AS third_source_seen, l[ceil(0.1 * (len(l) - 1))::INT + 1] AS p10_seen, greatest(m, l[ceil(0.1 * (len(l) - 1))::INT + 1]) AS onset
  FROM {name}_k JOIN {name}_q USING ({keys}) WHERE k = 3)"""


def _country_sql(key: str, src: str = "docs") -> str:
    """CTEs: base, hourly, summary, as the country tables have them."""
    k = f"{key}, publisher_country"
    return f"""{_onset_sql("own", k, src)},{_onset_sql("world", key, src)},
base AS (SELECT publisher_country, count(*) AS country_documents, count(DISTINCT source_domain) AS country_domains, count(DISTINCT wire_group) AS country_effective_reports FROM {src} GROUP BY 1),
totals AS (SELECT {key}, count(*) AS event_documents, count(DISTINCT wire_group) AS event_effective_reports FROM {src} GROUP BY 1),
everything AS (SELECT count(*) AS d, count(DISTINCT wire_group) AS r FROM {src}),
hours AS (SELECT {k}, date_trunc('hour', observed_time) AS time_bucket, count(*) AS raw_documents, count(DISTINCT source_domain) AS unique_domains, count(DISTINCT wire_group) AS effective_reports FROM {src} GROUP BY ALL),
hourly AS (SELECT h.*, sum(raw_documents) OVER (PARTITION BY {", ".join("h." + x.strip() for x in k.split(","))} ORDER BY time_bucket)::BIGINT AS cumulative_documents,
  raw_documents / country_documents AS raw_share, coalesce(time_bucket = onset, false) AS onset_flag FROM hours h JOIN base USING (publisher_country) LEFT JOIN own USING ({k})),
groups AS (SELECT {k}, count(*) AS raw_documents, count(DISTINCT source_domain) AS unique_domains, count(DISTINCT wire_group) AS effective_reports, min(observed_time) AS first_seen, max(observed_time) AS last_seen FROM {src} GROUP BY ALL),
summary AS (SELECT g.*, own.onset, world.onset AS world_onset, raw_documents / country_documents AS raw_share, effective_reports / country_effective_reports AS effective_share,
  event_documents / d AS world_raw_share, event_effective_reports / r AS world_effective_share, (effective_reports / country_effective_reports) / (event_effective_reports / r) AS attention_ratio,
  trunc((epoch_us(own.onset) - epoch_us(world.onset)) / 60000000) / 60.0 AS lag_hours, unique_domains < 3 AS suppressed
  FROM groups g JOIN base USING (publisher_country) JOIN totals USING ({key}) CROSS JOIN everything LEFT JOIN own USING ({k}) LEFT JOIN world USING ({key}))"""


# ---------------------------------------------------------------- onset and attention


@query(f"WITH {_DOCS},{_onset_sql('o', 'event_type')} SELECT * FROM o")
def onset_by_type(spark: SparkSession, d: str) -> DataFrame:
    found = attention.onset(_stream(spark, d), ["event_type"])
    return found.select("event_type", *[_time(c) for c in ("third_source_seen", "p10_seen", "onset")])


def _countries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _stream(spark, d)
    total = docs.agg(F.count("*").alias("d"), F.count_distinct("wire_group").alias("r")).first()
    return attention.country_tables(docs, attention.country_baseline(docs), total["d"], total["r"], "event_type")


@query(f"""WITH {_DOCS},{_country_sql('event_type')} SELECT event_type, publisher_country, raw_documents, unique_domains, effective_reports, first_seen, last_seen, onset, world_onset,
  round(raw_share, 6) AS raw_share, round(effective_share, 6) AS effective_share, round(world_raw_share, 6) AS world_raw_share, round(world_effective_share, 6) AS world_effective_share,
  round(attention_ratio, 6) AS attention_ratio, round(lag_hours, 6) AS lag_hours, suppressed FROM summary""")
def country_summary(spark: SparkSession, d: str) -> DataFrame:
    doubles = ["raw_share", "effective_share", "world_raw_share", "world_effective_share", "attention_ratio", "lag_hours"]
    return _countries(spark, d)[1].select(
        "event_type", "publisher_country", "raw_documents", "unique_domains", "effective_reports", *[_time(c) for c in ("first_seen", "last_seen", "onset", "world_onset")],
        *[_r(c).alias(c) for c in doubles], "suppressed",
    )


@query(f"WITH {_DOCS},{_country_sql('event_type')} SELECT event_type, publisher_country, onset, world_onset, round(lag_hours, 6) AS lag_hours, suppressed FROM summary")
def onset_by_type_user_group(spark: SparkSession, d: str) -> DataFrame:
    return _countries(spark, d)[1].select("event_type", "publisher_country", _time("onset"), _time("world_onset"), _r("lag_hours").alias("lag_hours"), "suppressed")


@query(f"WITH {_DOCS},{_country_sql('event_type')} SELECT event_type, publisher_country, round(effective_share, 6) AS effective_share, round(world_effective_share, 6) AS world_effective_share, round(attention_ratio, 6) AS attention_ratio FROM summary")
def attention_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _countries(spark, d)[1].select("event_type", "publisher_country", *[_r(c).alias(c) for c in ("effective_share", "world_effective_share", "attention_ratio")])


@query(f"WITH {_DOCS},{_country_sql('event_type')} SELECT * REPLACE (round(raw_share, 6) AS raw_share) FROM hourly")
def hourly_attention(spark: SparkSession, d: str) -> DataFrame:
    return _countries(spark, d)[0].withColumns({"time_bucket": _time("time_bucket"), "raw_share": _r("raw_share")})


@query(f"WITH {_DOCS} SELECT publisher_country, count(*) AS country_documents, count(DISTINCT source_domain) AS country_domains, count(DISTINCT wire_group) AS country_effective_reports FROM docs GROUP BY 1")
def country_baseline(spark: SparkSession, d: str) -> DataFrame:
    return attention.country_baseline(_stream(spark, d))


@query(f"""WITH {_DOCS},{_country_sql('event_type')} SELECT event_type, publisher_country, string_agg(strftime(time_bucket, '%Y-%m-%d %H'), '|' ORDER BY time_bucket) AS time_buckets,
  string_agg(raw_documents::VARCHAR, '|' ORDER BY time_bucket) AS "values", string_agg(cumulative_documents::VARCHAR, '|' ORDER BY time_bucket) AS cumulative_documents,
  sum(raw_documents)::BIGINT AS total_documents FROM hourly WHERE event_type = 'purchase' GROUP BY ALL""")
def timeline_arrays(spark: SparkSession, d: str) -> DataFrame:
    _, series = serving.timeline(_countries(spark, d)[0].where("event_type = 'purchase'"), [])
    stamps = F.array_join(F.transform("time_bucket", lambda t: F.date_format(t, "yyyy-MM-dd HH")), "|")
    return series.select(F.lit("purchase").alias("event_type"), "publisher_country", stamps.alias("time_buckets"), _joined(F.col("values")).alias("values"), _joined(F.col("cumulative_documents")).alias("cumulative_documents"), "total_documents")


@query(f"WITH {_DOCS},{_country_sql('event_type')} SELECT time_bucket, sum(raw_documents)::BIGINT AS raw_documents, sum(unique_domains)::BIGINT AS unique_domains, sum(effective_reports)::BIGINT AS effective_reports FROM hourly WHERE publisher_country IN ('G1', 'G3') GROUP BY 1")
def timeline_world(spark: SparkSession, d: str) -> DataFrame:
    world, _ = serving.timeline(_countries(spark, d)[0], serving.code_list("g1, G3,g1"))
    return world.withColumn("time_bucket", _time("time_bucket"))


@query("""WITH w AS (SELECT date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM events), g AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS bucket FROM w),
m AS (SELECT date_trunc('day', ts) AS bucket, count(*) FILTER (event_type = 'click') AS matched, count(*) AS total FROM events GROUP BY 1)
SELECT bucket, coalesce(matched, 0) AS matched, coalesce(total, 0) AS total, CASE WHEN coalesce(total, 0) > 0 THEN round(100 * matched / total, 6) ELSE 0.0 END AS intensity FROM g LEFT JOIN m USING (bucket)""")
def timeline_grid(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("seendate", F.col("ts").cast("timestamp"))
    since, to = e.agg(F.min("seendate"), F.max("seendate")).first()
    size = times.bucket_size(to - since)
    return explorer.timeline_volume(e.where("event_type = 'click'"), e, times.grid(spark, since, to, size), size).withColumn("bucket", _time("bucket"))


@query("""WITH w AS (SELECT date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM events), g AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS bucket FROM w),
m AS (SELECT date_trunc('day', ts) AS bucket, round(avg(value), 4) AS tone FROM events WHERE event_type = 'error' GROUP BY 1) SELECT bucket, coalesce(tone, 0.0) AS tone FROM g LEFT JOIN m USING (bucket)""")
def timeline_tone(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("seendate", F.col("ts").cast("timestamp"))
    since, to = e.agg(F.min("seendate"), F.max("seendate")).first()
    size = times.bucket_size(to - since)
    return explorer.timeline_tone(e.where("event_type = 'error'"), times.grid(spark, since, to, size), size, tone="value").withColumn("bucket", _time("bucket"))


@query("""WITH b AS (SELECT c_custkey, (floor(floor(least(greatest(coalesce(c_acctbal / 250, 0.0), -20.0), 20.0)) / 2) * 2)::BIGINT AS bin, c_acctbal FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY c_acctbal DESC, c_custkey) AS r FROM b)
SELECT bin, count(*) AS "count", string_agg(c_custkey::VARCHAR, '|' ORDER BY r) FILTER (r <= 10) AS top FROM r GROUP BY 1""")
def tone_bins(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").withColumn("tone", F.col("c_acctbal") / 250)
    return explorer.tone_chart(c, "tone", [F.desc_nulls_last("c_acctbal"), "c_custkey"], 10, "c_custkey").withColumn("top", _joined(F.col("top")))


@query("SELECT date_part('hour', ts)::INT AS hour, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def pivot_hours(spark: SparkSession, d: str) -> DataFrame:
    """With the columns named, one pass; nothing has to be looked up first."""
    e = _t(spark, d, "events").withColumn("hour", F.hour("ts"))
    return e.groupBy("hour").pivot("event_type", ["click", "purchase", "view"]).count().fillna(0)


@query(f"""WITH {_DOCS}, k AS (SELECT * FROM docs WHERE event_type = 'purchase'), c AS (SELECT publisher_country, count(*) AS raw_documents, count(DISTINCT wire_group) AS effective_reports, min(observed_time) AS first_seen FROM k GROUP BY 1)
SELECT document_id, k.publisher_country, observed_time, raw_documents, effective_reports, first_seen FROM k JOIN c USING (publisher_country) ORDER BY observed_time, document_id LIMIT 50 OFFSET 100""")
def spread_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of 50 after 100: the limit is the feature."""
    docs, countries, _ = serving.spread(_stream(spark, d).where("event_type = 'purchase'"), 0.5, 100, 50)
    return docs.select("document_id", "publisher_country", _time("observed_time")).join(countries.withColumn("first_seen", _time("first_seen")), "publisher_country")


@query("""WITH d AS (SELECT event_type AS feature, user_id, date_trunc('day', ts) AS day FROM events), u AS (SELECT feature, day, count(DISTINCT user_id) AS len FROM d GROUP BY 1, 2),
p AS (SELECT *, len / sum(len) OVER (PARTITION BY feature) AS p FROM u)
SELECT feature, sum(len)::BIGINT AS n, round(-sum(p * ln(p)) / ln(greatest(count(*), 2)), 6) AS entropy, -sum(p * ln(p)) / ln(greatest(count(*), 2)) >= 0.95 AND sum(len) >= 100 AS steady FROM p GROUP BY 1""")
def burst_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select(F.col("event_type").alias("feature"), "user_id", "ts")
    return filters.bursty(rows, "feature", "user_id", F.date_trunc("day", F.col("ts").cast("timestamp"))).withColumn("entropy", _r("entropy"))


# ---------------------------------------------------------------- addresses and titles

_CANON = r"""canon AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 1) AS s, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^@/?#]*@)?([^/:?#]*)', 1)), '^www\.', '') AS host,
  CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END AS path,
  array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND NOT lower(split_part(p, '=', 1)) IN ('fbclid', 'gclid', 'ref', 'source', 'cmp', 'ncid', 'ito', 'mc_cid', 'mc_eid')), '&') AS q FROM pages),
urls AS (SELECT page_id, url, host, lower(s) || '://' || host || CASE WHEN len(path) > 1 THEN rtrim(path, '/') ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical_url, lower(path) AS path FROM canon)"""


@query(f"WITH {_CANON}, r AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY page_id) AS r, count(*) OVER (PARTITION BY canonical_url) AS n FROM urls) SELECT canonical_url, host AS domain, page_id, n FROM r WHERE r = 1")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"), urls.url_domain(F.col("url")).alias("domain"))
    counted = p.withColumn("n", F.count("*").over(W.partitionBy("canonical_url")))
    return ranking.first_per_key(counted, ["canonical_url"], ["page_id"]).select("canonical_url", "domain", "page_id", "n")


@query(f"WITH {_CANON} SELECT canonical_url, page_id, row_number() OVER (ORDER BY canonical_url, page_id) - 1 AS document_id FROM urls")
def document_ids(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))
    return ranking.dense_ids(p, ["canonical_url", "page_id"], "document_id").select("canonical_url", "page_id", "document_id")


def _stop() -> str:
    from newsloom.functions.fixed import STOPWORDS

    return ", ".join(f"'{w}'" for w in STOPWORDS)


_WORDS = rf"""{_CANON}, tokens AS (SELECT page_id, host, unnest(list_distinct(regexp_extract_all(regexp_replace(path, '/(\d{{1,2}}|(19|20)\d{{2}})/', '//', 'g'), '[\p{{L}}\p{{N}}]+'))) AS w FROM urls),
words AS (SELECT * FROM tokens WHERE len(w) >= 2 AND w NOT IN ({_stop()}) AND NOT (regexp_full_match(w, '\d+') AND len(w) >= 5))"""


@query(rf"WITH {_WORDS} SELECT w AS word, count(*) AS df, NOT (regexp_matches(w, '^[0-9a-f]+$') AND regexp_matches(w, '\d') AND regexp_matches(w, '[a-f]')) AND (NOT regexp_full_match(w, '\d+') OR len(w) = 3) AS clean FROM words GROUP BY 1")
def url_words(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "pages").select("page_id", F.explode(urls.url_words(urls.slug_path(F.col("url")))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("df")).withColumn("clean", urls.clean_token(F.col("word")))


@query(rf"""WITH {_WORDS}, docs AS (SELECT host, count(DISTINCT page_id) AS docs FROM words WHERE host <> '' GROUP BY 1 HAVING count(DISTINCT page_id) >= 5)
SELECT host AS domain, w AS word, count(DISTINCT page_id) AS n, round(count(DISTINCT page_id) / docs, 6) AS share FROM words JOIN docs USING (host) GROUP BY host, w, docs HAVING count(DISTINCT page_id) / docs >= 0.2""")
def host_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "pages").select("page_id", urls.url_domain(F.col("url")).alias("domain"), F.explode(urls.url_words(urls.slug_path(F.col("url")))).alias("word"))
    return filters.host_boilerplate(rows, "domain", "word", "page_id", 5, 0.2).withColumn("share", _r("share"))


@query(r"""WITH t AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)) AS host, list_filter(string_split(split_part(split_part(regexp_replace(url, '^https?://[^/]+/?', ''), '?', 1), '#', 1), '/'), lambda x: x <> '') AS s FROM pages),
u AS (SELECT *, CASE WHEN regexp_matches(coalesce(s[-1], ''), '[A-Za-z]{3}') THEN s[-1] WHEN regexp_matches(coalesce(s[-2], ''), '[A-Za-z]{3}') THEN s[-2] ELSE '' END AS tail FROM t),
v AS (SELECT page_id, regexp_replace(host, '^www\.', '') AS host, trim(regexp_replace(regexp_replace(tail, '\.(html?|shtml|phtml|php|aspx?|jsp|cms|amp)$', ''), '[^A-Za-z0-9]+', ' ', 'g')) AS w FROM u)
SELECT page_id, CASE WHEN len(w) < 3 THEN host || ' article' ELSE w END AS title FROM v""")
def derived_titles(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", urls.derived_title(F.col("url"), urls.url_domain(F.col("url"))).alias("title"))


_TITLES = r"""titles AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '^www\.', '') AS domain, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
keyed AS (SELECT *, trim(regexp_replace(regexp_replace(lower(title), '\s+[-|–—:]\s+[^-|–—:]{1,60}$', ''), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM titles)"""


def _titled(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages")
    return p.select("page_id", "url", urls.url_domain(F.col("url")).alias("domain"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))


@query(f"WITH {_TITLES}, g AS (SELECT *, CASE WHEN len(key) >= 15 THEN 't:' || key ELSE 'u:' || url END AS wire FROM keyed) SELECT min(page_id) AS first_page, count(*) AS raw_documents, count(DISTINCT domain) AS unique_domains FROM g GROUP BY wire")
def wire_groups(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    key = text.wire_key(F.col("title"), F.lit(False), none, none, none, F.col("url"))
    g = _titled(spark, d).withColumn("wire", F.xxhash64(key))
    return g.groupBy("wire").agg(F.min("page_id").alias("first_page"), F.count("*").alias("raw_documents"), F.count_distinct("domain").alias("unique_domains")).drop("wire")


@query(f"WITH {_TITLES} SELECT page_id, title FROM (SELECT *, count(*) OVER (PARTITION BY domain, title) AS n FROM titles) WHERE n >= 2")
def boilerplate_titles(spark: SparkSession, d: str) -> DataFrame:
    return filters.boilerplate_titles(_titled(spark, d), repeats=2).select("page_id", "title")


# ---------------------------------------------------------------- joins and aggregates


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS has_document, coalesce(quality, -1)::INT AS quality, least(n_chars, quality * 1000) AS low, greatest(n_chars, quality * 1000) AS high,
  CASE WHEN coalesce(toxic, 0) = 1 THEN lang ELSE 'eng' END AS language FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def full_outer_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "n_chars", "lang", F.lit(True).alias("has_document"))
    both = docs.join(_t(spark, d, "labels"), ["doc_id"], "full")
    q = F.col("quality").cast("long") * 1000
    lang = text.document_language(F.coalesce("toxic", F.lit(0)) == 1, F.col("lang"))
    return both.select("doc_id", F.coalesce("has_document", F.lit(False)).alias("has_document"), F.coalesce("quality", F.lit(-1)).alias("quality"), F.least("n_chars", q).alias("low"), F.greatest("n_chars", q).alias("high"), lang.alias("language"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'N' || s_nationkey WHEN s_suppkey % 4 = 1 THEN 'N' || s_nationkey WHEN s_suppkey % 4 = 2 THEN 'GM' END AS publisher_country,
  CASE s_suppkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS country_confidence, CASE s_suppkey % 4 WHEN 0 THEN 'gdelt_lookup' WHEN 1 THEN 'gdelt_lookup_parent' WHEN 2 THEN 'cctld' ELSE 'unresolved' END AS mapping_method FROM supplier""")
def country_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as domains, a quarter on each rung: listed, below a listed one, national, neither."""
    s = _t(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    base = F.concat(F.lit("s"), k, F.lit(".example.com"))
    rung = F.col("s_suppkey") % 4
    domain = F.when(rung == 0, base).when(rung == 1, F.concat(F.lit("news."), base)).when(rung == 2, F.concat(F.lit("s"), k, F.lit(".de"))).otherwise(F.concat(F.lit("s"), k, F.lit(".io")))
    lookup = s.where(rung < 2).select(base.alias("domain"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("country"))
    return ingest.resolve_countries(s.select("s_suppkey", domain.alias("domain")), lookup).drop("domain")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent FROM customer")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select("c_custkey")
    urgent = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return c.join(urgent, "c_custkey", "left_semi").withColumn("urgent", F.lit(True)).unionByName(filters.without(c, urgent, "c_custkey").withColumn("urgent", F.lit(False)))


@query("SELECT n_nationkey, count(c_custkey) FILTER (c_acctbal > 9000) AS rich, round(coalesce(count(c_custkey) FILTER (c_acctbal > 9000), 0) / greatest(count(c_custkey), 1), 6) AS share FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def right_join_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    rich = c.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("rich"))
    sizes = _t(spark, d, "nation").join(c.groupBy("c_nationkey").agg(F.count("*").alias("n")), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "n")
    out = rich.join(sizes, F.col("c_nationkey") == F.col("n_nationkey"), "right")
    return out.select("n_nationkey", F.coalesce("rich", F.lit(0)).alias("rich"), _r(F.coalesce("rich", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("share"))


@query("SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def publisher_mode(spark: SparkSession, d: str) -> DataFrame:
    return ranking.mode_per_key(_t(spark, d, "documents"), ["source"], "lang", "lang")


@query("""WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS theme FROM part), n AS (SELECT count(*) AS n FROM part)
SELECT theme, count(*) AS theme_document_count, round(ln(n + 1) - ln(count(*) + 1), 6) AS idf FROM w, n GROUP BY theme, n""")
def theme_idf(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select("p_partkey", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("themes"))
    return similarity.theme_idf(p, has=None).withColumn("idf", _r("idf"))


@query("""WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS theme FROM part), n AS (SELECT count(*) AS n FROM part), i AS (SELECT theme, round(ln(n + 1) - ln(count(*) + 1), 6) AS idf FROM w, n GROUP BY theme, n),
c AS (SELECT l_suppkey, theme, round(count(*) * idf, 6) AS weight FROM lineitem JOIN w ON l_partkey = p_partkey JOIN i USING (theme) GROUP BY 1, 2, idf), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, theme) AS r FROM c)
SELECT l_suppkey, string_agg(theme, '|' ORDER BY r) AS top_themes, round(sum(weight), 4) AS weight FROM r WHERE r <= 10 GROUP BY 1""")
def weighted_themes(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select("p_partkey", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("themes"))
    idf = similarity.theme_idf(p, has=None).select("theme", _r("idf").alias("idf"))
    rows = _t(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).join(p, "p_partkey").select("l_suppkey", F.explode("themes").alias("theme"))
    weighed = rows.groupBy("l_suppkey", "theme").agg(F.count("*").alias("n")).join(idf, "theme").withColumn("weight", _r(F.col("n") * F.col("idf")))
    top = ranking.gathered(ranking.top_per_key(weighed, ["l_suppkey"], [F.desc("weight"), "theme"], 10, "r"), ["l_suppkey"], F.struct("theme", "weight"), "t")
    return top.select("l_suppkey", F.array_join("t.theme", "|").alias("top_themes"), F.round(F.aggregate("t.weight", F.lit(0.0), lambda a, x: a + x), 4).alias("weight"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS cluster, l_orderkey, l_partkey AS entity FROM lineitem), c AS (SELECT cluster, entity, count(*) AS n FROM e GROUP BY 1, 2),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, entity) AS r FROM c) WHERE r <= 3), s AS (SELECT l_suppkey AS cluster, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1),
v AS (SELECT cluster, count(DISTINCT l_orderkey) AS c FROM e JOIN t USING (cluster, entity) GROUP BY 1) SELECT cluster, round(coalesce(c, 0) / s.n, 6) AS entity_coherence FROM s LEFT JOIN v USING (cluster)""")
def entity_coherence(spark: SparkSession, d: str) -> DataFrame:
    members = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cluster"), F.col("l_orderkey").alias("document_id")).agg(F.collect_set("l_partkey").alias("entities"))
    return attention.entity_coherence(members, entities=F.col("entities")).withColumn("entity_coherence", _r("entity_coherence"))


@query("""WITH s AS (SELECT l_suppkey AS cluster, l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, value) AS r FROM s)
SELECT cluster, string_agg(value::VARCHAR, '|' ORDER BY r) AS parts FROM r WHERE r <= 5 GROUP BY 1""")
def top_list(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.array("l_partkey").alias("parts"))
    return ranking.top_list(rows, "cluster", "parts", 5).withColumn("parts", _joined(F.col("parts")))


@query("""SELECT o_custkey AS family_id, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_totalprice DESC, o_orderkey) AS macro_event_ids, arg_max(o_orderpriority, (o_totalprice, -o_orderkey)) AS title, arg_max(o_orderstatus, (o_totalprice, -o_orderkey)) AS label,
  count(*) AS incident_count, round(sum(o_totalprice), 2) AS effective_reports, min(o_orderdate) AS start_time, max(o_orderdate) AS end_time FROM orders GROUP BY 1""")
def families_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(
        F.col("o_custkey").alias("family_id"), F.col("o_orderkey").alias("macro_event_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("label"),
        F.lit(1).alias("raw_documents"), F.col("o_totalprice").alias("effective_reports"), F.col("o_orderdate").alias("start_time"), F.col("o_orderdate").alias("end_time"),
    )
    return families.rollup(o).drop("raw_documents").withColumns({"macro_event_ids": _joined(F.col("macro_event_ids")), "effective_reports": _r("effective_reports", 2)})


@query("""WITH c AS (SELECT 'c_custkey' AS "column", count(*) AS rows, count(*) FILTER (c_custkey IS NULL) AS nulls, count(DISTINCT c_custkey) AS "distinct" FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(*) FILTER (c_nationkey IS NULL), count(DISTINCT c_nationkey) FROM customer
UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (c_mktsegment IS NULL), count(DISTINCT c_mktsegment) FROM customer) SELECT "column", rows, nulls, nulls / greatest(rows, 1) AS null_rate, "distinct" FROM c""")
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return filters.audit(_t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('2026:' || o_orderkey), o_orderkey LIMIT 100")
def sample_hash(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 100: the limit is the feature."""
    return ranking.hash_sample(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 100)


@query("SELECT l_orderkey AS document, min(l_orderkey) OVER (PARTITION BY CASE WHEN len(s) >= 2 THEN s::VARCHAR ELSE 'd' || l_orderkey END) AS canonical FROM (SELECT l_orderkey, list_sort(list(DISTINCT (l_partkey, l_returnflag))) AS s FROM lineitem GROUP BY 1)")
def wire_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return similarity.wire_fingerprints(_t(spark, d, "lineitem"), "l_orderkey", ["l_partkey", "l_returnflag"])


@query("""WITH n AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), k AS (SELECT l.* FROM lineitem l JOIN n USING (l_orderkey) WHERE n <= 5 AND l_quantity >= 10),
r AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 35 AND date_diff('day', min(l_shipdate), max(l_shipdate)) >= 2)
SELECT l_orderkey, l_partkey, count(*) AS n FROM k WHERE l_partkey NOT IN (SELECT l_partkey FROM r) GROUP BY 1, 2""")
def roundup_filter(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    kept = filters.without_roundups(li, "l_orderkey", "l_partkey", 5, "l_quantity", 10)
    often = filters.recurring_events(li, "l_orderkey", "l_partkey", "l_shipdate", 35, 2)
    return filters.without(kept, often, "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sparse similarity


def _bipartite(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("feature")).distinct()


_TFIDF = """rows AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS feature FROM lineitem), alln AS (SELECT count(*) AS n FROM orders),
idf AS (SELECT feature, ln((n + 1) / (count(*) + 1)) + 1 AS w FROM rows, alln GROUP BY feature, n HAVING count(*) <= 2000),
weights AS (SELECT node, feature, w / sqrt(sum(w * w) OVER (PARTITION BY node)) AS weight FROM rows JOIN idf USING (feature)),
cosine AS (SELECT a.node AS "left", b.node AS "right", round(sum(a.weight * b.weight), 9) AS score FROM weights a JOIN weights b ON a.feature = b.feature AND a.node < b.node GROUP BY 1, 2),
sides AS (SELECT "left" AS node, "right" AS neighbor, score FROM cosine UNION ALL SELECT "right", "left", score FROM cosine),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, neighbor) AS rank FROM sides) WHERE rank <= 5)"""


@query(f"WITH {_TFIDF} SELECT node, count(*) AS features, round(sum(weight * weight), 6) AS length, round(max(weight), 6) AS largest FROM weights GROUP BY 1")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    w = similarity.tfidf(_bipartite(spark, d), _t(spark, d, "orders"))
    return w.groupBy("node").agg(F.count("*").alias("features"), _r(F.sum(F.col("weight") * F.col("weight"))).alias("length"), _r(F.max("weight")).alias("largest"))


@query("SELECT sum(df * (df - 1) / 2)::BIGINT AS contributions FROM (SELECT count(DISTINCT l_orderkey) AS df FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) <= 2000)")
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    return similarity.fan_out(_bipartite(spark, d))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    """A written table: both sides of the join read it, and the scores after that."""
    return materialize(postings.by_node(similarity.tfidf(_bipartite(spark, d), _t(spark, d, "orders"), keep_df=True)), "weights")


def _near(weights: DataFrame) -> DataFrame:
    return postings.nearest_cosine(weights, 5)


@query(f"WITH {_TFIDF} SELECT node, neighbor, score, rank::INT AS rank FROM near")
def tfidf_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _near(_weights(spark, d))


_UNION = f"""{_TFIDF}, second AS (SELECT DISTINCT a.l_orderkey AS "left", b.l_orderkey AS "right" FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND a.l_quantity = b.l_quantity AND a.l_shipdate = b.l_shipdate AND a.l_orderkey < b.l_orderkey),
proposed AS (SELECT least(node, neighbor) AS "left", greatest(node, neighbor) AS "right", 'event' AS c FROM near UNION ALL SELECT "left", "right", 'url' FROM second),
pairs AS (SELECT "left", "right", bool_or(c = 'event') AS from_event, bool_or(c = 'url') AS from_url FROM proposed GROUP BY 1, 2),
timed AS (SELECT p.*, abs(date_diff('second', a.o_orderdate, b.o_orderdate)) / 3600.0 AS delta_hours FROM pairs p JOIN orders a ON a.o_orderkey = "left" JOIN orders b ON b.o_orderkey = "right" WHERE abs(date_diff('second', a.o_orderdate, b.o_orderdate)) / 3600.0 <= 2400)"""


def _candidates(spark: SparkSession, d: str, weights: DataFrame) -> DataFrame:
    """Each step is written and its input dropped, so that no two steps' shuffles lie on disk together."""
    near = materialize(_near(weights).select(F.col("node").alias("left"), F.col("neighbor").alias("right")), "near")
    li = _t(spark, d, "lineitem")
    a = li.select(F.col("l_orderkey").alias("left"), "l_suppkey", "l_quantity", "l_shipdate")
    b = li.select(F.col("l_orderkey").alias("right"), "l_suppkey", "l_quantity", "l_shipdate")
    second = a.join(b, ["l_suppkey", "l_quantity", "l_shipdate"]).where("left < right").select("left", "right").distinct()
    proposed = similarity.candidate_union({"event": near, "url": materialize(second, "second")})
    proposed = materialize(proposed, "proposed")
    release(near)
    return similarity.within_hours(proposed, _t(spark, d, "orders"), 2400, "o_orderkey", "o_orderdate")


@query(f'WITH {_UNION} SELECT "left", "right", from_event, from_url, round(delta_hours, 6) AS delta_hours FROM timed')
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    weights = _weights(spark, d)
    timed = _candidates(spark, d, weights).withColumn("delta_hours", _r("delta_hours"))
    release(weights)  # its neighbours are written
    return timed


@query(f"""WITH {_UNION}, r2 AS (SELECT DISTINCT l_orderkey AS node, l_suppkey AS feature FROM lineitem), i2 AS (SELECT feature, ln((n + 1) / (count(*) + 1)) + 1 AS w FROM r2, alln GROUP BY feature, n HAVING count(*) <= 2000),
w2 AS (SELECT node, feature, w / sqrt(sum(w * w) OVER (PARTITION BY node)) AS weight FROM r2 JOIN i2 USING (feature)),
f1 AS (SELECT node, count(*) AS n FROM weights GROUP BY 1), f2 AS (SELECT node, count(*) AS n FROM w2 GROUP BY 1),
s1 AS (SELECT t."left", t."right", sum(a.weight * b.weight) AS s FROM timed t JOIN weights a ON a.node = t."left" JOIN weights b ON b.node = t."right" AND a.feature = b.feature GROUP BY 1, 2),
s2 AS (SELECT t."left", t."right", sum(a.weight * b.weight) AS s FROM timed t JOIN w2 a ON a.node = t."left" JOIN w2 b ON b.node = t."right" AND a.feature = b.feature GROUP BY 1, 2),
scored AS (SELECT t."left", t."right", least(1.0, coalesce(s1.s, 0.0)) AS e, least(1.0, coalesce(s2.s, 0.0)) AS u, least(coalesce(a1.n, 0), coalesce(b1.n, 0)) AS ef, least(coalesce(a2.n, 0), coalesce(b2.n, 0)) AS uf
  FROM timed t LEFT JOIN s1 USING ("left", "right") LEFT JOIN s2 USING ("left", "right") LEFT JOIN f1 a1 ON a1.node = t."left" LEFT JOIN f1 b1 ON b1.node = t."right" LEFT JOIN f2 a2 ON a2.node = t."left" LEFT JOIN f2 b2 ON b2.node = t."right"),
fused AS (SELECT *, (e * 1.5 + u * 1.0) / nullif((ef > 0)::INT * 1.5 + (uf > 0)::INT, 0) AS c, (e >= 0.05)::INT + (u >= 0.2)::INT AS ch, (e >= 0.8 AND ef >= 2) OR (u >= 0.8 AND uf >= 2) AS strong FROM scored)
SELECT "left", "right", round(e, 6) AS event_score, round(u, 6) AS url_score, round(coalesce(c, 0.0), 6) AS combined, ch AS evidence_channels, strong AS single_channel_strong, round(CASE WHEN ch >= 2 OR strong THEN coalesce(c, 0.0) ELSE 0.0 END, 6) AS gated FROM fused""")
def pair_scores_gate(spark: SparkSession, d: str) -> DataFrame:
    weights, orders = _weights(spark, d), _t(spark, d, "orders")
    pairs = materialize(_candidates(spark, d, weights), "candidates")
    suppliers = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("feature")).distinct()
    pairs = materialize(similarity.channel_scores(pairs, weights.select("node", F.inline("items")), "event"), "scores")
    release(weights)
    pairs = similarity.channel_scores(pairs, materialize(similarity.tfidf(suppliers, orders), "weights"), "url")
    gated = similarity.apply_gate(pairs.withColumn("combined", similarity.combined_score(["event", "url"])), ["event", "url"])
    return gated.select("left", "right", *[_r(c).alias(c) for c in ("event_score", "url_score", "combined")], "evidence_channels", "single_channel_strong", _r("gated").alias("gated"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS e FROM lineitem), n AS (SELECT e, count(*) AS n FROM r GROUP BY 1), t AS (SELECT l_partkey AS e, min(l_shipdate) AS t FROM lineitem GROUP BY 1),
p AS (SELECT a.e AS "left", b.e AS "right", count(*) AS shared FROM r a JOIN r b ON a.d = b.d AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT "left", "right", shared, round(shared / (a.n + b.n - shared), 6) AS jaccard FROM p JOIN n a ON a.e = "left" JOIN n b ON b.e = "right" JOIN t x ON x.e = "left" JOIN t y ON y.e = "right" WHERE abs(date_diff('second', x.t, y.t)) / 3600.0 <= 720""")
def bipartite_projection(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    return similarity.projection(li, "l_orderkey", "l_partkey", 2, "l_shipdate", 30).withColumn("jaccard", _r("jaccard"))


@query("""WITH c AS (SELECT l_suppkey AS g, l_partkey AS f, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT g, f FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, f::VARCHAR) AS r FROM c) WHERE r <= 10),
s AS (SELECT g, count(*) AS n FROM t GROUP BY 1), p AS (SELECT a.g AS "left", b.g AS "right", count(*) AS shared FROM t a JOIN t b ON a.f = b.f AND a.g < b.g GROUP BY 1, 2)
SELECT "left", "right", shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN s x ON x.g = "left" JOIN s y ON y.g = "right" """)
def family_overlap_links(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("incident_id"), F.col("l_partkey").cast("string").alias("feature"))
    return families.overlap_pairs(families.top_features(rows, 10)).withColumn("jaccard", _r("jaccard"))


# ---------------------------------------------------------------- vectors and graphs

_VEC = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS vector FROM embeddings)"


def _vec(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


@query(f"""WITH {_VEC}, x AS (SELECT id, label, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM v), m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM x GROUP BY 1, 2),
c AS (SELECT id, label, i, CASE WHEN n >= 45 THEN x - m ELSE x END AS c FROM x JOIN m USING (label, i)), n AS (SELECT id, sqrt(sum(c * c)) AS n FROM c GROUP BY 1)
SELECT id, label, round(sum(c / n * i), 6) AS weighted, round(max(c / n), 6) AS largest FROM c JOIN n USING (id) GROUP BY 1, 2""")
def vector_centering(spark: SparkSession, d: str) -> DataFrame:
    done = vectors.center(_vec(spark, d), "label", least=45)
    weighted = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return done.select("id", "label", _r(weighted).alias("weighted"), _r(F.array_max("vector")).alias("largest"))


@query(f"WITH {_VEC} SELECT a.label AS group_left, b.label AS group_right, round(least(greatest(quantile_cont(list_dot_product(a.vector, b.vector), 0.9), 0.0), 0.99), 6) AS quantile, count(*) AS pairs FROM v a JOIN v b ON a.label <= b.label AND a.id <> b.id GROUP BY 1, 2")
def background_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Over all pairs of rows of every two labels."""
    return vectors.pair_background(_vec(spark, d), "label").withColumn("quantile", _r("quantile"))


_KNN = f"""{_VEC}, pairs AS (SELECT a.id AS node, b.id AS neighbor, list_dot_product(a.vector, b.vector) AS cosine FROM v a JOIN v b ON a.id <> b.id WHERE list_dot_product(a.vector, b.vector) >= 0.35),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cosine DESC, neighbor) AS rank FROM pairs) WHERE rank <= 5)"""


@query(f"WITH {_KNN} SELECT node, neighbor, round(cosine, 6) AS cosine, rank::INT AS rank, round(least(greatest((cosine - 0.17) / 0.83, 0.0), 1.0), 6) AS score FROM knn")
def vector_knn(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.knn(_vec(spark, d), 5, 0.35)
    return near.select("node", "neighbor", _r("cosine").alias("cosine"), "rank", _r(vectors.calibrated(F.col("cosine"), F.lit(None).cast("double"))).alias("score"))


@query(f"""WITH {_VEC}, x AS (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM v), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1),
c AS (SELECT label, list(m / n ORDER BY i) AS c FROM m JOIN n USING (label) GROUP BY 1), s AS (SELECT label, id, list_dot_product(vector, c) AS s FROM v JOIN c USING (label))
SELECT label AS cluster, round(avg(s), 6) AS title_coherence, arg_max('t' || id, (round(s, 12), -id)) AS title FROM s GROUP BY 1""")
def centroid_medoid(spark: SparkSession, d: str) -> DataFrame:
    rows = _vec(spark, d).select(F.col("label").alias("cluster"), F.col("id").alias("document_id"), "vector", F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"))
    return vectors.title_coherence(rows).withColumn("title_coherence", _r("title_coherence"))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges between mutual or one-sided near neighbours of cosine 0.35 or more."""
    near = vectors.knn(_vec(spark, d), 5, 0.35)
    return near.select(F.least("node", "neighbor").alias("left"), F.greatest("node", "neighbor").alias("right"), _r("cosine", 9).alias("gated")).distinct()


_GRAPH = f"""{_VEC}, pairs AS (SELECT a.id AS node, b.id AS neighbor, list_dot_product(a.vector, b.vector) AS cosine FROM v a JOIN v b ON a.id <> b.id WHERE list_dot_product(a.vector, b.vector) >= 0.35),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cosine DESC, neighbor) AS rank FROM pairs) WHERE rank <= 5),
edges AS (SELECT DISTINCT least(node, neighbor) AS "left", greatest(node, neighbor) AS "right", round(cosine, 9) AS gated FROM knn),
sides AS (SELECT "left" AS a, "right" AS b, gated FROM edges UNION ALL SELECT "right", "left", gated FROM edges),
reach AS (SELECT a AS node, a AS r FROM sides UNION SELECT b.b, reach.r FROM reach JOIN sides b ON b.a = reach.node),
comp AS (SELECT node, min(r) AS component FROM reach GROUP BY 1)"""


@query(f"WITH RECURSIVE {_GRAPH} SELECT * FROM comp")
def components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(_graph(spark, d))


@query()
def cpm_partition(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: local moving. The tests compare objective values with exhaustive search."""
    return partition.communities(_graph(spark, d), 0.05)


@query()
def modularity_partition(spark: SparkSession, d: str) -> DataFrame:
    return partition.communities(_graph(spark, d), 1.0, modularity=True)


_MEMBER = f"""{_GRAPH}, incident AS (SELECT v.id AS document_id, coalesce(k, -1) AS incident_id, label FROM v LEFT JOIN (SELECT node, component % 7 AS k FROM comp) ON node = v.id),
e AS (SELECT a AS document_id, b AS other, gated AS w FROM sides), per AS (SELECT e.document_id, i.incident_id, sum(w) AS w FROM e JOIN incident i ON i.document_id = other GROUP BY 1, 2),
shares AS (SELECT * FROM (SELECT *, w / sum(w) OVER (PARTITION BY document_id) AS s FROM per) WHERE incident_id >= 0)"""


@query(f"""WITH RECURSIVE {_MEMBER} SELECT i.document_id, i.incident_id, round(CASE WHEN i.incident_id < 0 THEN 0.0 ELSE coalesce(s, 1.0) END, 6) AS assignment_score, true AS is_primary FROM incident i LEFT JOIN shares x ON x.document_id = i.document_id AND x.incident_id = i.incident_id
UNION ALL SELECT x.document_id, x.incident_id, round(s, 6), false FROM shares x JOIN incident i ON i.document_id = x.document_id WHERE x.incident_id <> i.incident_id AND s >= 0.25""")
def memberships(spark: SparkSession, d: str) -> DataFrame:
    return partition.memberships(_graph(spark, d), _incidents(spark, d)).withColumn("assignment_score", _r("assignment_score"))


def _incidents(spark: SparkSession, d: str) -> DataFrame:
    """Components by their number's rest, so that incidents touch."""
    own = connected_components(_graph(spark, d)).select(F.col("node").alias("document_id"), (F.col("component") % 7).alias("k"))
    docs = _t(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"))
    return docs.join(own, "document_id", "left").select("document_id", F.coalesce("k", F.lit(-1)).cast("long").alias("incident_id"))


@query(f"""WITH {_KNN}, edges AS (SELECT DISTINCT least(node, neighbor) AS "left", greatest(node, neighbor) AS "right", round(cosine, 9) AS gated FROM knn),
sides AS (SELECT "left" AS document_id, "right" AS neighbor_document_id, gated FROM edges UNION ALL SELECT "right", "left", gated FROM edges),
r AS (SELECT b.*, y.label AS neighbor_incident_id, x.label = y.label AS same_incident FROM sides b JOIN v x ON x.id = document_id JOIN v y ON y.id = neighbor_document_id),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id, same_incident ORDER BY gated DESC, neighbor_document_id) AS rank FROM r)
SELECT document_id, neighbor_document_id, neighbor_incident_id::BIGINT AS neighbor_incident_id, same_incident, rank::INT AS rank, round(gated, 6) AS gated FROM k WHERE rank <= CASE WHEN same_incident THEN 3 ELSE 1 END""")
def document_evidence(spark: SparkSession, d: str) -> DataFrame:
    members = _t(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("label").cast("long").alias("incident_id"), F.lit(True).alias("is_primary"))
    return partition.evidence(_graph(spark, d), members, ["gated"]).withColumn("gated", _r("gated"))


@query(f"WITH RECURSIVE {_GRAPH}, n AS (SELECT component, count(*) AS n FROM comp GROUP BY 1) SELECT n AS size, sum(count(*)) OVER (ORDER BY n DESC)::BIGINT AS at_least, round(sum(count(*)) OVER (ORDER BY n DESC) / sum(count(*)) OVER (), 6) AS share FROM n GROUP BY n")
def survival_curve(spark: SparkSession, d: str) -> DataFrame:
    sizes = connected_components(_graph(spark, d)).groupBy("component").agg(F.count("*").alias("n"))
    return evaluation.survival(sizes).withColumn("share", _r("share"))


@query(f"""WITH RECURSIVE {_GRAPH}, n AS (SELECT component, count(*) AS n FROM comp GROUP BY 1), s AS (SELECT count(*) AS clusters, max(n) AS largest, sum(n)::BIGINT AS assigned, median(n) AS middle FROM n)
SELECT clusters, largest, assigned, (SELECT count(*) FROM v) AS articles, (SELECT count(*) FROM v) - assigned AS unassigned, round(largest / assigned, 6) AS largest_share, middle FROM s""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    own = connected_components(_graph(spark, d)).select(F.col("node").alias("id"), "component")
    members = _vec(spark, d).select("id").join(own, "id", "left").select(F.coalesce("component", F.lit(-1)).alias("cluster"))
    return evaluation.run_summary(members).select("clusters", "largest", "assigned", "articles", "unassigned", _r("largest_share").alias("largest_share"), F.col("size_quantiles")[2].alias("middle"))


@query("""WITH tf AS (SELECT l_suppkey AS node, l_partkey AS feature, 1 + ln(count(*)) AS tf FROM lineitem GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM supplier),
df AS (SELECT feature, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT node, feature, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (feature), n WHERE df >= 2 AND df <= 0.5 * n),
l AS (SELECT node, feature, round(w / sqrt(sum(w * w) OVER (PARTITION BY node)), 9) AS w FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, feature) AS r FROM l)
SELECT node, string_agg(feature::VARCHAR, '|' ORDER BY r) AS terms, round(max(w), 6) AS heaviest FROM r WHERE r <= 8 GROUP BY 1""")
def entity_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Sublinear weights of the first generation: suppliers by their parts, the eight heaviest."""
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("feature"))
    w = prototypes.entity_weights(rows, _t(spark, d, "supplier"), 2, 0.5).withColumn("weight", F.round("weight", 9))
    top = ranking.gathered(ranking.top_per_key(w, ["node"], [F.desc("weight"), "feature"], 8, "r"), ["node"], F.struct("feature", "weight"), "t")
    return top.select("node", _joined(F.col("t.feature")).alias("terms"), _r(F.array_max("t.weight")).alias("heaviest"))


@query(rf"""WITH {_CANON} SELECT page_id, CASE WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'OR' WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'CO' END AS country FROM canon
WHERE host = 'example.org' OR ends_with(host, '.example.org') OR host = 'example.com' OR ends_with(host, '.example.com')""")
def outlet_countries(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select("page_id", urls.url_domain(F.col("url")).alias("source"))
    return prototypes.outlets(p, {"example.org": "OR", "example.com": "CO"}).select("page_id", "country")


# ---------------------------------------------------------------- evaluation

_EVAL = f"{_GRAPH}, lab AS (SELECT v.id, label AS gold, coalesce(component, -v.id - 2) AS pred FROM v LEFT JOIN comp ON node = v.id), n AS (SELECT gold, pred, count(*) AS n FROM lab GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY gold) AS g, sum(n) OVER (PARTITION BY pred) AS p FROM n)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    own = connected_components(_graph(spark, d)).select(F.col("node").alias("id"), "component")
    rows = _vec(spark, d).select("id", F.col("label").alias("gold")).join(own, "id", "left").withColumn("component", F.coalesce("component", F.lit(-1)))
    return rows.withColumn("pred", evaluation.singletons_apart(rows, "component", "id"))


@query(f"WITH RECURSIVE {_EVAL}, s AS (SELECT sum(n * n / p) / sum(n) AS p, sum(n * n / g) / sum(n) AS r FROM c) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s")
def b_cubed(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.b_cubed(_labelled(spark, d)).select(*[_r(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH RECURSIVE {_EVAL}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS b, (SELECT sum(x * (x - 1) / 2) FROM (SELECT count(*) AS x FROM lab GROUP BY pred)) AS p, (SELECT sum(x * (x - 1) / 2) FROM (SELECT count(*) AS x FROM lab GROUP BY gold)) AS g)
SELECT round(coalesce(b / nullif(p, 0), 0), 6) AS precision, round(coalesce(b / nullif(g, 0), 0), 6) AS recall, round(coalesce(2 * (b / p) * (b / g) / (b / p + b / g), 0), 6) AS f1 FROM s""")
def pairwise_prf(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.pairwise(_labelled(spark, d)).select(*[_r(c).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH p AS (SELECT lang, source, quality = 1 AS t, n_chars > 1000 AS s FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) FILTER (t AND s) AS tp, count(*) FILTER (NOT t AND s) AS fp, count(*) FILTER (t AND NOT s) AS fn, count(*) FILTER (NOT t AND NOT s) AS tn FROM p GROUP BY 1)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def pair_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id")
    out = evaluation.confusion(rows, F.col("quality") == 1, F.col("n_chars") > 1000, ["lang"])
    return out.withColumns({c: _r(c) for c in ("precision", "recall", "f1")})


@query()
def ceaf_e(spark: SparkSession, d: str) -> DataFrame:
    """An optimal matching of clusters: no SQL. Ten labels by their components."""
    found = evaluation.ceaf_e(_labelled(spark, d))
    return spark.createDataFrame([tuple(float(found[c]) for c in ("precision", "recall", "f1"))], "precision double, recall double, f1 double")


@query("""WITH t AS (SELECT lang, source, unnest(list_filter(['and', 'der', 'les'], lambda p: contains(' ' || lower(text) || ' ', ' ' || p || ' '))) AS story FROM documents), n AS (SELECT story, count(*) AS articles FROM t GROUP BY 1),
b AS (SELECT * FROM (SELECT story, source, count(*) AS hit, row_number() OVER (PARTITION BY story ORDER BY count(*) DESC, regexp_extract(source, '[0-9]+')::INT) AS r FROM t GROUP BY 1, 2) WHERE r = 1), s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1)
SELECT story, articles, source AS best_cluster, round(hit / articles, 6) AS recall, round(hit / size, 6) AS purity FROM n JOIN b USING (story) JOIN s USING (source)""")
def keyword_validation(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    padded = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    n = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    names = docs.select("source", n.alias("cluster")).distinct()
    out = evaluation.keyword_validation(docs.withColumn("cluster", n), padded, {w: f" {w} " for w in ("and", "der", "les")})
    return out.join(names, out["best_cluster"] == names["cluster"]).select("story", "articles", F.col("source").alias("best_cluster"), _r("recall").alias("recall"), _r("purity").alias("purity"))


# ---------------------------------------------------------------- country responses

_RDOCS = """docs AS (SELECT ascii(substr(o_orderpriority, 1, 1)) * 10000 + year(o_orderdate) AS macro_event_id, 'C' || c_nationkey AS publisher_country, o_orderdate AS observed_time, o_custkey AS source_domain, l_suppkey AS wire_group, 'C' || s_nationkey AS event_country, o_orderpriority AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _response_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, coverage, baseline): a priority's year as an event, suppliers' nations as its
    places, customers' nations as publisher countries."""
    li, o, c, s = (_t(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    docs = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).select(
        (F.ascii(F.substring("o_orderpriority", 1, 1)).cast("long") * 10000 + F.year("o_orderdate")).alias("macro_event_id"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("publisher_country"),
        F.col("o_orderdate").cast("timestamp").alias("observed_time"), F.col("o_custkey").alias("source_domain"), F.col("o_custkey").alias("domain"), F.col("l_suppkey").alias("wire_group"),
        F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("event_country"), F.col("o_orderpriority").alias("kind"),
    )
    docs = materialize(docs, "responses")
    total = docs.agg(F.count("*").alias("d"), F.count_distinct("wire_group").alias("r")).first()
    baseline = attention.country_baseline(docs)
    _, summary = attention.country_tables(docs, baseline, total["d"], total["r"])
    sizes = docs.groupBy("macro_event_id").agg(
        F.min("observed_time").alias("start_time"), F.max("observed_time").alias("end_time"), F.count("*").alias("raw_documents"), F.count_distinct("wire_group").alias("effective_reports"), F.min("kind").alias("title"),
    )
    origin = responses.dominant_origin(docs.withColumn("effective_reports", F.lit(1)), ("macro_event_id",))
    events = sizes.join(origin, "macro_event_id").select(
        "macro_event_id", F.col("macro_event_id").alias("family_id"), "title", "start_time", "end_time", F.array("title").alias("event_types"), "raw_documents", "effective_reports", F.lit("m").alias("resolution_model"), F.col("origin_country").alias("event_country"),
    )
    coverage = summary.select(F.lit("incident").alias("level"), F.col("macro_event_id").alias("event_id"), "publisher_country", "onset", "world_onset", "suppressed", "raw_documents", "unique_domains", "effective_reports", "attention_ratio")
    return events, coverage, baseline


def _observations(spark: SparkSession, d: str) -> DataFrame:
    events, coverage, baseline = _response_tables(spark, d)
    table = responses.event_table(events, families.rollup(events.withColumn("label", F.lit("")))).where("level = 'incident'")
    when = lambda t: F.lit(t).cast("timestamp")
    return responses.observations(table, coverage, baseline, when("1995-06-01 00:00:00"), when("2001-08-01 00:00:00"))


_OBS = f"""{_RDOCS},{_country_sql("macro_event_id")},
origins AS (SELECT macro_event_id, event_country AS origin_country FROM (SELECT macro_event_id, event_country, row_number() OVER (PARTITION BY macro_event_id ORDER BY count(*) DESC, event_country) AS r FROM docs GROUP BY 1, 2) WHERE r = 1),
ev AS (SELECT macro_event_id AS event_id, min(observed_time) AS event_start, count(DISTINCT wire_group) AS size, min(kind) AS kind, any_value(origin_country) AS origin_country FROM docs JOIN origins USING (macro_event_id) GROUP BY 1),
hm AS (SELECT *, trunc(0) AS z FROM ev), wo AS (SELECT macro_event_id AS event_id, min(world_onset) AS world_onset FROM summary GROUP BY 1),
obs0 AS (SELECT e.event_id, e.event_start, e.size, e.kind, e.origin_country, b.publisher_country AS destination_country, s.onset AS destination_onset, o.onset AS origin_onset, wo.world_onset, s.suppressed, s.raw_documents, s.effective_reports, e.origin_country = b.publisher_country AS home
  FROM ev e CROSS JOIN base b LEFT JOIN summary s ON s.macro_event_id = e.event_id AND s.publisher_country = b.publisher_country LEFT JOIN summary o ON o.macro_event_id = e.event_id AND o.publisher_country = e.origin_country LEFT JOIN wo ON wo.event_id = e.event_id),
obs AS (SELECT event_id, kind, size, origin_country, destination_country, home AS is_domestic, event_start <= TIMESTAMP '1995-06-01' AS start_truncated, destination_onset, origin_onset, raw_documents IS NOT NULL AS has_documents, destination_onset IS NOT NULL AND NOT coalesce(suppressed, true) AS covered, effective_reports,
  CASE WHEN home THEN 'event_start' WHEN origin_onset IS NOT NULL THEN 'origin' WHEN world_onset IS NOT NULL THEN 'world_fallback' END AS response_reference,
  trunc((epoch_us(destination_onset) - epoch_us(CASE WHEN home THEN event_start WHEN origin_onset IS NOT NULL THEN origin_onset ELSE world_onset END)) / 60000000) / 60.0 AS response_hours,
  trunc((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(CASE WHEN home THEN event_start WHEN origin_onset IS NOT NULL THEN origin_onset ELSE world_onset END)) / 60000000) / 60.0 AS censor_hours FROM obs0)"""


@query(f"WITH {_OBS} SELECT event_id, origin_country, destination_country, is_domestic, start_truncated, destination_onset, origin_onset, has_documents, covered, effective_reports, response_reference, round(response_hours, 6) AS response_hours, round(censor_hours, 6) AS censor_hours FROM obs")
def response_observations(spark: SparkSession, d: str) -> DataFrame:
    return _observations(spark, d).select(
        "event_id", "origin_country", "destination_country", "is_domestic", "start_truncated", _time("destination_onset"), _time("origin_onset"), "has_documents", "covered", "effective_reports", "response_reference", _r("response_hours").alias("response_hours"), _r("censor_hours").alias("censor_hours"),
    )


def _summary_sql(keys: str, src: str) -> str:
    z = "1.959964"
    p, n = "(covered_events / eligible_events)", "eligible_events"
    centre, half = f"({p} + {z} * {z} / (2 * {n}))", f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})))"
    lat = {"mean": "avg(h)", "median": "median(h)", "p25": "quantile_cont(h, 0.25)", "p75": "quantile_cont(h, 0.75)"}
    ok = "covered_events >= 5 AND effective_reports >= 15"
    return f"""a AS (SELECT *, covered AND response_hours IS NOT NULL AS ans, CASE WHEN covered THEN response_hours END AS h FROM {src}),
g AS (SELECT {keys}, count(*) AS eligible_events, count(*) FILTER (ans) AS covered_events, coalesce(sum(effective_reports) FILTER (ans), 0)::BIGINT AS effective_reports, count(*) FILTER (ans AND response_reference = 'world_fallback') AS world_fallback_events,
  {", ".join(f"{e} AS {k}" for k, e in lat.items())}, min(h) AS lo, max(h) AS hi FROM a GROUP BY ALL)
SELECT {keys}, eligible_events, covered_events, eligible_events - covered_events AS uncovered_events, round({p}, 6) AS coverage_rate, round(greatest(0.0, ({centre} - {half}) / (1 + {z} * {z} / {n})), 6) AS coverage_ci_low, round(least(1.0, ({centre} + {half}) / (1 + {z} * {z} / {n})), 6) AS coverage_ci_high,
  effective_reports, world_fallback_events, {", ".join(f"round(CASE WHEN {ok} THEN {k} END, 6) AS {k}_response_hours" for k in lat)}, round(CASE WHEN {ok} THEN lo END, 6) AS fastest_response_hours, round(CASE WHEN {ok} THEN hi END, 6) AS slowest_response_hours, CASE WHEN {ok} THEN 'ok' ELSE 'insufficient' END AS support_status FROM g"""


def _rounded(summary: DataFrame) -> DataFrame:
    return summary.select(*[_r(n).alias(n) if t == "double" else F.col(n) for n, t in summary.dtypes])


@query(f"WITH {_OBS}, f AS (SELECT * FROM obs WHERE NOT is_domestic AND size >= 5), {_summary_sql('destination_country', 'f')}")
def response_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = responses.apply_filters(_observations(spark, d), responses.Filters("incident", min_event_effective_reports=5))
    return _rounded(responses.summarize(responses.foreign(rows), ["destination_country"]))


@query(f"WITH {_OBS}, f AS (SELECT *, kind AS event_types FROM obs WHERE NOT is_domestic), {_summary_sql('event_types', 'f')}")
def response_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(responses.summarize_by_type(responses.foreign(_observations(spark, d))))


@query(f"""WITH {_OBS}, f AS (SELECT *, CASE WHEN size >= 500 THEN '500+ effective reports' WHEN size >= 100 THEN '100-499 effective reports' WHEN size >= 20 THEN '20-99 effective reports' WHEN size >= 5 THEN '5-19 effective reports' END AS magnitude FROM obs WHERE NOT is_domestic),
f2 AS (SELECT * FROM f WHERE magnitude IS NOT NULL), {_summary_sql('magnitude', 'f2')}""")
def response_by_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(responses.summarize_by_magnitude(responses.foreign(_observations(spark, d))))


@query(f"""WITH {_OBS}, f AS (SELECT * FROM obs WHERE (NOT is_domestic OR NOT start_truncated)), cells AS (SELECT o.c AS origin_country, x.c AS destination_country FROM (VALUES ('C1'), ('C2'), ('C3'), ('C4'), ('XX')) o(c), (VALUES ('C1'), ('C2'), ('C3'), ('C4'), ('XX')) x(c)), m AS (
WITH {_summary_sql('origin_country, destination_country', 'f')})
SELECT origin_country, destination_country, coalesce(eligible_events, 0) AS eligible_events, coalesce(covered_events, 0) AS covered_events, median_response_hours, coalesce(support_status, 'insufficient') AS support_status, CASE WHEN origin_country = destination_country THEN 'domestic' ELSE 'foreign' END AS kind FROM cells LEFT JOIN m USING (origin_country, destination_country)""")
def pair_matrix(spark: SparkSession, d: str) -> DataFrame:
    sides = ["C1", "C2", "C3", "C4", "XX"]
    out = responses.pair_matrix(_observations(spark, d), sides, sides)
    return out.select("origin_country", "destination_country", "eligible_events", "covered_events", _r("median_response_hours").alias("median_response_hours"), "support_status", "kind")


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: a seeded bootstrap. The tests compare it with numpy."""
    rows = responses.foreign(_observations(spark, d)).where("covered")
    return responses.bootstrap_median(rows, ["destination_country"], "response_hours")


@query(f"WITH {_OBS}, x AS (SELECT *, covered AND response_hours IS NOT NULL AS ans FROM obs WHERE origin_country <> destination_country) SELECT event_id, origin_country, destination_country, round(response_hours, 6) AS response_hours, covered FROM x ORDER BY ans DESC, CASE WHEN ans THEN response_hours END, CASE WHEN NOT ans THEN -size END, event_id, destination_country LIMIT 40")
def event_records(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 records, covered and fastest first: the limit is the feature."""
    rows = responses.event_records(responses.foreign(_observations(spark, d)), 40)
    return rows.select("event_id", "origin_country", "destination_country", _r("response_hours").alias("response_hours"), "covered")


# ---------------------------------------------------------------- search


def _articles(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.lower("text").alias("searchtext"), F.col("source").alias("domain"), F.col("lang").alias("language"), F.upper("lang").alias("sourcecountry"), F.array(F.col("lang"), F.col("source")).alias("themes"), "n_chars")


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'of the') AND contains(lower(text), 'and')""")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_articles(spark, d), '"of the" and').select("doc_id")


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'thing') OR contains(lower(text), 'ing the')) AND NOT (lower(source) = 'src3') AND NOT (contains(lower(source), 'src1'))")
def search_or_not(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_articles(spark, d), '(thing OR "ing the") -domainis:src3 -domain:SRC1').select("doc_id")


@query("SELECT doc_id FROM documents WHERE (lang = 'french' OR starts_with(lang, 'fre') OR lang = 'de' OR starts_with(lang, 'de')) AND (contains(lang, 'rc7') OR contains(source, 'rc7')) AND contains(lower(text), 'der')")
def search_field(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_articles(spark, d), "sourcelang:french OR sourcelang:de theme:rc7 der").select("doc_id")


@query(r"""WITH h AS (SELECT doc_id, source, n_chars FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])nation([^\p{L}\p{N}_]|$)') OR regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])and([^\p{L}\p{N}_]|$)'))
SELECT source, count(*) AS title_hits, max(n_chars) AS longest FROM h GROUP BY 1""")
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d)
    test = text.token_match(F.col("searchtext"), "nation") | text.token_match(F.col("searchtext"), "and")
    return a.where(test).groupBy(F.col("domain").alias("source")).agg(F.count("*").alias("title_hits"), F.max("n_chars").alias("longest")).orderBy(F.desc("title_hits"), "source")


@query("""WITH s AS (SELECT 'domain' AS facet, source AS value, count(*) AS "count" FROM documents GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5), l AS (SELECT 'language' AS facet, lang AS value, count(*) AS "count" FROM documents GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5),
t AS (SELECT 'themes' AS facet, v AS value, count(*) AS "count" FROM (SELECT unnest([lang, source]) AS v FROM documents) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) SELECT * FROM s WHERE value <> '' UNION ALL SELECT * FROM l WHERE value <> '' UNION ALL SELECT * FROM t""")
def facets(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent values of each facet: the limit is the feature."""
    a = _articles(spark, d)
    one = [explorer.scalar_facet(a, c, 5).select(F.lit(c).alias("facet"), "value", "count") for c in ("domain", "language")]
    return one[0].unionByName(one[1]).unionByName(explorer.list_facet(a, "themes", 5).select(F.lit("themes").alias("facet"), "value", "count"))


@query("SELECT type, count(*) AS events, sum(raw)::BIGINT AS raw_documents FROM (SELECT unnest([o_orderpriority, o_orderstatus]) AS type, 1 AS raw FROM orders) GROUP BY 1")
def type_list(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.array("o_orderpriority", "o_orderstatus").alias("event_types"), F.lit(1).alias("raw_documents"))
    return serving.type_list(o)


@query(f"""WITH {_DOCS},{_country_sql('event_type')} SELECT publisher_country, count(*) AS events, sum(raw_documents)::BIGINT AS raw_documents, sum(effective_reports)::BIGINT AS effective_reports, any_value(country_documents) AS country_documents, round(avg(attention_ratio), 6) AS mean_attention_ratio,
  round(median(lag_hours), 6) AS median_lag_hours, count(lag_hours) AS events_with_onset, round(sum(raw_documents) / any_value(country_documents), 6) AS share_of_country_output FROM summary JOIN base USING (publisher_country) GROUP BY 1 HAVING count(*) >= 3 AND any_value(country_documents) >= 100""")
def type_countries(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(serving.type_countries(_countries(spark, d)[1], 3, 100))


# registers the queries of the news chain and of audits, requests and streams beside these
from newsloom.plans import catalogue_audits, catalogue_news  # noqa: E402, F401
