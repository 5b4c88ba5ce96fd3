"""Registered queries of the news chain: raw files, typed tables, documents, events, store.

The benchmark tables are written as raw rows of the news files first (a mention an event
row, a record a page, an event a part), so the operators run as they do on real files;
the SQL says what must come out, without going through files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text, urls
from newsloom.functions.fixed import CAMEO_ROOT_TYPES, EVENT_COLUMNS, EVENT_ROOT_CODES, GKG_COLUMNS, LABEL_STOP, MENTION_COLUMNS, TLD_COUNTRIES
from newsloom.operators import attention, evaluation, families, filters, similarity
from newsloom.plans import catalogue, documents, explorer, ingest, payloads, prototypes, store
from newsloom.plans.catalogue import query
from newsloom.plans.cutpoint import materialize, scratch
from newsloom.sources import raw, sinks

_t, _r, _time, _joined = catalogue._t, catalogue._r, catalogue._time, catalogue._joined

_STAMP = "yyyyMMddHHmmss"


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _raw_rows(rows: DataFrame, columns: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows as one tab-separated line each; columns without a value are empty."""
    return rows.select(F.concat_ws("\t", *[F.coalesce(values.get(c, F.lit("")), F.lit("")) for c in columns]).alias("line"), *rows.columns)


# ---------------------------------------------------------------- mentions


def _mention_lines(spark: SparkSession, d: str) -> DataFrame:
    """A line an event; the event's number names its page, every fiftieth line is torn."""
    pages = _t(spark, d, "pages")
    n = pages.count()
    e = _t(spark, d, "events").withColumn("page_id", F.col("event_id") % n).join(pages.select("page_id", "url"), "page_id")
    at = F.col("ts").cast("timestamp")
    lines = _raw_rows(e, MENTION_COLUMNS, {
        "GlobalEventID": _s("user_id"), "EventTimeDate": F.date_format(F.date_trunc("hour", at), _STAMP), "MentionTimeDate": F.date_format(at, _STAMP),
        "MentionType": F.when(F.col("event_type") == "error", "2").otherwise("1"), "MentionSourceName": F.concat(F.lit("src"), _s(F.col("page_id") % 20)), "MentionIdentifier": F.col("url"),
        "SentenceID": _s("event_id"), "InRawText": _s((F.col("event_id") % 3 == 0).cast("int")), "Confidence": _s(10 + F.col("event_id") % 90),
        "MentionDocTone": F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(_s("value")), "MentionDocTranslationInfo": F.when(F.col("event_id") % 4 == 0, "srclc:deu;eng:GT").otherwise(""),
    })
    return lines.select(F.when(F.col("event_id") % 50 == 7, F.substring_index("line", "\t", 2)).otherwise(F.col("line")).alias("value"))


def _read_mentions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(typed mentions, audit) of the lines written as text files."""
    path = scratch(spark, "mentions")
    _mention_lines(spark, d).write.text(path)
    rows, audit = raw.read_raw(spark, [path], MENTION_COLUMNS)
    family = F.when(F.col("MentionDocTranslationInfo").isNotNull(), "x.translation.mentions.CSV").otherwise("x.mentions.CSV")
    return ingest.typed_mentions(rows.withColumn("source_file", family)), audit


_MENTIONS = f"""{catalogue._CANON}, pages_n AS (SELECT count(*) AS n FROM pages),
mentions AS (SELECT user_id AS event, event_id AS sentence, date_trunc('hour', ts) AS event_time, date_trunc('second', ts) AS mention_time, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS kind,
  (event_id % 3 = 0)::BIGINT AS in_raw_text, 10 + event_id % 90 AS confidence, CASE WHEN event_id % 7 <> 0 THEN value END AS tone, CASE WHEN event_id % 4 = 0 THEN 'deu' END AS lang, event_id % 4 = 0 AS translated,
  canonical_url, host FROM events, pages_n JOIN urls ON page_id = event_id % n WHERE event_id % 50 <> 7)"""


@query(f"WITH {_MENTIONS} SELECT event, event_time, mention_time, kind::BIGINT AS kind, in_raw_text, confidence, round(tone, 6) AS tone, lang, translated, canonical_url, host AS domain FROM mentions")
def typed_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = _read_mentions(spark, d)[0]
    return m.select(
        F.col("GlobalEventID").alias("event"), _time("EventTimeDate").alias("event_time"), _time("MentionTimeDate").alias("mention_time"), F.col("MentionType").alias("kind"),
        F.col("InRawText").alias("in_raw_text"), F.col("Confidence").alias("confidence"), _r("MentionDocTone").alias("tone"), F.col("source_language").alias("lang"), "translated", "canonical_url", "domain",
    )


@query("SELECT count(*) AS rows, count(*) FILTER (event_id % 50 = 7) AS malformed_rows FROM events")
def raw_audit(spark: SparkSession, d: str) -> DataFrame:
    return _read_mentions(spark, d)[1].agg(F.sum("rows").alias("rows"), F.sum("malformed_rows").alias("malformed_rows"))


@query("SELECT split_part(url, '?', 1) AS page, count(*) AS lines FROM events, (SELECT count(*) AS n FROM pages) JOIN pages ON page_id = event_id % n WHERE event_id % 50 <> 7 GROUP BY 1")
def raw_positions(spark: SparkSession, d: str) -> DataFrame:
    """One column by its place; torn lines have none."""
    path = scratch(spark, "positions")
    _mention_lines(spark, d).write.text(path)
    found = raw.positions(spark, [path], {"url": MENTION_COLUMNS.index("MentionIdentifier")}).where("url is not null")
    return found.groupBy(F.substring_index("url", "?", 1).alias("page")).agg(F.count("*").alias("lines"))


@query("SELECT s_suppkey, 'C' || s_nationkey AS country, s_name AS name FROM supplier")
def domain_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The list of outlets as a text file: rows without a code don't count, nor does ``www.``."""
    s = _t(spark, d, "supplier")
    domain = F.concat(F.lit("WWW.s"), _s("s_suppkey"), F.lit(".Example.com"))
    rows = s.select(F.concat_ws("\t", domain, F.concat(F.lit("C"), _s("s_nationkey")), "s_name").alias("value")).unionByName(s.select(F.concat_ws("\t", F.concat(F.lit("t"), _s("s_suppkey"), F.lit(".io")), F.lit(""), "s_name").alias("value")))
    path = scratch(spark, "lookup")
    rows.unionByName(s.select(_s("s_suppkey").alias("value"))).write.text(path)
    return raw.domain_lookup(spark, path).select(F.regexp_extract("domain", r"^s(\d+)\.example\.com$", 1).cast("long").alias("s_suppkey"), "country", "name")


# ---------------------------------------------------------------- graph records

_THEMES = {0: ["PROTEST", "TAX_X"], 1: ["ECON_STOCK", "WILDFIRE", "ENV_OIL"], 2: [], 3: ["ELECTION_DAY", "PROTEST_MARCH"], 4: ["DISASTER_FIRE"]}


def _gkg_lines(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select("page_id", "url")
    k = F.col("page_id")
    themes = F.coalesce(*[F.when(k % 5 == i, F.lit("; ".join([*x, *x[:1], ""]))) for i, x in _THEMES.items()])
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + k * 3600), _STAMP)
    people = F.concat(F.lit("ann "), _s(k % 7), F.lit(";bob;; bob ;ann "), _s(k % 7))
    places = F.concat(F.lit("1#Land#L"), _s(k % 6), F.lit("#A1#x#"), _s(k % 90), F.lit(".5#10#i;1#Land#L"), _s(k % 6), F.lit("#A1#x#1#1#i;4#Town#L1#A2#x#3.25#oops#i;4#Port#L1##x#2.5##i;short#x"))
    return _raw_rows(p, GKG_COLUMNS, {
        "GKGRecordID": F.concat(F.lit("r"), _s(k)), "Date": at, "SourceCollectionIdentifier": F.when(k % 9 == 0, " 1").otherwise("1"), "SourceCommonName": F.concat(F.lit("Name "), _s(k % 3)), "DocumentIdentifier": F.col("url"),
        "Themes": themes, "Persons": F.when(k % 4 == 0, F.lit("")).otherwise(people), "Organizations": F.when(k % 3 == 0, "un").otherwise(""), "V2Locations": places,
        "V2Tone": F.concat(_s(k % 11 - 5), F.lit(".25,1,2,3.5,4,5,"), _s(k * 3)), "TranslationInfo": F.when(k % 4 == 1, "srclc:fra;eng:GT").otherwise(""),
        "Extras": F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("<A/><PAGE_TITLE> A long &amp; quiet title,  number&#8211;"), _s(k % 40), F.lit(" | Paper "), _s(k % 3), F.lit(" </PAGE_TITLE>"))),
    }).select(F.col("line").alias("value"))


def _typed_gkg(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "gkg")
    _gkg_lines(spark, d).write.text(path)
    rows, _ = raw.read_raw(spark, [path], GKG_COLUMNS)
    return ingest.typed_gkg(rows.withColumn("source_file", F.when(F.col("TranslationInfo").isNotNull(), "x.translation.gkg.csv").otherwise("x.gkg.csv")))


_THEME_SQL = "CASE page_id % 5 " + " ".join(f"WHEN {i} THEN {x}::VARCHAR[]" for i, x in _THEMES.items()) + " END"
_GKG = f"""{catalogue._CANON}, gkg AS (SELECT * FROM (SELECT page_id, canonical_url, host, to_timestamp(1704067200 + page_id * 3600)::TIMESTAMPTZ AT TIME ZONE 'UTC' AS gkg_time, {_THEME_SQL} AS themes,
  CASE WHEN page_id % 4 = 0 THEN []::VARCHAR[] ELSE ['ann ' || (page_id % 7), 'bob'] END AS persons, CASE WHEN page_id % 3 = 0 THEN ['un'] ELSE []::VARCHAR[] END AS organizations,
  page_id % 11 - 5 AS t, page_id * 3 AS words, page_id % 4 = 1 AS translated, CASE WHEN page_id % 6 <> 0 THEN 'A long & quiet title, number–' || (page_id % 40) || ' | Paper ' || (page_id % 3) END AS title,
  row_number() OVER (PARTITION BY canonical_url ORDER BY page_id) AS r FROM urls) WHERE r = 1)"""


@query(f"""WITH {_GKG} SELECT page_id, canonical_url, host AS domain, gkg_time, array_to_string(themes, '|') AS themes, array_to_string(persons, '|') AS persons, array_to_string(organizations, '|') AS organizations,
  CASE WHEN t = 0 THEN 0.25 WHEN t < 0 THEN t - 0.25 ELSE t + 0.25 END AS tone, words AS word_count, CASE WHEN translated THEN 'fra' END AS lang, translated, title,
  '1:Land:L' || (page_id % 6) || ':A1:' || (page_id % 90) || '|4:Port:L1::2' AS places FROM gkg""")
def typed_gkg(spark: SparkSession, d: str) -> DataFrame:
    part = lambda x: F.concat_ws(":", _s(x["geo_type"]), x["name"], x["country_code"], F.coalesce(x["adm1_code"], F.lit("")), _s(F.floor(x["lat"])))
    return _typed_gkg(spark, d).select(
        F.substring("GKGRecordID", 2, 20).cast("long").alias("page_id"), "canonical_url", "domain", _time("gkg_time"), *[_joined(F.col(c)).alias(c) for c in ("themes", "persons", "organizations")],
        "tone", "word_count", F.col("source_language").alias("lang"), "translated", F.col("page_title").alias("title"), F.array_join(F.transform("locations", part), "|").alias("places"),
    )


@query(f"WITH {_GKG} SELECT 'L' || (page_id % 6) AS publisher_country, median(page_id % 90 + 0.5) AS lat, median(10.0) AS lon FROM gkg GROUP BY 1")
def country_centroids(spark: SparkSession, d: str) -> DataFrame:
    return attention.country_centroids(_typed_gkg(spark, d))


# ---------------------------------------------------------------- events


def _event_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    lines = _raw_rows(_t(spark, d, "part"), EVENT_COLUMNS, {
        "GlobalEventID": _s(k), "Year": F.when(k % 10 == 3, "20x4").otherwise("2024"), "Actor1Name": F.upper("p_name"), "EventCode": F.concat(_s(10 + k % 11), F.lit("1")), "EventRootCode": _s(10 + k % 11),
        "GoldsteinScale": F.when(k % 10 == 4, " 1.5").otherwise(_s(F.col("p_size"))), "ActionGeo_Type": F.lit("4"), "ActionGeo_CountryCode": F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("N"), _s(k % 5))),
        "ActionGeo_Lat": _s(k % 90), "ActionGeo_Long": _s(k % 180), "DATEADDED": F.when(k % 10 == 5, "2024").otherwise(F.concat(F.lit("20240101"), F.lpad(_s(k % 24), 2, "0"), F.lit("3000"))), "SOURCEURL": F.concat(F.lit("HTTPS://www.Part.org/"), _s(k), F.lit("/")),
    })
    path = scratch(spark, "export")
    lines.select(F.col("line").alias("value")).write.text(path)
    return ingest.typed_events(raw.read_raw(spark, [path], EVENT_COLUMNS)[0].withColumn("source_file", F.lit("x.export.CSV")))


@query("""SELECT p_partkey AS event, CASE WHEN p_partkey % 10 <> 3 THEN 2024 END::BIGINT AS year, upper(p_name) AS actor, CASE WHEN p_partkey % 10 <> 4 THEN p_size END::DOUBLE AS scale, CASE WHEN p_partkey % 8 <> 0 THEN 'N' || (p_partkey % 5) END AS country,
  (p_partkey % 90)::DOUBLE AS lat, CASE WHEN p_partkey % 10 <> 5 THEN TIMESTAMP '2024-01-01 00:30:00' + to_hours((p_partkey % 24)::BIGINT) END AS added, 'https://part.org/' || p_partkey AS canonical_url, false AS translated FROM part""")
def typed_events(spark: SparkSession, d: str) -> DataFrame:
    return _event_rows(spark, d).select(
        F.col("GlobalEventID").alias("event"), F.col("Year").alias("year"), F.col("Actor1Name").alias("actor"), F.col("GoldsteinScale").alias("scale"), F.col("ActionGeo_CountryCode").alias("country"),
        F.col("ActionGeo_Lat").alias("lat"), _time("DATEADDED").alias("added"), "canonical_url", "translated",
    )


# ---------------------------------------------------------------- documents and their events


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(mentions, documents): two of three pages have a record, outlets are known by suffix."""
    mentions = materialize(_read_mentions(spark, d)[0], "typed-mentions")
    gkg = _typed_gkg(spark, d).where(F.substring("GKGRecordID", 2, 20).cast("long") % 3 != 0)
    hosts = _t(spark, d, "pages").select(urls.url_domain(F.col("url")).alias("domain")).distinct()
    sources = hosts.where("domain like '%.org' or domain like '%.net'").select("domain", F.upper(F.right("domain", F.lit(3))).alias("publisher_country"), F.lit(0.7).alias("country_confidence"))
    return mentions, materialize(documents.build_documents(mentions, gkg, sources), "documents")


_DOCUMENTS = f"""{_MENTIONS}, {_GKG.split(', gkg AS', 1)[1].join(['gkg AS', ''])},
web AS (SELECT canonical_url, min(host) AS h, min(mention_time) AS a, max(mention_time) AS b, count(DISTINCT event) AS n, bool_or(translated) AS tr, arg_min(lang, (mention_time, event, sentence)) FILTER (lang IS NOT NULL) AS ml, avg(tone) AS tone FROM mentions WHERE kind = 1 GROUP BY 1),
met AS (SELECT coalesce(g.canonical_url, w.canonical_url) AS canonical_url, coalesce(g.host, w.h) AS domain, title, coalesce(persons, []) AS persons, coalesce(organizations, []) AS organizations, coalesce(themes, []) AS themes, g.canonical_url IS NOT NULL AS has_gkg, coalesce(n, 0) AS event_count, w.tone AS mention_tone,
  least(gkg_time, a) AS first_seen, greatest(gkg_time, b) AS last_seen, coalesce(g.translated, false) OR coalesce(w.tr, false) AS translated, coalesce(CASE WHEN g.translated THEN 'fra' END, ml) AS lang
  FROM (SELECT * FROM gkg WHERE page_id % 3 <> 0) g FULL JOIN web w ON g.canonical_url = w.canonical_url),
docs AS (SELECT *, row_number() OVER (ORDER BY first_seen NULLS FIRST, canonical_url) - 1 AS document_id, CASE WHEN translated THEN lang ELSE 'eng' END AS language, CASE WHEN ends_with(domain, '.org') THEN 'ORG' WHEN ends_with(domain, '.net') THEN 'NET' END AS publisher_country,
  CASE WHEN title IS NOT NULL THEN 't' || split_part(title, ' | ', 1) WHEN has_gkg AND len(persons) + len(organizations) > 0 THEN 'e' || array_to_string(list_sort(persons), '|') || '#' || array_to_string(organizations, '|') || '#' || array_to_string(list_sort(themes), '|') ELSE 'u' || canonical_url END AS wire FROM met)"""


@query(f"WITH {_DOCUMENTS} SELECT document_id, canonical_url, domain, title, has_gkg, event_count, round(mention_tone, 6) AS mention_tone, first_seen, last_seen, translated, language, publisher_country, min(document_id) OVER (PARTITION BY wire) AS first_copy FROM docs")
def built_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)[1]
    return docs.select(
        "document_id", "canonical_url", "domain", "title", "has_gkg", "event_count", _r("mention_tone").alias("mention_tone"), _time("first_seen"), _time("last_seen"), "translated", "language", "publisher_country",
        F.min("document_id").over(W.partitionBy("wire_group")).alias("first_copy"),
    )


_LINKS = f"""{_DOCUMENTS}, links AS (SELECT document_id, event, max(confidence) AS confidence, max(in_raw_text) AS in_raw_text, min(mention_time) AS mention_time, arg_min(event_time, (mention_time, sentence)) AS event_time
  FROM mentions JOIN docs USING (canonical_url) WHERE kind = 1 GROUP BY 1, 2)"""


@query(f"WITH {_LINKS} SELECT * FROM links")
def document_events(spark: SparkSession, d: str) -> DataFrame:
    mentions, docs = _documents(spark, d)
    links = documents.build_document_events(mentions, docs)
    return links.select("document_id", F.col("GlobalEventID").alias("event"), "confidence", "in_raw_text", _time("mention_time"), _time("event_time"))


@query(f"""WITH {_LINKS}, n AS (SELECT greatest(count(*), 1) AS n FROM docs WHERE has_gkg), idf AS (SELECT theme, ln(n + 1) - ln(count(*) + 1) AS idf FROM (SELECT unnest(themes) AS theme FROM docs WHERE has_gkg), n GROUP BY theme, n),
j AS (SELECT * FROM links JOIN docs USING (document_id)), base AS (SELECT event, count(*) AS document_count, count(DISTINCT domain) AS source_count, count(DISTINCT wire) AS effective_source_count, count(DISTINCT publisher_country) AS publisher_country_count,
  round(avg(confidence), 6) AS confidence_mean, median(confidence) AS confidence_median, round(avg(in_raw_text), 6) AS raw_text_rate, round(avg(has_gkg::INT), 6) AS gkg_coverage, min(mention_time) AS first_seen, max(mention_time) AS last_seen, string_agg(document_id::VARCHAR, '|' ORDER BY document_id) AS document_ids FROM j GROUP BY 1),
p AS (SELECT event, v, row_number() OVER (PARTITION BY event ORDER BY count(*) DESC, v) AS r FROM (SELECT event, unnest(persons) AS v FROM j) GROUP BY 1, 2), people AS (SELECT event, string_agg(v, '|' ORDER BY r) AS people FROM p WHERE r <= 10 GROUP BY 1),
w AS (SELECT event, theme, round(count(*) * idf, 9) AS weight FROM (SELECT event, unnest(themes) AS theme FROM j) JOIN idf USING (theme) GROUP BY event, theme, idf),
t AS (SELECT event, string_agg(theme, '|' ORDER BY theme) AS themes, round(sum(weight), 6) AS weight FROM w GROUP BY 1)
SELECT base.*, coalesce(people, '') AS people, coalesce(themes, '') AS themes, round(coalesce(weight, 0.0), 6) AS weight, upper(p_name) AS actor FROM base LEFT JOIN people USING (event) LEFT JOIN t USING (event) LEFT JOIN part ON p_partkey = event""")
def atomic_events(spark: SparkSession, d: str) -> DataFrame:
    mentions, docs = _documents(spark, d)
    links = documents.build_document_events(mentions, docs)
    found = documents.build_atomic_events(links, docs, _event_rows(spark, d), similarity.theme_idf(docs))
    weight = F.aggregate("top_themes", F.lit(0.0), lambda a, x: a + x["weight"])
    return found.select(
        F.col("GlobalEventID").alias("event"), "document_count", "source_count", "effective_source_count", "publisher_country_count", *[_r(c).alias(c) for c in ("confidence_mean", "confidence_median", "raw_text_rate", "gkg_coverage")],
        _time("first_seen"), _time("last_seen"), _joined(F.col("document_ids")).alias("document_ids"), F.array_join("people", "|").alias("people"), F.array_join(F.array_sort(F.col("top_themes.theme")), "|").alias("themes"), _r(weight).alias("weight"), F.col("Actor1Name").alias("actor"),
    )


_TYPE_OF = {"PROTEST": "protest", "PROTEST_MARCH": "protest", "ECON_STOCK": "economy_business", "WILDFIRE": "fire", "DISASTER_FIRE": "fire", "ENV_OIL": "environment_climate", "ELECTION_DAY": "election"}


@query(f"""WITH {_LINKS}, members AS (SELECT domain AS cluster, document_id, themes FROM docs), n AS (SELECT cluster, count(*) AS n FROM members GROUP BY 1),
themed AS (SELECT DISTINCT cluster, document_id, type FROM (SELECT cluster, document_id, unnest(themes) AS theme FROM members) JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _TYPE_OF.items())}) AS k(theme, type) USING (theme)),
coded AS (SELECT DISTINCT domain AS cluster, document_id, type FROM links JOIN docs USING (document_id) JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in CAMEO_ROOT_TYPES.items())}) AS k(code, type) ON code = (10 + event % 11)::VARCHAR),
s AS (SELECT cluster, type, count(*) / any_value(n) AS share FROM themed JOIN n USING (cluster) GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.3 UNION ALL SELECT cluster, type, count(*) / any_value(n) FROM coded JOIN n USING (cluster) GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.5),
b AS (SELECT cluster, type, max(share) AS share, row_number() OVER (PARTITION BY cluster ORDER BY max(share) DESC, type) AS r FROM s GROUP BY 1, 2)
SELECT cluster, string_agg(type, '|' ORDER BY r) AS event_types, round(sum(share), 6) AS share FROM b WHERE r <= 3 GROUP BY 1""")
def event_types(spark: SparkSession, d: str) -> DataFrame:
    """Outlets as clusters: types by their documents' themes and by their events' codes."""
    mentions, docs = _documents(spark, d)
    members = docs.select(F.col("domain").alias("cluster"), "document_id", "themes")
    coded = documents.build_document_events(mentions, docs).join(members.select("cluster", "document_id"), "document_id")
    found = attention.event_types(members, coded.withColumn("EventRootCode", _s(10 + F.col("GlobalEventID") % 11)))
    share = F.aggregate("event_type_shares", F.lit(0.0), lambda a, x: a + x)
    return found.select("cluster", F.array_join("event_types", "|").alias("event_types"), _r(share).alias("share"))


@query(f"""WITH {_MENTIONS}, hosts AS (SELECT host AS domain FROM mentions UNION SELECT host FROM urls), names AS (SELECT host AS domain, 'src' || (page_id % 20) AS name FROM events, pages_n JOIN urls ON page_id = event_id % n WHERE event_id % 50 <> 7 UNION ALL SELECT host, 'Name ' || (page_id % 3) FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY page_id) AS r FROM urls) WHERE r = 1),
k AS (SELECT domain, name, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, name) AS r FROM names WHERE domain <> '' GROUP BY 1, 2)
SELECT domain, name AS publisher_name, CASE WHEN domain = 'example.org' OR ends_with(domain, '.example.org') THEN 'OR' END AS publisher_country, CASE WHEN domain = 'example.org' THEN 0.9 WHEN ends_with(domain, '.example.org') THEN 0.7 ELSE 0.0 END::DOUBLE AS country_confidence FROM k WHERE r = 1""")
def built_sources(spark: SparkSession, d: str) -> DataFrame:
    lookup = spark.sql("SELECT 'example.org' AS domain, 'OR' AS country")
    return ingest.build_sources(_read_mentions(spark, d)[0], _typed_gkg(spark, d), lookup).drop("mapping_method")


@query(f"WITH {_MENTIONS} SELECT count(*) AS rows, count(DISTINCT canonical_url) AS urls, min(mention_time) AS first, max(mention_time) AS last, 0::BIGINT AS null_ids FROM mentions")
def preprocess_summary(spark: SparkSession, d: str) -> DataFrame:
    mentions, docs = _documents(spark, d)
    one = ingest.preprocess_summary(mentions, _event_rows(spark, d), _typed_gkg(spark, d), docs.withColumn("mapping_method", F.lit("x")))["mentions"]
    return one.withColumns({"first": _time("first"), "last": _time("last")})


# ---------------------------------------------------------------- families and store


@query("""WITH s AS (SELECT o_custkey AS id, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT x.id AS "left", y.id AS "right" FROM s x JOIN s y ON y.id = x.id + 1 WHERE greatest(date_diff('second', y.b, x.a), date_diff('second', x.b, y.a)) <= 86400 * 30""")
def family_gap(spark: SparkSession, d: str) -> DataFrame:
    members = _t(spark, d, "orders").select(F.col("o_custkey").alias("incident_id"), F.col("o_orderdate").alias("first_seen"))
    ids = members.select(F.col("incident_id").alias("left")).distinct()
    pairs = ids.withColumn("right", F.col("left") + 1).join(ids.select(F.col("left").alias("right")), "right", "left_semi").select("left", "right")
    return families.within_gap(pairs, families.spans(members), 24.0 * 30)


@query("SELECT source AS incident_id, lang AS language FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1")
def dominant_language(spark: SparkSession, d: str) -> DataFrame:
    return families.dominant_language(_t(spark, d, "documents").select(F.col("source").alias("incident_id"), F.col("lang").alias("language")))


@query(rf"""WITH {catalogue._WORDS}, c AS (SELECT host, w, row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, w) AS r FROM words WHERE NOT (regexp_matches(w, '^[0-9a-f]+$') AND regexp_matches(w, '\d') AND regexp_matches(w, '[a-f]')) AND NOT regexp_full_match(w, '\d+') AND w NOT IN ({", ".join(f"'{w}'" for w in LABEL_STOP)}) GROUP BY 1, 2)
SELECT host AS cluster, string_agg(w, ' ' ORDER BY r) AS label FROM c WHERE r <= 5 GROUP BY 1""")
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "pages").select(urls.url_domain(F.col("url")).alias("cluster"), F.substring_index(urls.canonical_url(F.col("url")), "?", 1).alias("canonical_url"))
    return store.labels(pages)


@query("""WITH p AS (SELECT c_mktsegment AS cluster, 'N' || c_nationkey AS c, count(*) AS n, median(c_acctbal) AS lat, median(c_custkey) AS lon FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1, 2)
SELECT cluster, c AS event_country, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, c) AS r FROM p) WHERE r = 1""")
def dominant_place(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit("N"), _s("c_nationkey")))
    rows = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("cluster"), place.alias("ActionGeo_CountryCode"), F.col("c_acctbal").alias("ActionGeo_Lat"), F.col("c_custkey").cast("double").alias("ActionGeo_Long"))
    return store.dominant_place(rows)


@query("""WITH f AS (SELECT l_orderkey, l_partkey, l_quantity, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC NULLS FIRST, l_partkey) AS r FROM (SELECT l_orderkey, l_partkey, max(l_quantity) AS l_quantity, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2))
SELECT CASE WHEN o_custkey % 100 < 50 THEN o_custkey % 100 * 2 ELSE -1 END::BIGINT AS macro_event_id, o_orderkey AS document_id, o_custkey % 100 AS incident_id, l_partkey AS event, l_quantity AS confidence, o_orderpriority AS source_domain, o_orderdate AS observed_time, o_totalprice > 100000 AS is_primary FROM orders LEFT JOIN f ON l_orderkey = o_orderkey AND r = 1""")
def macro_event_documents(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    docs = o.select(
        F.col("o_orderkey").alias("document_id"), F.lit("u").alias("canonical_url"), F.lit("t").alias("title"), F.lit("eng").alias("language"), F.col("o_orderpriority").alias("domain"), F.lit("X").alias("publisher_country"),
        F.lit(1.0).alias("publisher_country_confidence"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderkey").alias("wire_group"),
    )
    incident = F.col("o_custkey") % 100
    membership = o.select(F.col("o_orderkey").alias("document_id"), incident.alias("incident_id"), (incident % 10).alias("family_id"), F.lit(1.0).alias("assignment_score"), (F.col("o_totalprice") > 100000).alias("is_primary"))
    events = membership.select("incident_id").distinct().where("incident_id < 50").withColumn("macro_event_id", F.col("incident_id") * 2)
    links = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("GlobalEventID")).agg(F.max("l_quantity").alias("confidence"), F.max("l_linenumber").alias("in_raw_text"))
    out = store.event_documents(docs, membership, events, links)
    return out.select("macro_event_id", "document_id", "incident_id", F.col("GlobalEventID").alias("event"), "confidence", "source_domain", _time("observed_time"), "is_primary")


@query(f"WITH {_DOCUMENTS} SELECT count(*) AS documents, count(DISTINCT wire) AS effective_reports, min(first_seen) AS window_start, max(last_seen) AS window_end, (SELECT count(*) FROM customer) AS macro_events, (SELECT count(DISTINCT c_nationkey) FROM customer) AS families FROM docs")
def store_meta(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "customer").select(F.col("c_nationkey").alias("family_id"))
    return store.meta(_documents(spark, d)[1], events).withColumns({"window_start": _time("window_start"), "window_end": _time("window_end")})


# ---------------------------------------------------------------- codes and sinks

_ROOTS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in EVENT_ROOT_CODES.items())
_ENDINGS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TLD_COUNTRIES.items())


@query(f"""WITH x AS (SELECT event_id, lpad((event_id % 23)::VARCHAR, 2, '0') AS code, ['de', 'fr', 'zz', 'com'][1 + event_id % 4] AS tld FROM events)
SELECT event_id, coalesce(root, 'Unknown') AS root, coalesce(country, '') AS country, ['German', 'English', 'xyz', 'French'][1 + event_id % 4] AS language, 'elan nandu ' || event_id AS folded FROM x LEFT JOIN (VALUES {_ROOTS}) AS r(code, root) USING (code) LEFT JOIN (VALUES {_ENDINGS}) AS t(tld, country) USING (tld)""")
def text_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + k % 4).cast("int"))
    info = pick(["srclc:deu;eng:GT", "", "x;srclc:XYZ", "srclc:fra"])
    return _t(spark, d, "events").select(
        "event_id", text.root_label(F.lpad(_s(k % 23), 2, "0")).alias("root"), urls.country_of_tld(F.concat(F.lit("Paper."), pick(["DE", "fr", "zz", "com"]))).alias("country"),
        text.language_name(info).alias("language"), text.fold(F.concat(F.lit("ÉLAN Ñandú "), _s(k))).alias("folded"),
    )


@query("SELECT unnest(['csv', 'json', 'parquet', 'shards']) AS sink, count(*) AS rows, count(DISTINCT c_name) AS names, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1")
def sinks_read_back(spark: SparkSession, d: str) -> DataFrame:
    """A table through every sink and back; the shards in two runs, the second of which has nothing to do."""
    c, path = _t(spark, d, "customer").select("c_custkey", "c_name"), scratch(spark, "sinks")
    sinks.write_csv(c, f"{path}/csv")
    sinks.write_json_lines(c, f"{path}/json")
    sinks.write_table(c, f"{path}/parquet")
    for _ in range(2):
        sinks.write_shards(c, f"{path}/shards", "c_custkey", 3, lambda x: x)
    schema = "c_custkey long, c_name string"
    back = {
        "csv": spark.read.schema(schema).option("header", True).csv(f"{path}/csv"), "json": raw.json_lines(spark, f"{path}/json", schema), "parquet": spark.read.parquet(f"{path}/parquet"),
        "shards": spark.read.parquet(f"{path}/shards").select("c_custkey", "c_name"),
    }
    out = [x.agg(F.lit(k).alias("sink"), F.count("*").alias("rows"), F.count_distinct("c_name").alias("names"), F.sum("c_custkey").alias("keys")).select("sink", "rows", "names", "keys") for k, x in back.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 150000 AND o_custkey % 3 <> 0")
def retained_orders(spark: SparkSession, d: str) -> DataFrame:
    resolved = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, "X").alias("publisher_country"), (F.col("o_totalprice") / 300000).alias("publisher_country_confidence"))
    return filters.country_resolved(resolved, 0.5).select("o_orderkey")


# ---------------------------------------------------------------- places and titles


@query("""WITH found AS (SELECT DISTINCT o_orderkey, o_totalprice AS tone, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'),
located AS (SELECT 'u' || o_orderkey AS url, tone, 'P' || p_size AS name, p_partkey, p_type AS root FROM found JOIN part ON p_partkey = l_partkey WHERE p_partkey % 7 <> 0 AND p_size % 10 <> 0),
u AS (SELECT name, string_agg(url, '|' ORDER BY url) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY url) AS r FROM (SELECT DISTINCT name, url FROM located)) WHERE r <= 5 GROUP BY 1),
m AS (SELECT name, root AS theme, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, root) AS r FROM located GROUP BY 1, 2)
SELECT name, (min(p_partkey) % 90)::DOUBLE AS lat, (min(p_partkey) % 180)::DOUBLE AS lon, count(DISTINCT url) AS "count", round(round(avg(tone), 3), 1) AS tone, any_value(m.theme) AS theme, any_value(urls) AS urls FROM located JOIN u USING (name) JOIN (SELECT name, theme FROM m WHERE r = 1) m USING (name) GROUP BY 1""")
def geo_places(spark: SparkSession, d: str) -> DataFrame:
    """Places of open orders' parts; 500 places at most is the feature."""
    li, o = _t(spark, d, "lineitem"), _t(spark, d, "orders").where("o_orderstatus = 'P'")
    ids = li.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("eventids"))
    found = o.join(ids, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("u"), _s("o_orderkey")).alias("url"), F.lit("t").alias("title"), F.col("o_totalprice").alias("tone"), "eventids")
    k = F.col("p_partkey")
    events = _t(spark, d, "part").select(
        k.alias("GlobalEventID"), F.when(F.col("p_size") % 10 != 0, F.concat(F.lit("P"), _s("p_size"))).otherwise("").alias("ActionGeo_FullName"), F.when(k % 7 != 0, (k % 90).cast("double")).alias("ActionGeo_Lat"),
        (k % 180).cast("double").alias("ActionGeo_Long"), F.col("p_type").alias("root_label"),
    )
    return explorer.places(found, events).select(F.col("ActionGeo_FullName").alias("name"), "lat", "lon", "count", _r("tone", 1).alias("tone"), "theme", _joined(F.col("urls")).alias("urls"))


@query("SELECT o_orderkey AS document_id, (o_custkey % 100)::DOUBLE AS first, len(o_orderpriority || (o_custkey % 100)::VARCHAR)::DOUBLE AS second FROM orders WHERE o_orderstatus <> 'O'")
def title_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every different title goes through the encoder once; here the encoder is an expression."""
    title = F.when(F.col("o_orderstatus") != "O", F.concat("o_orderpriority", _s(F.col("o_custkey") % 100)))
    docs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), title.alias("title"))
    number = F.regexp_extract("title", r"(\d+)$", 1).cast("double")
    vec = payloads.title_vectors(docs, lambda t: t.withColumn("vector", F.array(number, F.length("title").cast("double"))))
    return vec.select("document_id", F.col("vector")[0].alias("first"), F.col("vector")[1].alias("second"))


# ---------------------------------------------------------------- earlier generations and evaluation


def _batch(spark: SparkSession, d: str) -> DataFrame:
    country = F.concat(F.lit("G"), _s(F.col("user_id") % 4))
    return _t(spark, d, "events").select(F.col("ts").cast("timestamp").alias("batch_time"), country.alias("country"), _s("user_id").alias("source"), _s("event_id").alias("title"))


@query("""SELECT date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts))::INT AS hours_after, count(*) FILTER (user_id % 4 = 0) AS G0, count(*) FILTER (user_id % 4 = 1) AS G1, count(*) FILTER (user_id % 4 = 3) AS G3
FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1""")
def hourly_pivot(spark: SparkSession, d: str) -> DataFrame:
    return prototypes.hourly_pivot(_batch(spark, d), "2024-01-01 00:00:00", ["G0", "G1", "G3"])


@query("""SELECT country, hours_after, source, title FROM (SELECT 'G' || (user_id % 4) AS country, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts))::INT AS hours_after, user_id::VARCHAR AS source, event_id::VARCHAR AS title,
  row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, user_id::VARCHAR, event_id::VARCHAR) AS r FROM events) WHERE r = 1""")
def first_per_country(spark: SparkSession, d: str) -> DataFrame:
    return prototypes.first_per_country(_batch(spark, d), "2024-01-01 00:00:00")


@query("""WITH m AS (SELECT o_custkey % 7 AS c, regexp_matches(o_orderpriority, 'URGENT|HIGH') AS hit, o_orderstatus FROM orders), b AS (SELECT c FROM m WHERE hit AND o_orderstatus = 'F' GROUP BY 1 ORDER BY count(*) DESC, c LIMIT 1)
SELECT b.c AS event_cluster, count(*) FILTER (m.c = b.c) AS size, round(count(*) FILTER (m.c = b.c AND hit) / count(*) FILTER (m.c = b.c), 6) AS purity, round(count(*) FILTER (m.c = b.c AND hit) / count(*) FILTER (hit), 6) AS recall FROM m, b GROUP BY b.c""")
def event_report(spark: SparkSession, d: str) -> DataFrame:
    members = _t(spark, d, "orders").select((F.col("o_custkey") % 7).alias("cluster"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("country"))
    return prototypes.event_report(members, "URGENT|HIGH", "F").withColumns({c: _r(c) for c in ("purity", "recall")})


@query("""WITH w AS (SELECT o_custkey % 10 AS cluster, l_partkey AS f, sum(l_quantity) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, f) AS r FROM w)
SELECT cluster, string_agg(f::VARCHAR, '|' ORDER BY r) AS terms FROM r WHERE r <= 12 GROUP BY 1""")
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    weights = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("feature"), F.col("l_quantity").alias("weight"))
    members = _t(spark, d, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 10).alias("cluster"))
    return prototypes.top_terms(weights, members).withColumn("terms", _joined(F.col("terms")))


@query("SELECT p_type, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_type <> '' GROUP BY 1 ORDER BY n DESC, p_type LIMIT 3")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent labels: the limit is the feature."""
    ids = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("GlobalEventID"))
    return prototypes.label_counts(_t(spark, d, "part").select(F.col("p_partkey").alias("GlobalEventID"), "p_type"), ids, "p_type", 3)


@query("""SELECT o_custkey % 50 - 1 AS cluster, count(*) AS articles, count(DISTINCT o_custkey) AS canonical_articles, count(DISTINCT nullif(o_orderstatus, 'P')) AS domains, round(date_diff('second', min(o_orderdate), max(o_orderdate)) / 3600.0, 6) AS span_hours
FROM orders WHERE o_custkey % 50 > 0 GROUP BY 1""")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    domain = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("")
    members = o.select((F.col("o_custkey") % 50 - 1).alias("cluster"), F.col("o_custkey").alias("canonical"), domain.alias("domain"), F.col("o_orderdate").cast("timestamp").alias("first_seen"))
    return evaluation.cluster_sizes(members).withColumn("span_hours", _r("span_hours"))


@query("""WITH x AS (SELECT o_orderpriority AS g, o_orderstatus = 'F' AS story, o_custkey % 9 - 1 AS family FROM orders), t AS (SELECT g, count(*) AS documents, count(*) FILTER (family < 0) AS unassigned FROM x WHERE story GROUP BY 1),
h AS (SELECT g, family, count(*) AS held, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, family) AS r FROM x WHERE story AND family >= 0 GROUP BY 1, 2), s AS (SELECT g, family, count(*) AS n FROM x GROUP BY 1, 2)
SELECT t.g AS neighborhood, documents, unassigned, h.family AS main_family, round(held / documents, 6) AS recall, round(held / n, 6) AS purity FROM t JOIN h ON t.g = h.g AND r = 1 JOIN s ON s.g = h.g AND s.family = h.family""")
def neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("neighborhood"), (F.col("o_orderstatus") == "F").alias("gold_story"), (F.col("o_custkey") % 9 - 1).alias("family_id"))
    return evaluation.neighbourhoods(rows).withColumns({c: _r(c) for c in ("recall", "purity")})


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size / 50.0 ELSE 0.0 END AS e, p_size % 3 > 0 AS eb, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 100) / 100.0 ELSE 0.0 END AS u, p_partkey % 4 > 0 AS ub FROM part),
m AS (SELECT *, CASE WHEN eb OR ub THEN (e + u) / (eb::INT + ub::INT) ELSE 0.0 END AS mean FROM p)
SELECT p_partkey, round(mean, 6) AS combined, round(CASE WHEN (e > 0)::INT + (u > 0)::INT >= 2 OR greatest(e, u) >= 0.6 THEN mean ELSE 0.0 END, 6) AS gated FROM m""")
def mean_gate(spark: SparkSession, d: str) -> DataFrame:
    k, e, u = F.col("p_partkey"), F.col("p_size") % 3 > 0, F.col("p_partkey") % 4 > 0
    rows = _t(spark, d, "part").select(
        k, e.alias("event_both"), u.alias("url_both"), F.when(e, F.col("p_size") / 50).otherwise(0.0).alias("event_score"), F.when(u, (k % 100) / 100).otherwise(0.0).alias("url_score"),
    )
    return similarity.mean_gate(rows, ["event", "url"]).select("p_partkey", _r("combined").alias("combined"), _r("gated").alias("gated"))


@query("""SELECT s_suppkey AS run, CASE WHEN s_suppkey % 10 < 8 THEN round(0.45 * (s_suppkey % 7) / 7 + 0.25 * (s_suppkey % 5) / 5 + 0.15 * (s_suppkey % 3) / 3 + 0.15 * (s_suppkey % 2) / 2, 6) ELSE -1.0 END AS objective FROM supplier""")
def sweep_selection(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    metrics = _t(spark, d, "supplier").select(
        k.alias("run"), ((k % 7) / 7).alias("pair_fam_p"), ((k % 5) / 5).alias("pair_fam_f1"), ((k % 3) / 3).alias("b3_fam_f1"), ((k % 2) / 2).alias("pair_inc_f1"), F.when(k % 10 < 8, 0.05).otherwise(0.5).alias("unassigned"),
    )
    return evaluation.selection(metrics).select("run", F.when(F.col("objective") > float("-inf"), _r("objective")).otherwise(-1.0).alias("objective"))


@query("""WITH f AS (SELECT o_custkey % 200 AS g, unnest(['p' || (o_custkey % 37), 'o' || (o_orderkey % 11)]) AS f FROM orders WHERE o_orderstatus <> 'P'), r AS (SELECT g, f, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, f) AS r FROM f GROUP BY 1, 2),
t AS (SELECT g, f FROM r WHERE r <= 10), s AS (SELECT g, count(*) AS n FROM t GROUP BY 1), few AS (SELECT f FROM t GROUP BY 1 HAVING count(*) <= 50),
l AS (SELECT DISTINCT a.g AS "left", b.g AS "right" FROM t a JOIN t b ON a.f = b.f AND a.g < b.g WHERE a.f IN (SELECT f FROM few)), c AS (SELECT "left", "right", count(*) AS shared FROM l JOIN t a ON a.g = "left" JOIN t b ON b.g = "right" AND a.f = b.f GROUP BY 1, 2)
SELECT "left", "right", round(shared / (x.n + y.n - shared), 6) AS weight FROM c JOIN s x ON x.g = "left" JOIN s y ON y.g = "right" WHERE shared / (x.n + y.n - shared) >= 0.2""")
def entity_links(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    persons, organizations = F.array(F.concat(F.lit("p"), _s(F.col("o_custkey") % 37))), F.array(F.concat(F.lit("o"), _s(F.col("o_orderkey") % 11)), F.lit(None).cast("string"))
    members = o.select((F.col("o_custkey") % 200).alias("incident_id"), (F.col("o_orderstatus") != "P").alias("has_gkg"), persons.alias("persons"), organizations.alias("organizations"))
    return families.entity_links(members).withColumn("weight", _r("weight"))
