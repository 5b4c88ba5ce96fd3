"""Registered queries of audits, feature rows, the explorer, the store's answers, file windows and streams.

Orders stand for documents: their customers' numbers give incidents and families, and an
order and the next one are a scored pair.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import urls
from newsloom.functions.fixed import EVENT_COLUMNS, EVENT_ROOT_CODES, MENTION_COLUMNS, STOPWORDS, TLD_COUNTRIES
from newsloom.operators import evaluation, families, filters, responses, similarity
from newsloom.plans import catalogue, explorer, ingest, prototypes, resolve, serving
from newsloom.plans.catalogue import query
from newsloom.plans.catalogue_news import _MENTIONS, _mention_lines, _raw_rows, _s
from newsloom.plans.cutpoint import materialize, scratch
from newsloom.sources import raw
from newsloom.streaming import news

_t, _r, _time, _joined = catalogue._t, catalogue._r, catalogue._time, catalogue._joined


# ---------------------------------------------------------------- pairs and their audits


def _members(spark: SparkSession, d: str) -> DataFrame:
    incident = F.col("o_custkey") % 50 - 1
    return _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("document_id"), incident.alias("incident_id"), F.when(incident >= 0, incident % 10).otherwise(-1).cast("long").alias("family_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("language"), (F.col("o_totalprice") / 300000).alias("assignment_score"),
    )


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("left"))
    k = F.col("left")
    score = {"title": (k % 10) / 10, "event": (k % 7) / 7, "url": (k % 3) / 3, "entity": (k % 4) / 4}
    rows = o.withColumn("right", k + 1).join(o.select(k.alias("right")), "right", "left_semi")
    rows = rows.select("left", "right", *[v.alias(f"{n}_score") for n, v in score.items()], *[(k % m == 0).alias(f"from_{n}") for n, m in (("event", 2), ("title", 3))])
    evidence = sum(((F.col(f"{n}_score") > 0).cast("int") for n in score), F.lit(0))
    return rows.withColumn("evidence_channels", evidence).withColumn("gated", F.when(k % 5 > 0, (k % 100) / 100).otherwise(0.0))


_MEMBERS = """mem AS (SELECT o_orderkey AS id, o_custkey % 50 - 1 AS inc, CASE WHEN o_custkey % 50 > 0 THEN (o_custkey % 50 - 1) % 10 ELSE -1 END::BIGINT AS fam,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS title, o_orderstatus AS lang, o_totalprice / 300000 AS score FROM orders)"""
_PAIRS = f"""{_MEMBERS}, p AS (SELECT k AS l, k + 1 AS r, (k % 10) / 10 AS ts, (k % 7) / 7 AS es, (k % 3) / 3 AS us, (k % 4) / 4 AS ns, k % 2 = 0 AS fe, k % 3 = 0 AS ft,
  CASE WHEN k % 5 > 0 THEN (k % 100) / 100 ELSE 0.0 END AS gated FROM (SELECT o_orderkey AS k FROM orders) WHERE k + 1 IN (SELECT o_orderkey FROM orders)),
x AS (SELECT p.*, a.inc AS il, b.inc AS ir, a.fam AS fl, b.fam AS fr, a.lang AS ll, b.lang AS lr, (ts > 0)::INT + (es > 0)::INT + (us > 0)::INT + (ns > 0)::INT AS ev FROM p JOIN mem a ON a.id = l JOIN mem b ON b.id = r)"""


@query(f"""WITH {_PAIRS} SELECT count(*) AS "cross", count(*) FILTER (ev = 1) AS single_channel, count(*) FILTER (us > 0 AND ts + es + ns = 0) AS url_only, count(*) FILTER (ns > 0 AND ts + es + us = 0) AS entity_only
FROM x WHERE gated > 0 AND il <> ir""")
def cross_edges(spark: SparkSession, d: str) -> DataFrame:
    return prototypes.cross_edges(_pairs(spark, d), _members(spark, d))


@query(f"""WITH {_PAIRS}, ends AS (SELECT id, count(*) AS n, avg(ts) AS t, avg((es > 0)::INT) AS e FROM (SELECT l AS id, ts, es FROM x WHERE gated > 0 AND il <> ir UNION ALL SELECT r, ts, es FROM x WHERE gated > 0 AND il <> ir) GROUP BY 1)
SELECT id AS document_id, n AS cross_incident_edges, round((title IS NULL)::INT + (id % 9 = 0)::INT + 0.25 * ln(1 + n) - t - e, 6) AS risk FROM ends JOIN mem USING (id)""")
def bridges(spark: SparkSession, d: str) -> DataFrame:
    members = _members(spark, d)
    found = prototypes.bridges(_pairs(spark, d), members, members.where("document_id % 9 = 0"))
    return found.select("document_id", "cross_incident_edges", _r("bridge_risk").alias("risk"))


@query(f"""WITH {_PAIRS}, e AS (SELECT id, count(*) AS n FROM (SELECT l AS id FROM x WHERE gated > 0 AND il = 3 AND ir = 3 UNION ALL SELECT r FROM x WHERE gated > 0 AND il = 3 AND ir = 3) GROUP BY 1)
SELECT id AS document_id, round(score, 6) AS score, coalesce(n, 0) AS edges FROM mem LEFT JOIN e USING (id) WHERE inc = 3""")
def incident_coverage(spark: SparkSession, d: str) -> DataFrame:
    """One incident's documents: the incident is the feature."""
    found = prototypes.incident_coverage(_members(spark, d), _pairs(spark, d), 3)
    return found.select("document_id", _r("assignment_score").alias("score"), "edges")


@query(f"WITH {_MEMBERS} SELECT fam AS family_id, count(*) AS hits FROM mem WHERE regexp_matches(title, 'URGENT|HIGH') AND fam >= 0 GROUP BY 1 ORDER BY hits DESC, fam LIMIT 1")
def pick_family(spark: SparkSession, d: str) -> DataFrame:
    """The family of most hits: one row is the feature."""
    return prototypes.pick_family(_members(spark, d), "URGENT|HIGH")


@query(f"""WITH {_MEMBERS}, h AS (SELECT *, coalesce(regexp_matches(title, 'URGENT|HIGH'), false) AS hit FROM mem)
SELECT inc AS incident_id, count(*) AS size, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 6) AS purity, round(count(*) FILTER (hit) / (SELECT count(*) FROM h WHERE hit), 6) AS recall
FROM h WHERE inc >= 0 GROUP BY 1 HAVING count(*) FILTER (hit) > 0""")
def run_inspection(spark: SparkSession, d: str) -> DataFrame:
    found = prototypes.run_inspection(_members(spark, d), "URGENT|HIGH")
    return found.select("incident_id", "size", "hits", _r("purity").alias("purity"), _r("recall").alias("recall"))


@query(f"WITH {_MEMBERS} SELECT id AS document_id, CASE WHEN inc >= 0 AND inc % 3 > 0 THEN inc * 7 ELSE -1 END AS family_id FROM mem")
def relabelled(spark: SparkSession, d: str) -> DataFrame:
    members = _members(spark, d)
    other = members.where("incident_id >= 0 and incident_id % 3 > 0").select("incident_id").distinct().withColumn("family_id", F.col("incident_id") * 7)
    return prototypes.relabelled(members, other).select("document_id", "family_id")


@query(f"WITH {_PAIRS} SELECT count(*) AS pairs, count(*) FILTER (l % 4 < 2) AS found, round(count(*) FILTER (l % 4 < 2) / count(*), 6) AS recall FROM x WHERE l % 3 = 0")
def candidate_recall(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    held = pairs.where("left % 4 < 2")
    return evaluation.candidate_recall(pairs.where("left % 3 = 0"), held.unionByName(held)).withColumn("recall", _r("recall"))


def _both(spark: SparkSession, d: str) -> DataFrame:
    """Pairs beside both documents' incident, family and language."""
    m = _members(spark, d)
    side = lambda k, e: m.select(F.col("document_id").alias(k), *[F.col(c).alias(f"{n}_{e}") for c, n in (("incident_id", "incident"), ("family_id", "family"), ("language", "language"))])
    return _pairs(spark, d).join(side("left", "l"), "left").join(side("right", "r"), "right")


_STRATA = f"""{_PAIRS}, strata AS (SELECT 'merged_cross_language' AS stratum, x.* FROM x WHERE il = ir AND ll <> lr AND ts < 0.6 UNION ALL SELECT 'merged_near_gate', x.* FROM x WHERE il = ir AND gated < 0.4
  UNION ALL SELECT 'sibling_incidents', x.* FROM x WHERE il <> ir AND fl = fr UNION ALL SELECT 'split_strong_title', x.* FROM x WHERE fl <> fr AND ts >= 0.5
  UNION ALL SELECT 'split_shared_event', x.* FROM x WHERE fl <> fr AND fe UNION ALL SELECT 'easy_negative', x.* FROM x WHERE fl <> fr AND ft AND ts < 0.2)"""


@query(f"WITH {_STRATA} SELECT stratum, l AS \"left\", r AS \"right\" FROM strata")
def pair_strata(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.pair_strata(_both(spark, d), evaluation.hard_strata()).select("stratum", "left", "right")


@query(f"""WITH {_STRATA} SELECT stratum, l AS "left", r AS "right" FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('2026:' || l || ':' || r), l, r) AS n FROM strata)
WHERE n <= CASE WHEN stratum = 'easy_negative' THEN 3 ELSE 8 END""")
def pair_samples(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of every stratum: the sample is the feature."""
    strata = evaluation.hard_strata()
    each = {name: 3 if name == "easy_negative" else 8 for name in strata}
    return evaluation.pair_strata(_both(spark, d), strata, each).select("stratum", "left", "right")


@query(f"""WITH {_PAIRS} SELECT l AS "left", round(CASE WHEN l % 6 = 0 THEN 3 ELSE 0 END + CASE WHEN (l % 6 = 1) <> (fl = fr) THEN 2 ELSE 0 END + CASE WHEN ll <> lr THEN 1 ELSE 0 END + greatest(0, 1 - abs(gated - 0.4) / 0.4), 6) AS hardness FROM x""")
def hardness(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("left") % 6 == 0, "related").when(F.col("left") % 6 == 1, "same_event").otherwise("unrelated")
    points = evaluation.hardness(label, F.col("family_l") == F.col("family_r"), F.col("language_l"), F.col("language_r"), F.col("gated"))
    return _both(spark, d).select("left", _r(points).alias("hardness"))


@query(f"""WITH {_PAIRS} SELECT l AS "left", round((es + us) / 2, 6) AS combined FROM x""")
def plain_mean(spark: SparkSession, d: str) -> DataFrame:
    return prototypes.plain_mean(_pairs(spark, d)).select("left", _r("combined").alias("combined"))


@query(f"""WITH {_PAIRS}, m AS (SELECT id, unnest([CASE WHEN regexp_matches(title, 'URGENT') THEN 'urgent' END, CASE WHEN regexp_matches(title, 'HIGH|LOW') THEN 'other' END]) AS story FROM mem),
gold AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'urgent' ELSE 'other' END AS story FROM mem WHERE id % 5 = 0), u AS (SELECT id, story FROM m WHERE story IS NOT NULL UNION SELECT * FROM gold),
e AS (SELECT DISTINCT a.story, l, r FROM p JOIN u a ON a.id = l JOIN u b ON b.id = r AND a.story = b.story),
reached AS (SELECT story, l AS id FROM e JOIN m USING (story) WHERE m.id = r UNION SELECT story, r FROM e JOIN m USING (story) WHERE m.id = l)
SELECT story, count(*) AS gold, count(reached.id) AS reached, round(count(reached.id) / count(*), 6) AS reach FROM gold LEFT JOIN reached USING (story, id) GROUP BY 1""")
def candidate_reach(spark: SparkSession, d: str) -> DataFrame:
    members = _members(spark, d)
    gold = members.where("document_id % 5 = 0").select("document_id", F.when(F.col("document_id") % 2 == 0, "urgent").otherwise("other").alias("story"))
    found = prototypes.candidate_reach(members, _pairs(spark, d), gold, {"urgent": "URGENT", "other": "HIGH|LOW"})
    return found.select("story", "gold", "reached", _r("reach").alias("reach"))


@query("SELECT o_custkey AS id, count(*) AS documents FROM orders GROUP BY 1 HAVING count(*) >= 12 AND count(DISTINCT o_orderpriority) >= 4 AND o_custkey % 4 > 0")
def retained_events(spark: SparkSession, d: str) -> DataFrame:
    """A group without a confidence isn't kept."""
    sizes = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("raw_documents"), F.count_distinct("o_orderpriority").alias("effective_reports"))
    rated = sizes.withColumn("cluster_confidence", F.when(F.col("id") % 4 > 1, 0.7).when(F.col("id") % 4 == 1, 0.5))
    return filters.retained(rated, 12, 4, 0.5).select("id", F.col("raw_documents").alias("documents"))


# ---------------------------------------------------------------- feature rows


@query("SELECT DISTINCT l_orderkey AS canonical, p_size AS cluster FROM lineitem JOIN part ON p_partkey = l_partkey")
def article_memberships(spark: SparkSession, d: str) -> DataFrame:
    links = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("canonical"), F.col("l_partkey").alias("GlobalEventID"))
    return prototypes.article_memberships(links, _t(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("community")))


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS e, l_quantity AS q, l_shipdate AS t FROM lineitem WHERE l_quantity >= 25), f AS (SELECT d, e, t FROM k WHERE e NOT IN (SELECT e FROM k GROUP BY 1 HAVING count(DISTINCT d) >= 20 AND date_diff('day', min(t), max(t)) >= 1500)),
u AS (SELECT DISTINCT d, e FROM f), n AS (SELECT e, count(*) AS n FROM u GROUP BY 1), s AS (SELECT e, min(t) AS t FROM f GROUP BY 1), pr AS (SELECT a.e AS l, b.e AS r, count(*) AS shared FROM u a JOIN u b ON a.d = b.d AND a.e < b.e GROUP BY 1, 2)
SELECT l AS "left", r AS "right", shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM pr JOIN n x ON x.e = l JOIN n y ON y.e = r JOIN s sx ON sx.e = l JOIN s sy ON sy.e = r WHERE abs(date_diff('second', sx.t, sy.t)) <= 86400 * 200""")
def event_graph(spark: SparkSession, d: str) -> DataFrame:
    links = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("canonical"), F.col("l_partkey").alias("GlobalEventID"), F.col("l_quantity").alias("Confidence"), F.col("l_shipdate").alias("MentionTimeDate"))
    s = prototypes.ProjectionSettings(confidence=25, recurring_articles=20, recurring_days=1500, gap_days=200, shared=1)
    return prototypes.event_graph(links, s).withColumn("jaccard", _r("jaccard"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS node, unnest(['actor:' || p_type, CASE WHEN p_size % 3 > 0 THEN 'actor:' || p_brand END, 'geo:' || p_name]) AS feature FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT node, o_orderdate::DATE AS day, feature FROM l JOIN orders ON o_orderkey = node WHERE feature IS NOT NULL""")
def label_rows(spark: SparkSession, d: str) -> DataFrame:
    links = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("canonical"), F.col("l_partkey").alias("GlobalEventID"))
    labels = _t(spark, d, "part").select(F.col("p_partkey").alias("GlobalEventID"), F.col("p_type").alias("Actor1Name"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise("").alias("Actor2Name"), F.col("p_name").alias("ActionGeo_FullName"))
    days = _t(spark, d, "orders").select(F.col("o_orderkey").alias("canonical"), F.col("o_orderdate").cast("date").alias("day"))
    return prototypes.label_rows(links, labels, days).select("node", "day", "feature")


@query("""WITH g AS (SELECT o_orderkey AS node, unnest(['p:a' || (o_custkey % 37), CASE WHEN o_custkey % 4 = 0 THEN 'p:common' END, 'o:u' || (o_orderkey % 29)]) AS feature FROM orders WHERE o_orderstatus <> 'P')
SELECT node, feature FROM g WHERE feature IS NOT NULL AND feature NOT IN (SELECT feature FROM g WHERE feature IS NOT NULL GROUP BY 1 HAVING count(*) > 0.1 * (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P'))""")
def entity_rows(spark: SparkSession, d: str) -> DataFrame:
    """People and organisations, without one that a quarter of the documents have."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    persons = F.array(F.concat(F.lit("a"), _s(c % 37)), F.when(c % 4 == 0, "common"))
    docs = _t(spark, d, "orders").select(k.alias("document_id"), (F.col("o_orderstatus") != "P").alias("has_gkg"), persons.alias("persons"), F.array(F.concat(F.lit("u"), _s(k % 29))).alias("organizations"))
    return resolve.entity_rows(docs).select("node", "feature")


_STOP = ", ".join("'{}'".format(w.replace("'", "''")) for w in sorted(STOPWORDS))


@query(rf"""WITH t AS (SELECT page_id % 5 AS cluster, unnest(list_distinct(regexp_extract_all(lower(url), '[\p{{L}}]{{3,}}|737'))) AS w FROM pages),
r AS (SELECT cluster, w, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, w) AS r FROM t WHERE w NOT IN ({_STOP}) GROUP BY 1, 2)
SELECT cluster, string_agg(w || ':' || n, ' ' ORDER BY r) AS words FROM r WHERE r <= 15 GROUP BY 1""")
def cluster_words(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "pages").select((F.col("page_id") % 5).alias("cluster"), F.lower("url").alias("slug"))
    said = F.transform("words", lambda x: F.concat_ws(":", x["w"], _s(x["n"])))
    return prototypes.cluster_words(pages).select("cluster", F.array_join(said, " ").alias("words"))


@query("""SELECT page_id, 'P:ann ' || (page_id % 7) || '|P:bob|O:un, new|L:Town ' || (page_id % 4) || '|E:' || page_id AS tokens, CASE WHEN page_id % 3 = 0 THEN 'fra' ELSE 'eng' END AS language,
  CASE WHEN page_id % 2 = 0 THEN 'Q & A ' || page_id ELSE '' END AS title, TIMESTAMP '2024-01-01 00:30:00' AS batch_time FROM pages""")
def entity_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The first version's columns: entities with prefixes, language, title, time of the file."""
    k = F.col("page_id")
    rows = _t(spark, d, "pages").select(
        k, F.concat(F.lit("ann "), _s(k % 7), F.lit(",12;;bob")).alias("persons"), F.lit("un, new,7").alias("organizations"), F.lit(None).cast("string").alias("all_names"),
        F.concat(F.lit("4#Town "), _s(k % 4), F.lit("#X")).alias("locations"), F.array(k).alias("event_ids"), F.lit("20240101003000").alias("batch_date"),
        F.when(k % 3 == 0, "srclc:fra;eng:GT").alias("translation_info"), F.when(k % 2 == 0, F.concat(F.lit("<A/><PAGE_TITLE>Q &amp; A "), _s(k), F.lit("</PAGE_TITLE>"))).alias("extras"),
    )
    return prototypes.derived(rows).select(k, F.array_join(prototypes.entity_tokens("POLE"), "|").alias("tokens"), "language", "title", _time("batch_time"))


@query("""WITH r AS (SELECT o_custkey % 200 AS g, unnest(['p' || (o_custkey % 37), 'o' || (o_orderkey % 11)]) AS f FROM orders WHERE o_orderstatus <> 'P'), k AS (SELECT g, f, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, f) AS r FROM r GROUP BY 1, 2)
SELECT g AS incident_id, 'n:' || f AS feature FROM k WHERE r <= 10 UNION SELECT DISTINCT o_custkey % 200, 'e:' || l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    persons, organizations = F.array(F.concat(F.lit("p"), _s(F.col("o_custkey") % 37))), F.array(F.concat(F.lit("o"), _s(F.col("o_orderkey") % 11)))
    members = o.select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 200).alias("incident_id"), (F.col("o_orderstatus") != "P").alias("has_gkg"), persons.alias("persons"), organizations.alias("organizations"))
    return families.corroboration(members, _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("GlobalEventID")))


# ---------------------------------------------------------------- explorer


def _explorer(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Parts as events, events as mentions of them, read as the files' strings."""
    k, e = F.col("p_partkey"), F.col("event_id")
    cells = lambda rows, columns, values, *keep: rows.select(*[(values[c] if c in values else F.lit(None).cast("string")).alias(c) for c in columns])
    events = explorer.build_events(cells(_t(spark, d, "part"), EVENT_COLUMNS, {
        "GlobalEventID": _s(k), "Day": F.lit("20240101"), "QuadClass": _s(1 + k % 4), "NumMentions": _s(k % 9), "NumSources": F.lit("x"), "NumArticles": _s(k % 5), "GoldsteinScale": F.lit("1.5"), "AvgTone": _s(k % 13),
        "ActionGeo_Lat": _s(k % 90), "DATEADDED": F.lit("20240101003000"), "Actor1Name": F.upper("p_name"), "ActionGeo_FullName": F.when(k % 6 > 0, F.concat(F.lit("Town "), _s(k % 6))),
        "ActionGeo_CountryCode": F.concat(F.lit("n"), _s(k % 5)), "EventCode": F.lit("010"), "EventRootCode": F.lpad(_s(1 + k % 21), 2, "0"), "SOURCEURL": F.lit("u"),
    }))
    n = _t(spark, d, "part").count()
    articles, links = explorer.build_articles(cells(_t(spark, d, "events"), MENTION_COLUMNS, {
        "GlobalEventID": _s(e % n), "MentionType": F.when(F.col("event_type") == "error", "2").otherwise("1"), "Confidence": _s(10 + e % 90), "MentionDocLen": _s(e), "MentionTimeDate": F.date_format(F.col("ts").cast("timestamp"), "yyyyMMddHHmmss"),
        "MentionSourceName": F.concat("event_type", F.lit(".de")), "MentionIdentifier": F.concat(F.lit("http://"), "event_type", F.lit(".de/story-number-"), _s("user_id")),
    }), events)
    return {"articles": articles, "article_events": links, "events": events}


_ROOTS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in EVENT_ROOT_CODES.items())
_EXPLORER = f"""ev AS (SELECT p_partkey AS id, upper(p_name) AS actor, CASE WHEN p_partkey % 6 > 0 THEN 'Town ' || (p_partkey % 6) ELSE '' END AS place, 1 + p_partkey % 4 AS quad, p_partkey % 13 AS tone, lpad((1 + p_partkey % 21)::VARCHAR, 2, '0') AS root,
  p_partkey % 9 AS mentions, p_partkey % 5 AS articles, 'n' || (p_partkey % 5) AS country, coalesce(label, 'Unknown') AS theme FROM part LEFT JOIN (VALUES {_ROOTS}) AS r(code, label) ON code = lpad((1 + p_partkey % 21)::VARCHAR, 2, '0')),
men AS (SELECT event_id % (SELECT count(*) FROM part) AS id, 10 + event_id % 90 AS confidence, event_id AS len, date_trunc('second', ts) AS seen, event_type || '.de' AS domain, 'http://' || event_type || '.de/story-number-' || user_id AS url, 'story number ' || user_id AS title
  FROM events WHERE event_type <> 'error'),
told AS (SELECT url, array_to_string(list_sort(list_distinct(list(actor))), '|') AS actors, array_to_string(list_sort(list_distinct(list(place) FILTER (place <> ''))), '|') AS locations, array_to_string(list_sort(list_distinct(list(theme))), '|') AS themes,
  array_to_string(list_sort(list_distinct(list(quad))), '|') AS quads, round(avg(tone), 6) AS event_tone FROM (SELECT DISTINCT url, id FROM men) JOIN ev USING (id) GROUP BY 1),
art AS (SELECT url, min(seen) AS seendate, any_value(domain) AS domain, any_value(title) AS title, max(len) AS doclen, max(confidence) AS confidence, count(DISTINCT id) AS numevents FROM men GROUP BY 1)"""


@query(f"WITH {_EXPLORER} SELECT id AS event, actor, place, quad, mentions, articles, tone::DOUBLE AS tone, theme, country FROM ev")
def explorer_events(spark: SparkSession, d: str) -> DataFrame:
    return _explorer(spark, d)["events"].where("NumSources is null and Actor2Name = ''").select(
        F.col("GlobalEventID").alias("event"), F.col("Actor1Name").alias("actor"), F.col("ActionGeo_FullName").alias("place"), F.col("QuadClass").alias("quad"), F.col("NumMentions").alias("mentions"), F.col("NumArticles").alias("articles"),
        F.col("AvgTone").alias("tone"), F.col("root_label").alias("theme"), F.col("ActionGeo_CountryCode").alias("country"),
    )


@query(f"""WITH {_EXPLORER} SELECT url, seendate, domain, title, doclen, confidence, numevents::INT AS numevents, coalesce(actors, '') AS actors, coalesce(locations, '') AS locations, coalesce(themes, '') AS themes, coalesce(quads, '') AS quads, event_tone,
  '{TLD_COUNTRIES["de"]}' AS sourcecountry FROM art LEFT JOIN told USING (url)""")
def explorer_articles(spark: SparkSession, d: str) -> DataFrame:
    return _explorer(spark, d)["articles"].select(
        "url", _time("seendate"), "domain", "title", "doclen", "confidence", "numevents", *[_joined(F.col(c)).alias(c) for c in ("actors", "locations", "themes")], _joined(F.col("quadclasses")).alias("quads"), _r("event_tone").alias("event_tone"), "sourcecountry",
    )


@query(f"""WITH {_EXPLORER} SELECT id AS event, articles, mentions FROM ev WHERE quad = 2 AND country = 'n1' AND id IN (SELECT men.id FROM men JOIN art USING (url) WHERE contains(art.domain, 'click') AND art.seendate BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-20') ORDER BY articles DESC, mentions DESC, id LIMIT 20""")
def explorer_event_list(spark: SparkSession, d: str) -> DataFrame:
    """A request's window, search and filters; twenty rows at most are the feature."""
    request = explorer.Request("domain:click", "20240101", "20240120")
    found = explorer.Explorer(_explorer(spark, d)).event_list(request, quadclass=2, country="N1", limit=20)
    return found.select(F.col("GlobalEventID").alias("event"), F.col("NumArticles").alias("articles"), F.col("NumMentions").alias("mentions"))


_SORTED = {"datedesc": "seen DESC", "dateasc": "seen", "tonedesc": "tone DESC NULLS LAST", "toneasc": "tone NULLS LAST", "hybridrel": "numevents DESC NULLS LAST"}


@query("WITH a AS (SELECT o_orderkey AS url, o_orderdate AS seen, CASE WHEN o_custkey % 3 > 0 THEN o_totalprice END AS tone, CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS numevents FROM orders) "
       + " UNION ALL ".join(f"SELECT '{k}' AS way, * FROM (SELECT url FROM a ORDER BY {v}, seen DESC, url::VARCHAR LIMIT 75)" for k, v in _SORTED.items()))
def article_orders(spark: SparkSession, d: str) -> DataFrame:
    """The first page of every order: the page is the feature."""
    a = _t(spark, d, "orders").select(_s("o_orderkey").alias("url"), F.col("o_orderdate").alias("seendate"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_totalprice")).alias("tone"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey")).alias("numevents"))
    lists = [explorer.article_list(a, way, 75).select(F.lit(way).alias("way"), F.col("url").cast("long").alias("url")) for way in explorer.SORTS]
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


# ---------------------------------------------------------------- answers of the store


def _store(spark: SparkSession, d: str) -> serving.AttentionStore:
    """Customers as events, nations as families, orders as documents, parts of them as evidence."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    none = F.array().cast("array<string>")
    events = _t(spark, d, "customer").select(
        k.alias("macro_event_id"), F.col("c_nationkey").alias("family_id"), F.col("c_name").alias("title"), F.concat(F.lit("Élan "), _s(k % 7)).alias("label"), none.alias("people"), none.alias("organizations"),
        F.array(F.col("c_mktsegment")).alias("actors"), F.array(F.col("c_mktsegment")).alias("event_types"), (k % 6).alias("publisher_country_count"), (k % 11).alias("effective_reports"), (k % 13).alias("raw_documents"), F.concat(F.lit("N"), _s("c_nationkey")).alias("event_country"),
    )
    docs = _t(spark, d, "orders").select(
        o.alias("document_id"), F.col("o_custkey").alias("macro_event_id"), F.lower("o_orderpriority").alias("title"), (o % 8 > 0).alias("is_primary"), F.col("o_orderstatus").alias("language"), F.concat(F.lit("s"), _s(o % 20)).alias("source_domain"),
        F.concat(F.lit("N"), _s(o % 3)).alias("publisher_country"), F.col("o_orderdate").alias("observed_time"), (o % 40).alias("wire_group"),
    )
    families_of = events.groupBy("family_id").agg(F.max("publisher_country_count").alias("publisher_country_count"), F.sum("effective_reports").alias("effective_reports"), F.collect_set("macro_event_id").alias("macro_event_ids"))
    return serving.AttentionStore({"macro_events": events, "macro_event_documents": docs, "event_families": families_of})


_STORE = """e AS (SELECT c_custkey AS id, c_nationkey AS fam, c_mktsegment AS kind, c_custkey % 6 AS countries, c_custkey % 11 AS reports, lower(c_name || ' elan ' || (c_custkey % 7) || ' ' || c_mktsegment) AS said FROM customer),
hits AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderkey % 8 > 0 AND regexp_matches(lower(o_orderpriority), '(^|[^a-z0-9])urgent($|[^a-z0-9])') GROUP BY 1),
found AS (SELECT e.*, coalesce(n, 0) AS title_hits FROM e LEFT JOIN hits USING (id) WHERE coalesce(n, 0) > 0)"""


@query(f"WITH {_STORE} SELECT id AS event, title_hits FROM found")
def store_search(spark: SparkSession, d: str) -> DataFrame:
    """Events by a word of their members' titles."""
    return _store(spark, d).search("Urgent").select(F.col("macro_event_id").alias("event"), "title_hits")


@query(f"WITH {_STORE} SELECT fam AS family_id, max(x.countries) AS countries, sum(title_hits)::BIGINT AS title_hits FROM found JOIN (SELECT fam, max(countries) AS countries FROM e GROUP BY 1) x USING (fam) GROUP BY 1")
def store_families(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).search_families("urgent").select("family_id", F.col("publisher_country_count").alias("countries"), "title_hits")


@query(f"WITH {_STORE} SELECT id AS event, fam AS family_id, reports FROM e WHERE kind = 'MACHINERY' AND fam = 3 ORDER BY reports DESC, id LIMIT 100")
def store_event_list(spark: SparkSession, d: str) -> DataFrame:
    """A page of events of a type, country and family: the page is the feature."""
    page = _store(spark, d).list_events(kind="MACHINERY", country="n3", family=3)
    return page.select(F.col("macro_event_id").alias("event"), "family_id", F.col("effective_reports").alias("reports"))


@query("""SELECT document_id, language FROM (SELECT o_orderkey AS document_id, o_orderstatus AS language, o_orderdate, row_number() OVER (PARTITION BY o_orderkey % 40 ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_custkey = 5 AND o_orderkey % 8 > 0)
WHERE r = 1 ORDER BY o_orderdate, document_id LIMIT 10""")
def store_samples(spark: SparkSession, d: str) -> DataFrame:
    """Ten documents of an event, one a report: the limit is the feature."""
    return _store(spark, d).samples(5).select("document_id", "language")


# ---------------------------------------------------------------- files of a window


@query("""WITH s AS (SELECT k, strftime(TIMESTAMP '2024-01-01' + to_minutes(15 * k), '%Y%m%d%H%M%S') || '.mentions.CSV' AS expected FROM range(192) AS g(k))
SELECT expected, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 1 THEN expected || '.zip' WHEN k % 5 = 2 THEN lower(expected) ELSE expected END AS name FROM s""")
def window_files(spark: SparkSession, d: str) -> DataFrame:
    """Two days of quarter hours: archives first, then exact names, then lower case; gaps have none."""
    path, start, end = scratch(spark, "window"), datetime(2024, 1, 1), datetime(2024, 1, 3)
    jvm = spark.sparkContext._jvm
    system = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in range(192):
        name = f"202401{1 + k // 96:02d}{k % 96 // 4:02d}{k % 4 * 15:02d}00.mentions.CSV"
        if k % 7:
            # an archive stands beside the plain file, and counts first
            names = [f"{name}.zip", name] if k % 5 == 1 else [name.lower() if k % 5 == 2 else name]
            for n in names:
                system.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}")).close()
    present, missing = raw.expected_files(spark, path, "mentions.CSV", start, end)
    return present.select("expected", F.substring_index("path", "/", -1).alias("name")).unionByName(missing.select("expected", F.lit(None).cast("string").alias("name")))


# ---------------------------------------------------------------- streams


def _mention_files(spark: SparkSession, d: str) -> str:
    """The mention lines in a folder, under the names that a stream looks for."""
    path = scratch(spark, "stream-in")
    _mention_lines(spark, d).write.text(path)
    jvm = spark.sparkContext._jvm
    system = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i, f in enumerate(system.listStatus(jvm.org.apache.hadoop.fs.Path(path))):
        if f.getPath().getName().endswith(".txt"):
            system.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/{i}.mentions.CSV"))
    return path


def _drained(stream: DataFrame) -> DataFrame:
    """What a stream writes until its source is read to the end."""
    path = scratch(stream.sparkSession, "stream-out")
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _mention_stream(spark: SparkSession, d: str) -> DataFrame:
    return news.mention_stream(spark, _mention_files(spark, d), 1 << 20)


@query(f"WITH {_MENTIONS} SELECT event, mention_time, canonical_url, host AS domain, round(tone, 6) AS tone FROM mentions")
def stream_mentions(spark: SparkSession, d: str) -> DataFrame:
    """A stream's rows are the batch's."""
    return _drained(_mention_stream(spark, d)).select(F.col("GlobalEventID").alias("event"), _time("MentionTimeDate").alias("mention_time"), "canonical_url", "domain", _r("MentionDocTone").alias("tone"))


@query(f"WITH {_MENTIONS} SELECT DISTINCT canonical_url FROM mentions")
def stream_first_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return _drained(news.first_arrivals(_mention_stream(spark, d), late="3650 days")).select("canonical_url")


@query(f"""WITH {_MENTIONS} SELECT host AS domain, date_trunc('hour', mention_time) AS time_bucket, count(*) AS raw_documents FROM mentions GROUP BY 1, 2
HAVING date_trunc('hour', mention_time) + INTERVAL 1 HOUR <= (SELECT max(mention_time) - INTERVAL 1 HOUR FROM mentions)""")
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hours that the watermark has passed; outlets are counted approximately and left out here."""
    found = _drained(news.hourly_counts(_mention_stream(spark, d), ["domain"], "MentionTimeDate", "canonical_url"))
    return found.select("domain", _time("time_bucket"), "raw_documents")


@query(f"""WITH {_MENTIONS}, f AS (SELECT event, host, min(mention_time) AS seen FROM mentions WHERE host <> '' GROUP BY 1, 2)
SELECT event::VARCHAR AS event, seen FROM (SELECT event, seen, row_number() OVER (PARTITION BY event ORDER BY seen, host) AS r FROM f) WHERE r = 3""")
def stream_third_outlets(spark: SparkSession, d: str) -> DataFrame:
    found = _drained(news.third_outlets(_mention_stream(spark, d), "GlobalEventID", "MentionTimeDate", "domain"))
    return found.select(F.col("key").alias("event"), _time("seen"))


# ---------------------------------------------------------------- graphs of articles and families


@query(rf"""WITH {catalogue._WORDS}, kept AS (SELECT * FROM words WHERE NOT (regexp_matches(w, '^[0-9a-f]+$') AND regexp_matches(w, '\d') AND regexp_matches(w, '[a-f]')) AND (NOT regexp_full_match(w, '\d+') OR len(w) = 3)),
docs AS (SELECT host, count(DISTINCT page_id) AS docs FROM kept WHERE host <> '' GROUP BY 1 HAVING count(DISTINCT page_id) >= 20), marks AS (SELECT host, w FROM kept JOIN docs USING (host) GROUP BY host, w, docs HAVING count(DISTINCT page_id) / docs >= 0.2)
SELECT page_id AS node, w AS feature FROM kept WHERE (host, w) NOT IN (SELECT (host, w) FROM marks)""")
def url_rows(spark: SparkSession, d: str) -> DataFrame:
    return resolve.url_rows(_t(spark, d, "pages").select(F.col("page_id").alias("document_id"), urls.url_domain(F.col("url")).alias("domain"), F.col("url").alias("canonical_url")))


def _tfidf_sql(name: str, rows: str) -> str:
    return f"""{name}_d AS (SELECT feature, ln((n + 1) / (count(*) + 1)) + 1 AS w FROM {rows}, (SELECT count(*) AS n FROM orders) GROUP BY feature, n),
{name}_w AS (SELECT node, feature, w / sqrt(sum(w * w) OVER (PARTITION BY node)) AS w FROM {rows} JOIN {name}_d USING (feature)), {name}_p AS (SELECT a.node AS l, b.node AS r, sum(a.w * b.w) AS s FROM {name}_w a JOIN {name}_w b ON a.feature = b.feature AND a.node < b.node GROUP BY 1, 2)"""


@query(f"""WITH pr AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS feature FROM lineitem), cr AS (SELECT o_orderkey AS node, o_custkey AS feature FROM orders WHERE o_orderstatus <> 'O'), {_tfidf_sql("p", "pr")}, {_tfidf_sql("c", "cr")},
u AS (SELECT l, r, coalesce(p_p.s, 0) AS ps, coalesce(c_p.s, 0) AS cs FROM p_p FULL JOIN c_p USING (l, r)), b AS (SELECT u.*, l IN (SELECT node FROM pr) AND r IN (SELECT node FROM pr) AS pb, l IN (SELECT node FROM cr) AND r IN (SELECT node FROM cr) AS cb FROM u),
m AS (SELECT *, CASE WHEN pb OR cb THEN (least(ps, 1) + least(cs, 1)) / (pb::INT + cb::INT) ELSE 0 END AS mean FROM b)
SELECT l AS "left", count(*) AS pairs, round(sum(mean), 6) AS combined, round(sum(CASE WHEN (ps > 0)::INT + (cs > 0)::INT >= 2 OR greatest(ps, cs) >= 0.6 THEN mean ELSE 0 END), 6) AS gated FROM m GROUP BY 1""")
def article_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Orders by their parts and by their customer; no neighbour is cut off."""
    nodes = _t(spark, d, "orders").select(F.col("o_orderkey").alias("node"))
    parts = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("feature")).distinct()
    owners = _t(spark, d, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("feature"))
    found = prototypes.article_totals(nodes, {"part": parts, "owner": owners})
    return found.select("left", "pairs", F.round("combined", 6).alias("combined"), F.round("gated", 6).alias("gated"))


@query(f"""WITH {catalogue._VEC}, m AS (SELECT id, label * 3 + id % 3 AS inc, label % 2 AS lang, label * 30 + id % 24 AS h, vector FROM v), x AS (SELECT inc, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM m), a AS (SELECT inc, i, avg(x) AS a FROM x GROUP BY 1, 2),
n AS (SELECT inc, sqrt(sum(a * a)) AS n FROM a GROUP BY 1), c AS (SELECT inc, list(a / n ORDER BY i) AS c FROM a JOIN n USING (inc) GROUP BY 1), s AS (SELECT inc, any_value(lang) AS lang, min(h) AS a, max(h) AS b FROM m GROUP BY 1),
p AS (SELECT x.inc AS l, y.inc AS r, list_dot_product(x.c, y.c) AS cos, CASE sx.lang + sy.lang WHEN 0 THEN 0.1 WHEN 1 THEN 0.05 ELSE 0.17 END AS q FROM c x JOIN c y ON x.inc < y.inc JOIN s sx ON sx.inc = x.inc JOIN s sy ON sy.inc = y.inc WHERE greatest(sx.a - sy.b, sy.a - sx.b) <= 48),
w AS (SELECT l, r, least(greatest((cos - q) / (1 - q), 0), 1) AS w FROM p WHERE cos >= 0.1)
SELECT l AS "left", r AS "right", round(w, 6) AS weight FROM w WHERE w >= 0.1 AND (w >= 0.5 OR EXISTS (SELECT 1 FROM m a JOIN m b ON a.id % 200 = b.id % 200 WHERE a.inc = l AND b.inc = r))""")
def title_links(spark: SparkSession, d: str) -> DataFrame:
    """Families' links by centroids of titles, near in time, with a shared event unless very close."""
    k = F.col("id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    members = catalogue._vec(spark, d).select(
        k.alias("document_id"), (F.col("label") * 3 + k % 3).cast("long").alias("incident_id"), F.concat(F.lit("L"), _s(F.col("label") % 2)).alias("language"),
        F.timestamp_seconds(F.unix_timestamp(start) + 3600 * (F.col("label") * 30 + k % 24)).alias("first_seen"), F.lit(False).alias("has_gkg"), "vector",
    )
    background = spark.sql("SELECT * FROM VALUES ('L0', 'L0', 0.1D), ('L0', 'L1', 0.05D) AS t(group_left, group_right, quantile)")
    links = members.select("document_id", (F.col("document_id") % 200).alias("GlobalEventID"))
    return families.title_links(members, background, links, 0.1, 0.5, 48.0, ("event",)).withColumn("weight", _r("weight"))


def _compared_sql(run: str, unit: str, key: str, cluster: str) -> str:
    name = f"{run}_{unit}"
    return f"""{name}_h AS (SELECT DISTINCT {key} AS k, canonical % {cluster} AS c FROM pg), {name}_t AS (SELECT DISTINCT story, {key} AS k FROM tg), {name}_n AS (SELECT story, c, count(*) AS n, row_number() OVER (PARTITION BY story ORDER BY count(*) DESC, c) AS r
  FROM {name}_t JOIN {name}_h USING (k) GROUP BY 1, 2), {name} AS (SELECT '{run}' AS run, story, '{unit}' AS unit, a.n AS all_units, b.c AS best_cluster, b.n AS best_matches, round(b.n / a.n, 6) AS best_fraction, round(b.n / z.n, 6) AS best_purity, round(f.n / a.n, 6) AS top5_fraction
  FROM (SELECT story, count(*) AS n FROM {name}_t GROUP BY 1) a JOIN {name}_n b USING (story) JOIN (SELECT c, count(*) AS n FROM {name}_h GROUP BY 1) z ON z.c = b.c
  JOIN (SELECT t.story, count(DISTINCT t.k) AS n FROM {name}_t t JOIN {name}_h h USING (k) JOIN {name}_n x ON x.story = t.story AND x.c = h.c WHERE x.r <= 5 GROUP BY 1) f USING (story) WHERE b.r = 1)"""


_RUNS = {"first": 30, "second": 7}
_UNITS = {"url": "id", "canonical": "canonical"}


@query("WITH pg AS (SELECT o_orderkey AS id, o_orderkey // 2 AS canonical, lower(o_orderpriority) AS slug FROM orders), tg AS (SELECT id, canonical, 'top' AS story FROM pg WHERE regexp_matches(slug, 'urgent|high') UNION ALL SELECT id, canonical, 'some' FROM pg WHERE regexp_matches(slug, 'low|high')), "
       + ", ".join(_compared_sql(r, u, k, n) for r, n in _RUNS.items() for u, k in _UNITS.items()) + " " + " UNION ALL ".join(f"SELECT * FROM {r}_{u}" for r in _RUNS for u in _UNITS))
def story_comparison(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "orders").select(F.col("o_orderkey").alias("MentionIdentifier"), F.floor(F.col("o_orderkey") / 2).cast("long").alias("canonical"), F.lower("o_orderpriority").alias("slug"))
    runs = {run: pages.select("canonical", (F.col("canonical") % n).alias("cluster")).distinct() for run, n in _RUNS.items()}
    return prototypes.story_comparison(runs, pages, {"top": "urgent|high", "some": "low|high"}).withColumns({c: _r(c) for c in ("best_fraction", "best_purity", "top5_fraction")})


@query(f"""WITH {_PAIRS}, g AS (SELECT l, (es + us) / 2 AS combined, es, us, (es >= 0.05)::INT + (us >= 0.2)::INT AS evidence, l % 4 AS ef, l % 5 AS uf FROM x), grid AS (SELECT * FROM (VALUES (1), (2)) AS a(c), (VALUES (0.3), (0.4)) AS b(t))
SELECT 'min_channels=' || c || ', threshold=' || t AS run, count(*) FILTER (combined >= t AND (evidence >= c OR es >= 0.8 AND ef >= 2 OR us >= 0.8 AND uf >= 2)) AS edges FROM g, grid GROUP BY c, t""")
def gate_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Scored once, gated for every combination of settings."""
    k = F.col("left")
    scored = materialize(prototypes.plain_mean(_pairs(spark, d)).drop("evidence_channels", "gated").withColumns({"event_min_features": k % 4, "url_min_features": k % 5}), "swept")
    run = lambda gate: similarity.apply_gate(scored, ("event", "url"), gate).agg(F.count_if(F.col("gated") >= gate.threshold).alias("edges"))
    return prototypes.sweep(similarity.Gate(), {"min_channels": (1, 2), "threshold": (0.3, 0.4)}, run)


# ---------------------------------------------------------------- strict and repeated reads


@query("SELECT count(*) AS rows, 0::BIGINT AS replacements, 0::BIGINT AS null_id, count(*) FILTER (c_custkey % 6 = 0) AS null_name, 0::BIGINT AS null_segment FROM customer")
def strict_audit(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "strict")
    name = F.when(F.col("c_custkey") % 6 == 0, "").otherwise(F.col("c_name"))
    _t(spark, d, "customer").select(F.concat_ws("\t", _s("c_custkey"), name, "c_mktsegment").alias("value")).write.text(path)
    return raw.read_strict(spark, [path], ["id", "name", "segment"])[1]


@query("SELECT c_custkey::VARCHAR AS id, '\"' || c_name AS name FROM customer")
def glob_rows(spark: SparkSession, d: str) -> DataFrame:
    """All files of a pattern; quotes mean nothing."""
    path = scratch(spark, "glob")
    _t(spark, d, "customer").select(F.concat(_s("c_custkey"), F.lit('\t"'), "c_name").alias("value")).write.text(path)
    return raw.glob_scan(spark, path, "part-*.txt", ["id", "name"])


@query("SELECT 'orders' AS name, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders UNION ALL SELECT 'parts', count(*), sum(p_partkey)::BIGINT FROM part")
def prepared_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of an earlier run with the same settings; the second run builds nothing."""
    path, settings = scratch(spark, "prepared"), {"threshold": 0.3, "orders": d}
    prototypes.prepared(spark, path, settings, lambda: {"orders": _t(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "parts": _t(spark, d, "part").select(F.col("p_partkey").alias("k"))})
    again = prototypes.prepared(spark, path, settings, dict)
    of = lambda n: again[n].agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.sum("k").alias("keys"))
    return of("orders").unionByName(of("parts"))


# ---------------------------------------------------------------- evidence and filtered responses


@query("""WITH e AS (SELECT j, 7 + j * j AS n, (j % 5) / 5 AS ts, (j % 3) / 3 AS es, j * 1.5 AS h FROM range(1, 7) AS g(j)), x AS (SELECT e.*, n % 3 = 7 % 3 AS same, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = n AND n % 8 > 0) AS there FROM e WHERE j % 2 = 1)
SELECT max(ts) AS title_similarity, bool_or(es > 0) AS shared_event, min(h)::DOUBLE AS hours, coalesce(bool_or(NOT same) FILTER (there), false) AS other_country FROM x""")
def store_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The checks of one document's edges: the document is the feature."""
    store, j = _store(spark, d), F.col("j")
    pairs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("j"))
    zero = F.lit(0.0)
    store.t["document_evidence"] = pairs.select(
        "document_id", (F.col("document_id") + j * j).alias("neighbor_document_id"), (j % 2 == 1).alias("same_incident"), j.alias("rank"), ((j % 5) / 5).alias("title_score"), ((j % 3) / 3).alias("event_score"), zero.alias("url_score"),
        zero.alias("entity_score"), (j * 1.5).alias("delta_hours"), F.lit(0.5).alias("gated"), F.lit(0.5).alias("combined"),
    )
    checks = store.evidence(7)[1]
    return checks.select("title_similarity", "shared_event", F.col("hours_to_nearest_support").cast("double").alias("hours"), F.col("other_publisher_country").alias("other_country"))


@query(f"""WITH {catalogue._OBS} SELECT event_id, destination_country, round(trunc((epoch_us(destination_onset) - epoch_us(CASE WHEN home THEN event_start ELSE world_onset END)) / 60000000) / 60.0, 6) AS response_hours
FROM obs0 WHERE size >= 2 AND size < 1000 AND event_start >= TIMESTAMP '1995-07-01' AND event_start < TIMESTAMP '1997-01-01' AND kind IN ('1-URGENT', '3-MEDIUM')""")
def response_filters(spark: SparkSession, d: str) -> DataFrame:
    """All filters at once, foreign responses measured from the world's onset."""
    wanted = responses.Filters("incident", event_types=("1-URGENT", "3-MEDIUM"), min_event_effective_reports=2, max_event_effective_reports=1000, start=datetime(1995, 7, 1), end=datetime(1997, 1, 1), reference="world")
    found = responses.apply_filters(catalogue._observations(spark, d), wanted)
    return found.select("event_id", "destination_country", _r("response_hours").alias("response_hours"))


# ---------------------------------------------------------------- strict mentions and labels


@query("""WITH m AS (SELECT event_id % 50 + 1 AS event, date_trunc('hour', ts) AS h, CASE WHEN event_type = 'error' THEN '2' ELSE '1' END AS kind, CASE WHEN event_id % 4 = 0 THEN 'deu' END AS lang, 10 + event_id % 90 AS confidence FROM events)
SELECT 'type' AS part, kind AS key, count(*) AS n FROM m GROUP BY kind UNION ALL SELECT 'language', lang, count(*) FROM m GROUP BY lang UNION ALL SELECT 'times', event::VARCHAR, count(DISTINCT h) FROM m GROUP BY event HAVING count(DISTINCT h) > 1
UNION ALL SELECT 'confidence', 'count', count(*) FROM m UNION ALL SELECT 'confidence', 'min', min(confidence) FROM m UNION ALL SELECT 'confidence', 'max', max(confidence) FROM m""")
def strict_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Strictly typed mentions and their audit: types, languages, events with several times, spread of confidence."""
    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    given = {
        "GlobalEventID": _s(k % 50 + 1), "EventTimeDate": F.date_format(F.date_trunc("hour", at), "yyyyMMddHHmmss"), "MentionTimeDate": F.date_format(at, "yyyyMMddHHmmss"), "MentionType": F.when(F.col("event_type") == "error", "2").otherwise("1"),
        "Confidence": _s(10 + k % 90), "MentionDocTranslationInfo": F.when(k % 4 == 0, "srclc:deu;eng:GT"),
    }
    rows = _t(spark, d, "events").select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in MENTION_COLUMNS])
    audit = ingest.mention_audit(ingest.strict_mentions(rows))
    part = lambda name, t, key, n: t.select(F.lit(name).alias("part"), _s(key).alias("key"), F.col(n).cast("long").alias("n"))
    spread = audit["confidence"].where("summary in ('count', 'min', 'max')")
    out = part("type", audit["types"], "MentionType", "count").unionByName(part("language", audit["languages"], "language", "count"))
    return out.unionByName(part("times", audit["inconsistent_events"], "GlobalEventID", "times")).unionByName(part("confidence", spread, "summary", "Confidence"))


@query("SELECT (p_partkey // 2)::VARCHAR AS event, upper(p_name) || p_partkey AS actor, 'Town' AS place FROM part WHERE p_partkey % 2 = 0")
def event_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every event stands twice in the file: its first row counts."""
    k, path = F.col("p_partkey"), scratch(spark, "labels")
    lines = _raw_rows(_t(spark, d, "part"), EVENT_COLUMNS, {"GlobalEventID": _s(F.floor(k / 2)), "Actor1Name": F.concat(F.upper("p_name"), _s(k)), "EventRootCode": F.lit("01"), "ActionGeo_FullName": F.lit("Town")})
    lines.orderBy(k).select(F.col("line").alias("value")).coalesce(1).write.text(path)
    return ingest.event_labels(spark, [path]).select(F.col("GlobalEventID").alias("event"), F.col("Actor1Name").alias("actor"), F.col("ActionGeo_FullName").alias("place"))
