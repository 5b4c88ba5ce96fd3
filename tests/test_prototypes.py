import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import similarity
from newsloom.plans import prototypes as p
from newsloom.operators.similarity import Gate


@pytest.fixture(scope="module")
def mentions(spark):
    rows = []
    for i in range(6):  # two wire copies of a crash story, and others of the same events
        for e in (1, 2) if i < 4 else (3, 4):
            for url in {0: ["http://a.com/ethiopian-boeing-crash", "http://b.com/boeing-737-ethiopian"], 1: ["http://c.com/boeing-grounded"], 4: ["http://d.com/brexit-vote-delay"], 5: ["http://e.com/brexit-delay-vote"]}.get(i, [f"http://x{i}.com/cyclone-idai-{i}"]):
                rows.append((e, url, 1, i if i else 0, f"2019-03-1{1 + i % 3} 00:00:00"))
    d = spark.createDataFrame(rows, "GlobalEventID long, MentionIdentifier string, MentionType long, SentenceID long, t string")
    off = {c: F.lit(0) for c in ("Actor1CharOffset", "Actor2CharOffset", "ActionCharOffset")}
    return d.withColumns({**off, "MentionTimeDate": F.col("t").cast("timestamp"), "Confidence": F.lit(80)})


def test_event_projection(spark, mentions):
    pages = p.canonical_articles(mentions, p.articles(mentions))
    by = {r["MentionIdentifier"]: r for r in pages.collect()}
    assert by["http://b.com/boeing-737-ethiopian"]["canonical"] == by["http://a.com/ethiopian-boeing-crash"]["canonical"] == "http://a.com/ethiopian-boeing-crash"
    assert by["http://d.com/brexit-vote-delay"]["brexit"] and by["http://c.com/boeing-grounded"]["crash_grounding"]
    links = mentions.join(pages.select("MentionIdentifier", "canonical"), "MentionIdentifier")
    graph = p.event_graph(links)
    assert {(r["left"], r["right"]): (r["shared"], r["jaccard"]) for r in graph.collect()} == {(1, 2): (4, 1.0), (3, 4): (2, 1.0)}
    for metric, method in (("shared", "components"), ("jaccard", "leiden")):
        events = p.partition_events(graph, metric, 0.1, method)
        assert {r["node"]: r["community"] for r in events.collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    members = p.article_memberships(links, events)
    assert members.count() == 6
    told = p.story_comparison({"r": members}, pages, {"brexit": "brexit", "crash": "boeing"}).collect()
    best = {(r["story"], r["unit"]): (r["best_matches"], r["best_fraction"]) for r in told}
    assert best["brexit", "url"] == (2, 1.0) and best["crash", "canonical"] == (2, 1.0) and best["crash", "url"] == (3, 1.0)
    words = {r["cluster"]: [w["w"] for w in r["words"]] for r in p.cluster_words(pages.join(members, "canonical")).collect()}
    assert words[3][:1] == ["brexit"] and "boeing" in words[1]


def test_article_graph(spark, mentions):
    pages = p.canonical_articles(mentions, p.articles(mentions))
    nodes = pages.select(F.xxhash64("canonical").alias("node")).distinct()
    rows = p.token_rows(pages).withColumn("node", F.xxhash64("node"))
    kept = p.filtered_rows(rows)
    assert kept.count() == rows.select("node", "feature").distinct().count()
    links = mentions.join(pages.select("MentionIdentifier", "canonical"), "MentionIdentifier")
    events = links.select(F.xxhash64("canonical").alias("node"), F.col("GlobalEventID").cast("string").alias("feature")).distinct()
    pairs = p.article_pairs(nodes, {"event": events, "url": kept})
    got = {(r["event_score"] > 0, r["url_score"] > 0, r["gated"] > 0) for r in pairs.collect()}
    assert (True, True, True) in got and pairs.where("gated > 0 and event_score = 0 and url_score < 0.6").count() == 0
    assert p.plain_mean(pairs).where("combined > 1").count() == 0
    labels = spark.createDataFrame([(1, "BOEING", "", "Bole"), (2, None, "FAA", "")], "GlobalEventID long, Actor1Name string, Actor2Name string, ActionGeo_FullName string")
    days = pages.select("canonical", F.col("first_seen").cast("date").alias("day"))
    assert {r[0] for r in p.label_rows(links, labels, days).select("feature").collect()} == {"actor:BOEING", "actor:FAA", "geo:Bole"}
    assert [tuple(r) for r in p.label_counts(labels, links.select("GlobalEventID"), "Actor1Name").collect()] == [("BOEING", 1)]
    weights = {"url": similarity.tfidf(spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "z")], "node long, feature string"), 5)}
    members = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)], "node long, cluster long")
    assert {r["cluster"]: r["family"] for r in p.centroid_families(members, weights).collect()} == {0: 0, 1: 0, 2: 3}


def test_entity_mix(spark):
    raw = spark.createDataFrame([("news.spiegel.de", "20230206011500", "", "x<PAGE_TITLE>A &amp; B</PAGE_TITLE>"), ("other.com", "20230206011500", "srclc:deu", "")], "source string, batch_date string, translation_info string, extras string")
    rows = p.derived(p.outlets(raw, {"spiegel.de": "DE"})).collect()
    assert len(rows) == 1 and (rows[0]["country"], rows[0]["title"], rows[0]["language"], rows[0]["batch_time"].hour) == ("DE", "A & B", "eng", 1)
    ents = spark.createDataFrame([("Ann Lee,12;Bob,3", "Un,1", "1#Rome#IT;4#Oslo#NO", None, [7])], "persons string, organizations string, locations string, all_names string, event_ids array<long>")
    assert ents.select(p.entity_tokens("POLNE")).first()[0] == ["P:Ann Lee", "P:Bob", "O:Un", "L:Rome", "L:Oslo", "E:7"]
    rng = np.random.default_rng(6)
    tokens = [(int(i), f"t{j}") for i in range(12) for j in rng.integers(0, 6, size=5)]
    d = spark.createDataFrame(tokens, "node long, feature string")
    m = np.zeros((12, 6))
    for i, f in tokens:
        m[i, int(f[1])] += 1
    df = (m > 0).sum(axis=0)
    keep = (df >= 2) & (df <= 0.9 * 12)
    w = np.where(m > 0, 1 + np.log(np.where(m > 0, m, 1)), 0)[:, keep] * (np.log(13 / (1 + df[keep])) + 1)
    w /= np.where(np.linalg.norm(w, axis=1, keepdims=True) > 0, np.linalg.norm(w, axis=1, keepdims=True), 1)
    v = rng.normal(size=(12, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    nodes = spark.range(12).withColumnRenamed("id", "node")
    titles = spark.createDataFrame([(i, v[i].tolist()) for i in range(12)], "id long, vector array<double>")
    weights = p.entity_weights(d, nodes, 2, 0.9)
    got = {(r["left"], r["right"]): r["weight"] for r in p.mixed_edges(weights, titles, 0.5, 0.4).collect()}
    mixed = 0.5 * w @ w.T + 0.5 * v @ v.T
    want = {(i, j): mixed[i, j] for i, j in itertools.combinations(range(12), 2) if mixed[i, j] >= 0.4}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    members = spark.createDataFrame([(i, i % 2) for i in range(12)], "node long, cluster long")
    terms = p.top_terms(weights, members, 3).collect()
    assert all(len(r["terms"]) == 3 for r in terms)
    docs = spark.createDataFrame([(1, "Erdbeben in der Türkei", "DE", "s", "2023-02-06 03:00:00"), (1, "quake", "US", "s", "2023-02-06 05:30:00"), (2, "地震 news", "JP", "s", "2023-02-06 04:00:00"), (1, "other", "US", "t", "2023-02-06 02:00:00")], "cluster long, title string, country string, source string, b string").withColumn("batch_time", F.col("b").cast("timestamp"))
    r = p.event_report(docs).first()
    assert (r["event_cluster"], r["size"], round(r["purity"], 3), round(r["recall"], 3)) == (1, 3, 0.667, 0.667) and p.event_report(docs, anchor="JP").first()["event_cluster"] == 2
    firsts = {x["country"]: x["hours_after"] for x in p.first_per_country(docs, "2023-02-06 01:17:00").collect()}
    assert firsts == {"DE": 1, "US": 0, "JP": 2} and p.hourly_pivot(docs, "2023-02-06 01:17:00", ["DE", "US", "JP"]).count() == 4


def test_audits(spark):
    pairs = spark.createDataFrame([(0, 2, 0.5, 0.0, 0.4, 0.0, 0.0, 1), (0, 3, 0.6, 0.5, 0.0, 0.0, 0.1, 2), (0, 1, 0.9, 0.9, 0.0, 0.0, 0.0, 1), (1, 9, 0.0, 0.0, 0.0, 0.0, 0.0, 0)], "left long, right long, gated double, title_score double, url_score double, event_score double, entity_score double, evidence_channels int")
    members = spark.createDataFrame([(0, 0, None, 5), (1, 0, "b quake", 5), (2, 1, "c", 5), (3, 2, "d quake", 5), (9, -1, "quake", -1)], "document_id long, incident_id long, title string, family_id long")
    risk = p.bridges(pairs, members.where("family_id = 5"), members.where("document_id = 2")).collect()
    assert risk[0]["document_id"] == 2 and {r["document_id"] for r in risk} == {0, 2, 3}
    assert abs(risk[0]["bridge_risk"] - (1.0 + 0.25 * np.log(2))) < 1e-9
    c = p.cross_edges(pairs, members).first()
    assert tuple(c) == (2, 1, 1, 0)
    assert p.pick_family(members, "quake").first()["family_id"] == 5
    docs = members.select("document_id", "title")
    gold = spark.createDataFrame([(1, "q"), (3, "q"), (2, "q")], "document_id long, story string")
    cand = spark.createDataFrame([(1, 3), (2, 7)], "left long, right long")
    r = p.candidate_reach(docs, cand, gold, {"q": "quake", "z": "zz"}).first()
    assert (r["gold"], r["reached"], r["in_main_component"]) == (3, 2, 2)
    i = p.run_inspection(members, "quake").collect()
    assert [(x["incident_id"], x["hits"]) for x in i] == [(0, 1), (2, 1)]
    assert p.relabelled(members.withColumn("is_primary", F.lit(True)), spark.createDataFrame([(0, 77)], "incident_id long, family_id long")).where("family_id = 77").count() == 2
    assert [r["edges"] for r in p.incident_coverage(members.withColumn("assignment_score", F.lit(1.0)), pairs, 0).collect()] == [1, 1]
    swept = p.sweep(Gate(), {"threshold": (0.55, 0.8)}, lambda g: pairs.where(F.col("gated") >= g.threshold).agg(F.count("*").alias("n"))).collect()
    assert {r["run"]: r["n"] for r in swept} == {"threshold=0.55": 2, "threshold=0.8": 1}


def test_prepared(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return {"t": spark.range(3)}

    for _ in range(2):
        assert p.prepared(spark, f"{tmp_path}/x", Gate(), build)["t"].count() == 3
    assert len(calls) == 1
    with pytest.raises(ValueError):
        p.prepared(spark, f"{tmp_path}/x", Gate(threshold=0.9), build)
