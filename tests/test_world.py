"""Raw files to served answers on a world whose answers are known."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import responses
from newsloom.plans import documents, explorer, ingest, resolve, serving, store, web
from newsloom.plans.cutpoint import materialize
from newsloom.operators.similarity import theme_idf
from newsloom.sources import raw, sinks
from tests import world

END = world.START + timedelta(minutes=15 * world.SLOTS)


@pytest.fixture(scope="module")
def raw_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    world.write_raw(folder / "files")
    world.write_lookup(folder / "lookup.tsv")
    return folder


@pytest.fixture(scope="module")
def clean(spark, raw_dir):
    out = {}
    for table in ("mentions", "events", "gkg"):
        rows, audit, gaps = ingest.load_table(spark, table, f"{raw_dir}/files", world.START, END, allow_partial=True)
        out[table], out[f"{table}_audit"], out[f"{table}_gaps"] = materialize(rows, table), audit, gaps
    out["sources"] = materialize(ingest.build_sources(out["mentions"], out["gkg"], raw.domain_lookup(spark, f"{raw_dir}/lookup.tsv")), "sources")
    return out


@pytest.fixture(scope="module")
def atomic(clean):
    docs = materialize(documents.build_documents(clean["mentions"], clean["gkg"], clean["sources"]), "documents")
    links = materialize(documents.build_document_events(clean["mentions"], docs), "links")
    return {"documents": docs, "links": links, "events": materialize(documents.build_atomic_events(links, docs, clean["events"], theme_idf(docs)), "atomic")}


@pytest.fixture(scope="module")
def resolved(spark, atomic):
    v = spark.createDataFrame(world.vectors(atomic["documents"].select("document_id", "canonical_url", "title").collect()), "document_id long, vector array<double>")
    return {"vectors": v, **resolve.resolve(atomic["documents"], atomic["links"], v, resolve.Settings(entity_share=0.9, feature_cap=60))}


@pytest.fixture(scope="module")
def served(spark, raw_dir, clean, atomic, resolved):
    names = raw.domain_lookup(spark, f"{raw_dir}/lookup.tsv").select("country", "name")
    tables = store.build_store(atomic["documents"], atomic["links"], atomic["events"], resolved["incident_memberships"], clean["gkg"], clean["sources"], resolved["pair_features"], resolved["vectors"], names, least=(10, 3, 0.3))
    return {k: materialize(v, k) for k, v in tables.items()}


def test_ingest(spark, raw_dir, clean):
    assert clean["mentions"].count() == 61 and clean["mentions_audit"].agg(F.sum("malformed_rows")).first()[0] == 1
    assert clean["mentions_gaps"] == [f"{world.START + timedelta(minutes=15 * world.MISSING):%Y%m%d%H%M%S}.mentions.CSV"]
    g = clean["gkg"]
    assert g.count() == g.select("canonical_url").distinct().count() == 61
    page = g.where(F.col("canonical_url").endswith("rescue-1.html")).first()
    assert not page["translated"] and page["tone"] == -5.2 and page["word_count"] == 300 and page["page_title"].endswith("& more") and page["locations"][0]["country_code"] == "TU"
    s = {r["domain"]: r for r in clean["sources"].collect()}
    assert s["paper0.co.uk"]["publisher_country"] == "UK" and s["paper1.de"]["mapping_method"] == "cctld" and s["paper1.de"]["publisher_country"] == "GM" and s["solo1.com"]["publisher_country"] is None
    with pytest.raises(raw.MissingFiles):
        ingest.load_table(spark, "mentions", f"{raw_dir}/files", world.START, END)
    rows, _, _ = ingest.load_table(spark, "gkg", f"{raw_dir}/files", END, END)
    assert rows.count() == 0 and "page_title" in rows.columns
    sums = {k: v.collect() for k, v in ingest.preprocess_summary(clean["mentions"], clean["events"], clean["gkg"], clean["sources"]).items()}
    assert sums["mentions"][0]["rows"] == 61 and sums["events"][0]["events"] == 11
    assert raw.manifest(spark, [f"{raw_dir}/lookup.tsv"]).first()["bytes"] > 0


def test_strict_reading(spark, tmp_path):
    from newsloom.functions.fixed import MENTION_COLUMNS

    good = world.row(MENTION_COLUMNS, GlobalEventID=1, EventTimeDate="20230206000000", MentionTimeDate="20230206000000", MentionType=1, Confidence=50)
    (tmp_path / "a.csv").write_text(good + "\n")
    rows, counts = raw.read_strict(spark, [f"{tmp_path}/a.csv"], MENTION_COLUMNS)
    assert ingest.strict_mentions(rows).first()["Confidence"] == 50 and counts.first()["null_Extras"] == 1
    assert set(ingest.mention_audit(ingest.strict_mentions(rows))) == {"types", "languages", "inconsistent_events", "confidence"}
    (tmp_path / "b.csv").write_text("x\ty\n")
    with pytest.raises(Exception, match="unexpected width"):
        raw.read_strict(spark, [f"{tmp_path}/b.csv"], MENTION_COLUMNS)[0].collect()
    (tmp_path / "c.csv").write_text(good.replace("\t50\t", "\t5\t") + "\n")
    with pytest.raises(Exception, match="out of range"):
        ingest.strict_mentions(raw.read_strict(spark, [f"{tmp_path}/c.csv"], MENTION_COLUMNS)[0]).collect()
    with pytest.raises(ValueError):
        two_members()
    assert raw.positions(spark, [f"{tmp_path}/b.csv"], {"a": 1, "b": 5}).first() == ("y", None)
    with pytest.raises(raw.MissingFiles):
        raw.read_strict_slots(spark, str(tmp_path), "mentions", world.START, END)


def two_members():
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a", "1")
        z.writestr("b", "2")
    return raw.open_archive("x.zip", buffer.getvalue())


def test_documents(atomic):
    docs = atomic["documents"].orderBy("document_id").collect()
    assert [r["document_id"] for r in docs] == list(range(61)) and [(r["first_seen"], r["canonical_url"]) for r in docs] == sorted((r["first_seen"], r["canonical_url"]) for r in docs)
    quake = [r for r in docs if "earthquake" in r["canonical_url"]]
    assert len(quake) == 40 and {r["language"] for r in quake} == {"tur", "eng"} and all(r["event_count"] == 1 and r["has_gkg"] for r in quake)
    assert atomic["links"].count() == 61
    e = {r["GlobalEventID"]: r for r in atomic["events"].collect()}
    assert e[100]["document_count"] == 14 and e[100]["people"] == ["erdogan", "kilicdaroglu"] and e[100]["Actor1Name"] == "TURKEY" and e[100]["top_themes"][0]["theme"]


def test_resolution(resolved, atomic):
    story = {r["document_id"]: "quake" if "earthquake" in r["canonical_url"] else "fire" if "wildfire" in r["canonical_url"] else "noise" for r in atomic["documents"].collect()}
    members = resolved["incident_memberships"].where("is_primary").collect()
    assert len(members) == 61
    incidents = {}
    for r in members:
        incidents.setdefault(r["incident_id"], []).append(story[r["document_id"]])
        assert story[r["document_id"]] != "noise" or (r["incident_id"], r["assignment_score"], r["family_id"]) == (-1, 0.0, -1)
    big = max((v for k, v in incidents.items() if k >= 0), key=len)
    assert set(big) == {"quake"} and len(big) >= 36
    assert not any({"quake", "fire"} <= set(v) for k, v in incidents.items() if k >= 0)
    assert resolved["pair_features"].where("delta_hours > 48").count() == 0 and resolved["graph_edges"].where("gated < 0.3").count() == 0


def test_regating_and_metadata_only(spark, atomic, resolved):
    again = resolve.resolve(atomic["documents"], atomic["links"], None, resolve.Settings(entity_share=0.9, feature_cap=60), scored=resolved["pair_features"])
    first = {tuple(r) for r in resolved["graph_edges"].select("left", "right").collect()}
    assert {tuple(r) for r in again["graph_edges"].select("left", "right").collect()} == first
    plain = resolve.resolve(atomic["documents"], atomic["links"], None, resolve.Settings(entity_share=0.9, feature_cap=60))
    assert "title_score" not in plain["pair_features"].columns and plain["incidents"].count() >= 2


def test_store(served):
    events = served["macro_events"].orderBy("macro_event_id").collect()
    top = events[0]
    assert top["event_country"] == "TU" and "natural_disaster" in top["event_types"] and "earthquake" in top["label"] and top["people"][0] == "erdogan" and top["title_coherence"] > 0.8 and top["actors"] == ["TURKEY"]
    docs = served["macro_event_documents"]
    assert docs.where("is_primary").count() == 61 and docs.where("macro_event_id = -1 and incident_id = -1").count() == 6
    summary = {(r["macro_event_id"], r["publisher_country"]): r for r in served["country_event_summary"].collect()}
    assert all(r["suppressed"] == (r["unique_domains"] < 3) for r in summary.values()) and all(r["onset"] is None for r in summary.values() if r["suppressed"])
    assert summary[0, "UK"]["world_onset"] is not None and None not in {k[1] for k in summary}
    hourly = served["country_event_attention"].where("macro_event_id = 0 and publisher_country = 'UK'").orderBy("time_bucket").collect()
    assert hourly[-1]["cumulative_documents"] == sum(r["raw_documents"] for r in hourly) == summary[0, "UK"]["raw_documents"]
    assert served["document_evidence"].where("same_incident").groupBy("document_id").count().agg(F.max("count")).first()[0] <= 3


def test_serving(spark, served, tmp_path):
    s = serving.AttentionStore(served)
    hits = s.search("turkey RESCUE").collect()
    assert hits and hits[0]["macro_event_id"] == 0 and hits[0]["title_hits"] > 20 and s.search("earth").count() == 0 and s.search("  ").count() == 0
    assert s.search_families("wildfire").count() == 1
    assert [r["macro_event_id"] for r in s.list_events(kind="natural_disaster", country="tu").collect()] == [0]
    with pytest.raises(serving.NotFound):
        s.event(999)
    pages = [r["document_id"] for o in range(0, 60, 7) for r in s.spread(event=0, offset=o, limit=7)[0].collect()]
    whole = [r["document_id"] for r in s.spread(event=0, limit=500)[0].collect()]
    assert pages == whole and len(set(whole)) == len(whole)
    _, countries, totals = s.spread(family=s.event(0).first()["family_id"], confidence=0.6)
    assert countries.count() >= 5 and totals.first()["excluded_documents"] >= 0
    world_series, series = s.timeline(event=0, countries="uk,fr")
    assert series.count() == 2 and world_series.agg(F.sum("raw_documents")).first()[0] == sum(r["total_documents"] for r in series.collect())
    assert s.countries(event=0, suppressed=False).where("suppressed").count() == 0
    assert s.types().count() >= 2 and s.type_countries("natural_disaster", 1, 1).count() >= 5 and s.samples(0, 5).count() == 5 and s.languages(0).count() >= 1
    doc = served["document_evidence"].where("same_incident").first()["document_id"]
    edges, checks = s.evidence(doc)
    assert edges.count() >= 1 and checks.first()["title_similarity"] > 0
    names = s.country_name(spark.createDataFrame([("UK",), ("ZZ",)], "c string"), "c").collect()
    assert {r["c"]: r["country_name"] for r in names} == {"UK": "Country UK", "ZZ": "ZZ"}
    for k, v in served.items():
        sinks.write_table(v, f"{tmp_path}/{k}.parquet")
    assert serving.AttentionStore.open(spark, str(tmp_path)).events.count() == served["macro_events"].count()
    assert sinks.records(s.types())[0]["type"] and sinks.summary_json(store.meta(served["macro_event_documents"].withColumnsRenamed({"observed_time": "first_seen"}).withColumn("last_seen", F.col("first_seen")), served["macro_events"]))["macro_events"] >= 1


def test_routes(served):
    w = web.Served(store=serving.AttentionStore(served), meta={"window": "x"})

    def get(path, query=""):
        status, payload = web.answer(w, f"/api/v2/attention/{path}", query)
        assert status == 200, payload
        return payload

    spread = get("events/0/spread", "limit=7&offset=7")
    whole = get("events/0/spread", "limit=500")
    assert spread["documents"] == whole["documents"][7:14] and whole["total"] == len(whole["documents"]) and whole["meta"] == {"window": "x"}
    family = get("events/0")["event"]["family_id"]
    assert get("events/0/spread", "include_family=true")["documents"] == get(f"families/{family}/spread")["documents"]
    line = get("events/0/timeline", "publisher_countries=uk,fr")
    assert {r["publisher_country"] for r in line["publisher_countries"]} == {"UK", "FR"} and line["world"] and get(f"families/{family}/timeline", "value=unique_domains")["value"] == "unique_domains"
    assert all(not r["suppressed"] for r in get("events/0/countries", "include_suppressed=false")["publisher_countries"]) and get(f"families/{family}/countries")["world_onset"]
    assert len(get("event-types/natural_disaster/countries", "min_events=1&min_country_documents=1")["publisher_countries"]) >= 5 and get("countries")["publisher_countries"]
    doc = served["document_evidence"].where("same_incident").first()["document_id"]
    why = get(f"documents/{doc}/evidence")
    assert why["supporting"] and why["checks"]["title_similarity"] > 0 and why["document"]["document_id"] == doc
    assert web.answer(w, "/api/v2/attention/events/999/timeline")[0] == 404 and web.answer(w, "/api/v2/attention/events/0/timeline", "value=x")[0] == 400


def test_analytics(spark, served):
    table = responses.event_table(served["macro_events"], served["event_families"])
    coverage = responses.coverage_table(served["country_family_summary"], served["country_event_summary"])
    obs = materialize(responses.observations(table, coverage, served["country_baseline"], world.START - timedelta(hours=1), END), "observations")
    countries = served["country_baseline"].count()
    assert obs.count() == table.count() * countries and obs.columns == responses.OBSERVATION_COLUMNS
    assert obs.where("covered and suppressed").count() == 0 and obs.where("is_domestic and response_reference <> 'event_start'").count() == 0
    a = serving.Analytics(obs, responses.Support(1, 1))
    f = responses.Filters()
    assert a.matrix(f, ["TU", "UK"], ["TU", "UK"]).count() == 4
    assert a.by_destination(f, "TU").where("covered_events > 0").count() >= 1 and a.events(f, "TU", "UK").count() == 1
    assert set(a.country(f, "TU")) == {"domestic", "domestic_by_type", "domestic_by_magnitude", "destinations", "origins"}
    for ref in ("origin_only", "world"):
        assert responses.apply_filters(obs, responses.Filters(reference=ref, event_types=("natural_disaster",), min_event_effective_reports=1, max_event_effective_reports=1000, start=world.START, end=END)).count() > 0
    with pytest.raises(ValueError):
        a.matrix(f, ["A"] * 26, ["B"])
    with pytest.raises(ValueError):
        responses.apply_filters(obs, responses.Filters(level="x"))


def test_explorer(spark, tmp_path):
    from newsloom.functions.fixed import EVENT_COLUMNS, MENTION_COLUMNS

    (tmp_path / "m").mkdir()
    (tmp_path / "e").mkdir()
    m = lambda **k: world.row(MENTION_COLUMNS, **{"MentionType": 1, "Confidence": 60, "MentionTimeDate": "20190315120000", **k})
    rows = [
        m(GlobalEventID=1, MentionSourceName="stuff.co.nz", MentionIdentifier="https://stuff.co.nz/national/christchurch-mosque-shooting", MentionDocTone=-8.5),
        m(GlobalEventID=2, MentionSourceName="lemonde.fr", MentionIdentifier="https://lemonde.fr/brexit-vote.html", MentionDocTone=3.1, MentionDocTranslationInfo="srclc:fra;eng:x", MentionTimeDate="20190315121500"),
        m(GlobalEventID=1, MentionSourceName="lemonde.fr", MentionIdentifier="https://lemonde.fr/brexit-vote.html", MentionDocTone=3.1, MentionDocTranslationInfo="srclc:fra;eng:x", MentionTimeDate="20190315121500"),
        m(GlobalEventID=1, MentionType=2, MentionSourceName="tv", MentionIdentifier="BBC"),
    ]
    (tmp_path / "m" / "20190315120000.mentions.csv").write_text("\n".join(rows) + "\n")
    e = lambda **k: world.row(EVENT_COLUMNS, **{"Day": 20190315, "DATEADDED": "20190315120000", "NumArticles": 3, "NumMentions": 5, "AvgTone": -2, **k})
    events = [e(GlobalEventID=1, Actor1Name="POLICE", EventRootCode="19", QuadClass=4, ActionGeo_FullName="Christchurch, New Zealand", ActionGeo_CountryCode="NZ", ActionGeo_Lat=-43.5, ActionGeo_Long=172.6), e(GlobalEventID=2, Actor1Name="PARLIAMENT", EventRootCode="03", QuadClass=1, ActionGeo_FullName="London", ActionGeo_CountryCode="UK", ActionGeo_Lat=51.5, ActionGeo_Long=0), e(GlobalEventID=3)]
    (tmp_path / "e" / "20190315120000.export.csv").write_text("\n".join(events) + "\n")
    x = explorer.Explorer(explorer.build(spark, f"{tmp_path}/m", f"{tmp_path}/e"))
    a = {r["domain"]: r for r in x.articles.collect()}
    assert len(a) == 2 and a["stuff.co.nz"]["title"] == "christchurch mosque shooting" and a["lemonde.fr"]["language"] == "French" and a["stuff.co.nz"]["sourcecountry"] == "New Zealand" and a["lemonde.fr"]["numevents"] == 2
    r = explorer.Request
    found = lambda q: sorted(v["domain"] for v in x.doc(r(q)).collect())
    assert found('"mosque shooting"') == ["stuff.co.nz"] and found("sourcelang:french") == ["lemonde.fr"] and found('location:"new zealand" brexit') == ["lemonde.fr"] and found("mosque OR brexit -domainis:lemonde.fr") == ["stuff.co.nz"] and found("quadclass:1") == ["lemonde.fr"] and found("theme:fight") == ["lemonde.fr", "stuff.co.nz"]
    assert {v["bin"]: v["count"] for v in x.doc(r(), "tonechart").collect()} == {-10: 1, 2: 1}
    volume = x.doc(r("mosque"), "timelinevol").collect()
    assert [(v["matched"], v["total"]) for v in sorted(volume, key=lambda v: v["bucket"])] == [(1, 1), (0, 1)] and x.doc(r(), "timelinetone").count() == 2
    assert {v["ActionGeo_FullName"]: v["count"] for v in x.geo(r()).collect()} == {"Christchurch, New Zealand": 2, "London": 1}
    assert x.event_list(r(), quadclass=4, rootcode="19", country="nz").count() == 1 and x.event_articles(1).count() == 2 and x.events.count() == 2
    assert x.facets(r(), 5).where("facet = 'themes'").count() == 2
    with pytest.raises(ValueError):
        x.doc(r(), "nothing")
