"""Routes of the read interface against the query functions and plain counts."""

import json

import pytest
from pyspark.sql import functions as F

from newsloom.plans import catalogue, catalogue_audits, explorer, web
from newsloom.plans.cutpoint import materialize


@pytest.fixture(scope="module")
def served(spark, sf_dir):
    tables = {k: materialize(t, k) for k, t in catalogue_audits._explorer(spark, sf_dir).items()}
    return web.Served(catalogue_audits._store(spark, sf_dir), explorer.Explorer(tables), materialize(catalogue._observations(spark, sf_dir), "observations"), {"model": "m"})


def get(served, path, query=""):
    status, payload = web.answer(served, path, query)
    json.dumps(payload)
    assert status == 200, payload
    return payload


def test_articles_and_timelines(served):
    x = served.explorer
    found = get(served, "/api/v2/doc/doc", "query=domain:click&maxrecords=5")["articles"]
    seen = [a["seendate"] for a in found]
    assert len(found) == 5 and seen == sorted(seen, reverse=True) and all(a["domain"] == "click.de" and len(a["eventids"]) <= 25 and a["url_mobile"] == "" for a in found)
    best = get(served, "/api/v2/doc/doc", "sort=hybridrel&maxrecords=3")["articles"]
    top = sorted(((r["numevents"], r["seendate"]) for r in x.articles.select("numevents", "seendate").collect()), reverse=True)[:3]
    assert [a["numevents"] for a in best] == [n for n, _ in top]
    volume = get(served, "/api/v2/doc/doc", "mode=timelinevolraw")["timeline"]
    assert [s["series"] for s in volume] == ["Article Count", "Total Monitoring Volume"] and sum(p["value"] for p in volume[0]["data"]) == x.articles.count()
    assert get(served, "/api/v2/doc/doc", "mode=timelinevol")["timeline"][0]["data"] and get(served, "/api/v2/doc/doc", "mode=timelinetone")["timeline"]
    bins = get(served, "/api/v2/doc/doc", "mode=tonechart")["tonechart"]
    assert sum(b["count"] for b in bins) == x.articles.count() and all(len(b["toparts"]) <= 10 and b["toparts"][0]["url"] for b in bins)


def test_events_places_facets(served):
    got = get(served, "/api/v2/ext/events", "quadclass=2&country=N1&maxrecords=250")
    assert got["count"] == len(got["events"]) and all(e["quadclass"] == 2 and e["countrycode"] == "n1" and e["quadlabel"] for e in got["events"])
    one = get(served, f"/api/v2/ext/events/{got['events'][0]['globaleventid']}")
    assert one["event"] == got["events"][0] and one["articles"]
    points = get(served, "/api/v2/geo/geo")
    assert points["type"] == "FeatureCollection" and points["features"][0]["properties"]["count"] > 0 and set(points["window"]) == {"start", "end"} and points["features"][0]["properties"]["html"].startswith("<b>Town")
    facets = get(served, "/api/v2/ext/facets", "limit=2")
    assert facets["matched_articles"] == served.explorer.articles.count() and len(facets["domains"]) == 2 and facets["actors"]
    meta = get(served, "/api/v2/ext/meta")
    assert meta["articles"] == facets["matched_articles"] and meta["model"] == "m" and "hybridrel" in meta["sort_modes"]
    assert get(served, "/api/v2/ext/health")["status"] == "ok" and "/api/v2/attention/events/{event}/spread" in get(served, "/")["endpoints"]


def test_store(served):
    hits = get(served, "/api/v2/attention/search", "q=urgent&limit=7")
    assert len(hits["events"]) == 7 <= hits["total"] and hits["events"][0]["title_hits"] >= hits["events"][1]["title_hits"] and "search_text" not in hits["events"][0]
    page = get(served, "/api/v2/attention/events", "type=MACHINERY&limit=3&offset=1")
    assert len(page["events"]) == 3 and page["total"] == served.store.events.where(F.array_contains("event_types", "MACHINERY")).count() and page["meta"] == {"model": "m"}
    one = get(served, "/api/v2/attention/events/5", "sample=2")
    assert one["event"]["macro_event_id"] == 5 and len(one["sample_documents"]) == 2 and one["family"]["family_id"] == one["event"]["family_id"]
    family = get(served, f"/api/v2/attention/families/{one['family']['family_id']}")
    assert 5 in [e["macro_event_id"] for e in family["events"]]
    assert get(served, "/api/v2/attention/event-types")["types"]


def test_responses(served):
    a = "/api/v2/attention/analytics"
    o = "level=incident&min_covered_events=1&min_effective_reports=0"
    table = get(served, f"{a}/countries", o)
    rows = table["publisher_countries"]
    assert table["filters"]["level"] == "incident" and table["support"]["min_covered_events"] == 1 and rows[0]["foreign"]["covered_events"] >= rows[-1]["foreign"]["covered_events"]
    code = rows[0]["publisher_country"]
    view = get(served, f"{a}/destinations/{code.lower()}", o)
    assert view["foreign"]["eligible_events"] == rows[0]["foreign"]["eligible_events"] == sum(r["eligible_events"] for r in view["by_origin"])
    origin = view["by_origin"][0]["origin_country"]
    pair = get(served, f"{a}/pairs", f"{o}&origin={origin}&destination={code}&limit=2")
    assert pair["forward"]["summary"]["eligible_events"] == view["by_origin"][0]["eligible_events"] and len(pair["forward"]["events"]) <= 2 and "reverse" in pair
    assert get(served, f"{a}/countries/{code}", o)["foreign"] == view["foreign"]
    assert get(served, f"{a}/origins/{origin}", o)["by_destination"]
    cells = get(served, f"{a}/matrix", f"{o}&origin={origin},{code}")
    assert len(cells["cells"]) == 4 and [r["publisher_country"] for r in cells["destination_rows"]] == [origin, code]
    first = get(served, f"{a}/events", f"{o}&destination={code}&kind=foreign&limit=3")
    second = get(served, f"{a}/events", f"{o}&destination={code}&kind=foreign&limit=2&offset=1")
    assert first["total"] == view["foreign"]["eligible_events"] and second["events"] == first["events"][1:]


@pytest.mark.parametrize(
    "path, query, status",
    [
        ("/api/v2/doc/doc", "mode=nothing", 400), ("/api/v2/doc/doc", "query=OR a", 400), ("/api/v2/doc/doc", "maxrecords=0", 400), ("/api/v2/doc/doc", "maxrecords=x", 400), ("/api/v2/doc/doc", "timespan=3x", 400), ("/api/v2/doc/doc", "format=csv", 400),
        ("/api/v2/ext/events", "quadclass=5", 400), ("/api/v2/ext/events/987654321", "", 404), ("/api/v2/attention/events/987654321", "", 404), ("/api/v2/attention/search", "", 400), ("/api/v2/attention/event-types/none/countries", "", 404),
        ("/api/v2/attention/analytics/countries", "level=world", 400), ("/api/v2/attention/analytics/matrix", "", 400), ("/api/v2/attention/analytics/origins/zz", "", 404), ("/api/v2/none", "", 404),
    ],
)
def test_errors(served, path, query, status):
    assert web.answer(served, path, query)[0] == status


def test_served_from_folders(spark, served, tmp_path):
    from newsloom import __main__ as cli

    for name, t in (("articles", served.explorer.articles), ("article_events", served.explorer.links), ("events", served.explorer.events)):
        t.write.parquet(f"{tmp_path}/x/{name}")
    served.observations.write.parquet(f"{tmp_path}/o")
    again = cli.served(spark, cli.parser().parse_args(["serve", "--explorer", f"{tmp_path}/x", "--observations", f"{tmp_path}/o"]))
    assert get(again, "/api/v2/ext/health")["articles"] == served.explorer.articles.count() and web.answer(again, "/api/v2/attention/countries")[0] == 503


def test_wsgi(served):
    said = []
    app = web.application(web.Served(explorer=served.explorer))
    body = b"".join(app({"REQUEST_METHOD": "GET", "PATH_INFO": "/api/v2/ext/health", "QUERY_STRING": ""}, lambda s, h: said.append((s, dict(h)))))
    assert said[0][0] == "200 OK" and int(said[0][1]["Content-Length"]) == len(body) and json.loads(body)["status"] == "ok"
    app({"PATH_INFO": "/api/v2/attention/countries"}, lambda s, h: said.append((s, h)))
    app({"REQUEST_METHOD": "POST", "PATH_INFO": "/"}, lambda s, h: said.append((s, h)))
    assert [s[0].split()[0] for s in said[1:]] == ["503", "405"]
