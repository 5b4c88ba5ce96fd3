"""The read interface over HTTP: a WSGI application on the query functions.

A route names its parameters with their limits; its answer is a dictionary made of results
that are already limited. Only what is asked for runs in Spark. Wrong parameters are
answered with 400, unknown ids with 404, tables that aren't served with 503.

    web.serve(web.Served(store=serving.AttentionStore.open(spark, folder)), port=8000)
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime
from html import escape
from typing import Any
from urllib.parse import parse_qs, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.core import lookup
from newsloom.functions.fixed import EVENT_FIELDS, EVENT_ROOT_CODES, QUAD_CLASSES
from newsloom.functions.times import parse_window, stamp
from newsloom.operators import responses
from newsloom.plans import explorer, payloads, serving
from newsloom.sources import sinks

EXPLORER, STORE, ANALYTICS = "/api/v2", "/api/v2/attention", "/api/v2/attention/analytics"
_STAMP = "yyyyMMdd'T'HHmmss'Z'"


class Unavailable(LookupError):
    """The tables behind a route aren't served."""


@dataclass
class Served:
    """What the application answers from; a part that is missing answers 503."""

    store: serving.AttentionStore | None = None
    explorer: explorer.Explorer | None = None
    observations: DataFrame | None = None
    meta: dict = field(default_factory=dict)

    def part(self, name: str) -> Any:
        found = getattr(self, name)
        if found is None:
            raise Unavailable(f"the {name} isn't served")
        return found


@dataclass(frozen=True)
class Param:
    """How a parameter is read, and what it may be."""

    read: Callable[[str], Any] = str
    default: Any = None
    low: float | None = None
    high: float | None = None
    among: tuple[str, ...] = ()
    many: bool = False
    needed: bool = False

    def value(self, name: str, given: list[str]) -> Any:
        if self.many:
            return given
        if not given or given[-1] == "":
            if self.needed:
                raise ValueError(f"{name} is needed")
            return self.default
        try:
            found = self.read(given[-1])
        except ValueError as e:
            raise ValueError(f"{name}: {e}") from e
        if self.among and found not in self.among:
            raise ValueError(f"{name} must be one of {', '.join(self.among)}")
        if (self.low is not None and found < self.low) or (self.high is not None and found > self.high):
            raise ValueError(f"{name} must be between {self.low} and {self.high}")
        return found


def _flag(value: str) -> bool:
    if value.lower() not in ("true", "false", "1", "0"):
        raise ValueError("neither true nor false")
    return value.lower() in ("true", "1")


def _lower(value: str) -> str:
    return value.lower()


def count(default: int, high: int, low: int = 1) -> Param:
    return Param(int, default, low, high)


ROUTES: list[tuple[re.Pattern, dict[str, Param], Callable]] = []


def route(path: str, **params: Param):
    """Register a handler (served, values) for ``path``; ``<name>`` is a number, ``{name}`` a word."""
    pattern = re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", re.sub(r"<(\w+)>", r"(?P<\1>\\d+)", path))

    def add(f: Callable[[Served, dict], dict]) -> Callable:
        ROUTES.append((re.compile(f"^{pattern}$"), params, f))
        return f

    return add


def answer(served: Served, path: str, query: str = "") -> tuple[int, dict]:
    """(status, payload) of a request."""
    for pattern, params, handler in ROUTES:
        found = pattern.match(path.rstrip("/") or "/")
        if not found:
            continue
        try:
            given = parse_qs(query)
            values = {name: p.value(name, given.get(name, [])) for name, p in params.items()}
            values |= {k: int(v) if v.isdigit() else unquote(v) for k, v in found.groupdict().items()}
            return 200, handler(served, values)
        except Unavailable as e:
            return 503, {"detail": str(e)}
        except serving.NotFound as e:
            return 404, {"detail": str(e)}
        except ValueError as e:
            return 400, {"detail": str(e)}
    return 404, {"detail": "no such route"}


def application(served: Served) -> Callable[[dict, Callable], Iterable[bytes]]:
    """The WSGI application: GET only, JSON only."""
    reasons = {200: "OK", 400: "Bad Request", 404: "Not Found", 405: "Method Not Allowed", 503: "Service Unavailable"}

    def run(environ: dict, start: Callable) -> Iterable[bytes]:
        if environ.get("REQUEST_METHOD", "GET") != "GET":
            status, payload = 405, {"detail": "only GET is served"}
        else:
            status, payload = answer(served, environ.get("PATH_INFO", "/"), environ.get("QUERY_STRING", ""))
        body = json.dumps(payload, ensure_ascii=False).encode()
        start(f"{status} {reasons[status]}", [("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(body))), ("Access-Control-Allow-Origin", "*")])
        return [body]

    return run


def serve(served: Served, port: int = 8000, host: str = "127.0.0.1") -> None:
    from wsgiref.simple_server import make_server

    with make_server(host, port, application(served)) as server:
        server.serve_forever()


# ---------------------------------------------------------------- explorer

_WINDOW = {"query": Param(default=""), "timespan": Param(), "startdatetime": Param(), "enddatetime": Param()}


def _request(v: dict) -> explorer.Request:
    return explorer.Request(v["query"], v["startdatetime"], v["enddatetime"], v["timespan"])


def _window(since: datetime, to: datetime) -> dict:
    return {"start": stamp(since), "end": stamp(to)}


def article_columns() -> list:
    """An article in answers; lists are cut to their first items."""
    return [
        F.col("url"), F.lit("").alias("url_mobile"), F.col("title"), F.date_format("seendate", _STAMP).alias("seendate"), F.lit("").alias("socialimage"), F.col("domain"), F.col("language"), F.col("sourcecountry"),
        F.round("tone", 4).alias("tone"), F.col("numevents"), F.col("themes"), F.slice("locations", 1, 5).alias("locations"), F.slice("eventids", 1, 25).alias("eventids"),
    ]


def _series(name: str, rows: DataFrame, value: str) -> dict:
    return {"series": name, "data": sinks.records(rows.orderBy("bucket").select(F.date_format("bucket", _STAMP).alias("date"), F.col(value).alias("value")))}


@route(f"{EXPLORER}/doc/doc", **_WINDOW, mode=Param(_lower, "artlist", among=explorer.DOC_MODES), format=Param(_lower, "json", among=("json",)), sort=Param(_lower, "datedesc", among=tuple(explorer.SORTS)), maxrecords=count(75, 250))
def _doc(served: Served, v: dict) -> dict:
    x, mode = served.part("explorer"), v["mode"]
    if mode == "tonechart":
        found = x.selected(_request(v))[0]
        order = [F.desc_nulls_last("numevents"), F.desc("seendate"), "url"]
        rows = explorer.tone_chart(found.withColumn("record", F.struct(*article_columns())), order=order, item="record").orderBy("bin")
        return {"tonechart": sinks.records(rows.select("bin", "count", F.col("top").alias("toparts")))}
    rows = x.doc(_request(v), mode, v["sort"], v["maxrecords"])
    if mode == "artlist":
        return {"articles": sinks.records(rows.select(*article_columns()))}
    if mode == "timelinetone":
        return {"timeline": [_series("Average Tone", rows, "tone")]}
    if mode == "timelinevol":
        return {"timeline": [_series("Volume Intensity", rows, "intensity")]}
    return {"timeline": [_series("Article Count", rows, "matched"), _series("Total Monitoring Volume", rows, "total")]}


@route(f"{EXPLORER}/geo/geo", **_WINDOW, mode=Param(_lower, "pointdata", among=("pointdata", "pointheat")), format=Param(_lower, "geojson", among=("geojson",)), maxpoints=count(500, 5000))
def _geo(served: Served, v: dict) -> dict:
    x, r = served.part("explorer"), _request(v)
    out = payloads.geojson(x.geo(r, v["maxpoints"]))
    for feature in out["features"]:
        p = feature["properties"]
        links = "".join(f'<a href="{escape(url)}">{escape(title)}</a><br>' for url, title in zip(p["urls"], p["titles"]))
        p |= {"shareimage": "", "html": f"<b>{escape(p['name'])}</b><br>{links}"}
    return out | {"query": v["query"], "window": _window(*x.window(r))}


def _event_records(events: DataFrame) -> list[dict]:
    shown = events.withColumn("dateadded", F.date_format("dateadded", _STAMP)).withColumn("quadlabel", lookup(QUAD_CLASSES, F.col("QuadClass").cast("int"), F.lit("")))
    return sinks.records(shown.select(*[F.col(c).alias(name) for name, c in EVENT_FIELDS.items()]))


@route(f"{EXPLORER}/ext/events", **_WINDOW, quadclass=Param(int, None, 1, 4), rootcode=Param(), country=Param(), maxrecords=count(100, 250))
def _events(served: Served, v: dict) -> dict:
    x, r = served.part("explorer"), _request(v)
    rows = _event_records(x.event_list(r, v["quadclass"], v["rootcode"], v["country"], v["maxrecords"]))
    return {"window": _window(*x.window(r)), "count": len(rows), "events": rows}


@route(f"{EXPLORER}/ext/events/<event>", maxrecords=count(50, 250))
def _event(served: Served, v: dict) -> dict:
    x = served.part("explorer")
    rows = _event_records(x.events.where(F.col("GlobalEventID") == v["event"]).limit(1))
    if not rows:
        raise serving.NotFound(f"event {v['event']} is not in these tables")
    return {"event": rows[0], "articles": sinks.records(x.event_articles(v["event"], v["maxrecords"]).select(*article_columns()))}


@route(f"{EXPLORER}/ext/facets", **_WINDOW, limit=count(15, 100))
def _facets(served: Served, v: dict) -> dict:
    x, r = served.part("explorer"), _request(v)
    found, since, to = x.selected(r)
    named = dict.fromkeys(("domains", "languages", "sourcecountries", "themes", "locations", "actors"), [])
    return {"window": _window(since, to), "matched_articles": found.count()} | named | payloads.facet_lists(explorer.facets(found, v["limit"]))


@route(f"{EXPLORER}/ext/meta")
def _meta(served: Served, v: dict) -> dict:
    x = served.part("explorer")
    operators = ["term", '"quoted phrase"', "-negated", "a OR b", *(f"{f}:" for f in ("domain", "domainis", "sourcelang", "sourcecountry", "theme", "location", "actor", "quadclass"))]
    given = payloads.explorer_meta(x.articles, x.events, ("title", "sourcecountry"))
    return given | served.meta | {
        "coverage": _window(*x.window(explorer.Request())), "doc_modes": list(explorer.DOC_MODES), "sort_modes": list(explorer.SORTS), "query_operators": operators, "quadclasses": QUAD_CLASSES, "rootcodes": EVENT_ROOT_CODES,
    }


@route(f"{EXPLORER}/ext/health")
def _health(served: Served, v: dict) -> dict:
    return {"status": "ok", "articles": served.part("explorer").articles.count()}


@route("/")
def _root(served: Served, v: dict) -> dict:
    shown = lambda p: re.sub(r"\(\?P<(\w+)>[^)]*\)", r"{\1}", p.pattern.strip("^$"))
    return {"service": "newsloom", "endpoints": [shown(p) for p, _, _ in ROUTES]}


# ---------------------------------------------------------------- store


def _envelope(served: Served, payload: dict) -> dict:
    return payload | {"meta": served.meta}


def _event_rows(rows: DataFrame) -> list[dict]:
    return sinks.records(rows.drop("search_text"))


@route(f"{STORE}/search", q=Param(needed=True), limit=count(20, 200))
def _search(served: Served, v: dict) -> dict:
    s = served.part("store")
    hits, groups = s.search(v["q"]), s.search_families(v["q"])
    return _envelope(served, {
        "query": v["q"], "total": hits.count(), "total_families": groups.count(), "families": sinks.records(groups.limit(v["limit"])), "events": _event_rows(hits.limit(v["limit"])),
    })


@route(
    f"{STORE}/events", q=Param(), type=Param(), event_country=Param(), family_id=Param(int), sort=Param(default="effective_reports", among=tuple(serving.EVENT_SORTS)), limit=count(100, 1000), offset=Param(int, 0, 0)
)
def _list_events(served: Served, v: dict) -> dict:
    s = served.part("store")
    asked = (v["q"], v["type"], v["event_country"], v["family_id"], v["sort"])
    return _envelope(served, {"total": s.matching(*asked[:4]).count(), "events": _event_rows(s.list_events(*asked, v["limit"], v["offset"]))})


@route(f"{STORE}/events/<event>", sample=Param(int, 10, 0, 100))
def _event_detail(served: Served, v: dict) -> dict:
    s, event = served.part("store"), v["event"]
    one = _event_rows(s.event(event))[0]
    family = sinks.records(s.t["event_families"].where(F.col("family_id") == one["family_id"]).limit(1))
    return _envelope(served, {"event": one, "family": family[0] if family else None, "languages": sinks.records(s.languages(event)), "sample_documents": sinks.records(s.samples(event, v["sample"]))})


@route(f"{STORE}/families/<family>")
def _family_detail(served: Served, v: dict) -> dict:
    s = served.part("store")
    one = sinks.records(s.family(v["family"]))[0]
    events = s.events.where(F.col("family_id") == v["family"]).orderBy(F.desc("effective_reports"), "macro_event_id")
    return _envelope(served, {"family": one, "events": _event_rows(events)})


def _subject(s: serving.AttentionStore, v: dict) -> dict:
    """The event or family of a route, which has to be there."""
    if "event" in v:
        s.event(v["event"])
        return {"event": v["event"]}
    s.family(v["family"])
    return {"family": v["family"]}


_SPREAD = {"min_country_confidence": Param(float, 0.0, 0.0, 1.0), "limit": count(500, 5000), "offset": Param(int, 0, 0)}
_VALUES = ("raw_documents", "unique_domains", "effective_reports", "raw_share")


def _spread(served: Served, v: dict) -> dict:
    s = served.part("store")
    subject = _subject(s, v)
    if v.get("include_family"):
        subject = {"family": s.event(v["event"]).select("family_id").first()[0]}
    documents, countries, totals = s.spread(**subject, confidence=v["min_country_confidence"], offset=v["offset"], limit=v["limit"])
    shown = documents.select(*[c for c in serving.SPREAD_COLUMNS if c in documents.columns])
    return _envelope(served, subject | sinks.summary_json(totals) | {"offset": v["offset"], "limit": v["limit"], "countries": sinks.records(countries), "documents": sinks.records(shown)})


def _timeline(served: Served, v: dict) -> dict:
    s = served.part("store")
    subject = _subject(s, v)
    world, series = s.timeline(**subject, countries=v["publisher_countries"], value=v["value"])
    return _envelope(served, subject | {"bucket": "1h", "value": v["value"], "world": sinks.records(world), "publisher_countries": sinks.records(series)})


def _countries(served: Served, v: dict) -> dict:
    s = served.part("store")
    subject = _subject(s, v)
    rows = sinks.records(s.countries(**subject, least_domains=v["min_unique_domains"], suppressed=v["include_suppressed"]))
    return _envelope(served, subject | {"world_onset": rows[0]["world_onset"] if rows else None, "publisher_countries": rows})


route(f"{STORE}/events/<event>/spread", **_SPREAD, include_family=Param(_flag, False))(_spread)
route(f"{STORE}/families/<family>/spread", **_SPREAD)(_spread)
for _of in ("events/<event>", "families/<family>"):
    route(f"{STORE}/{_of}/timeline", publisher_countries=Param(), value=Param(default=_VALUES[0], among=_VALUES))(_timeline)
    route(f"{STORE}/{_of}/countries", min_unique_domains=Param(int, 1, 1), include_suppressed=Param(_flag, True))(_countries)


@route(f"{STORE}/event-types")
def _types(served: Served, v: dict) -> dict:
    return _envelope(served, {"types": sinks.records(served.part("store").types())})


@route(f"{STORE}/event-types/{{kind}}/countries", min_events=Param(int, 3, 1), min_country_documents=Param(int, 1000, 1))
def _type_countries(served: Served, v: dict) -> dict:
    s, kind = served.part("store"), str(v["kind"])
    n = s.events.where(F.array_contains("event_types", kind)).count()
    if not n:
        raise serving.NotFound(f"no event is of type {kind}")
    return _envelope(served, {"type": kind, "macro_events": n, "publisher_countries": sinks.records(s.type_countries(kind, v["min_events"], v["min_country_documents"]))})


@route(f"{STORE}/documents/<document>/evidence")
def _evidence(served: Served, v: dict) -> dict:
    s = served.part("store")
    edges, checks = s.evidence(v["document"])
    own = sinks.records(s.documents.where((F.col("document_id") == v["document"]) & F.col("is_primary")).limit(1))[0]
    rows = sinks.records(edges.drop("own_country"))
    incident = _event_rows(s.events.where(F.col("macro_event_id") == own["macro_event_id"]).limit(1))
    side = lambda same: [r for r in rows if r["same_incident"] is same]
    return _envelope(served, {
        "document": own, "incident": incident[0] if incident else None, "assignment_score": own.get("assignment_score"), "checks": sinks.summary_json(checks), "supporting": side(True), "competing": side(False),
    })


@route(f"{STORE}/countries")
def _baseline(served: Served, v: dict) -> dict:
    return _envelope(served, {"publisher_countries": sinks.records(served.part("store").baseline())})


# ---------------------------------------------------------------- analytics

_FILTERS = {
    "level": Param(default="family", among=responses.LEVELS), "event_type": Param(many=True), "min_event_effective_reports": Param(int, 0, 0), "max_event_effective_reports": Param(int, None, 1), "start": Param(parse_window), "end": Param(parse_window),
    "resolution_model": Param(), "reference": Param(default="origin_preferred", among=responses.REFERENCES), "min_covered_events": Param(int, 5, 1), "min_effective_reports": Param(int, 15, 0),
}


class _Asked:
    """Filtered observations of a request, with summaries as values."""

    def __init__(self, served: Served, v: dict) -> None:
        self.served = served
        self.filters = responses.Filters(
            v["level"], event_types=tuple(t for t in v["event_type"] if t), min_event_effective_reports=v["min_event_effective_reports"], max_event_effective_reports=v["max_event_effective_reports"],
            start=v["start"], end=v["end"], resolution_model=v["resolution_model"], reference=v["reference"],
        )
        self.support = responses.Support(v["min_covered_events"], v["min_effective_reports"])
        self.rows = responses.apply_filters(served.part("observations"), self.filters)

    def where(self, **codes: str | list[str]) -> DataFrame:
        rows = self.rows
        for side, code in codes.items():
            rows = rows.where(F.col(f"{side}_country").isin(*([code] if isinstance(code, str) else code)))
        return rows

    def total(self, rows: DataFrame) -> dict | None:
        """One summary of all rows; None where there are none."""
        found = sinks.records(responses.summarize(rows.withColumn("_all", F.lit(0)), ["_all"], self.support, bootstrap=True).drop("_all"))
        return found[0] if found else None

    def by(self, rows: DataFrame, key: str, limit: int | None = None) -> list[dict]:
        out = responses.by_most_covered(responses.summarize(rows, [key], self.support, bootstrap=True), key)
        return sinks.records(out if limit is None else out.limit(limit))

    def by_type(self, rows: DataFrame) -> list[dict]:
        return sinks.records(responses.summarize_by_type(rows, self.support))

    def code(self, value: str) -> str:
        """A country that the observations know, in upper case."""
        code = str(value).strip().upper()
        if self.served.part("observations").where(F.col("destination_country") == code).limit(1).isEmpty():
            raise serving.NotFound(f"country {code} is not in the observations")
        return code

    def codes(self, values: list[str]) -> list[str]:
        return [self.code(c) for c in serving.code_list(values)]

    def envelope(self, payload: dict) -> dict:
        return _envelope(self.served, payload | {"filters": payloads.as_dict(self.filters), "support": payloads.as_dict(self.support)})

    def pair(self, origin: str, destination: str) -> tuple[DataFrame, dict]:
        rows = self.where(origin=origin, destination=destination)
        rows = responses.domestic(rows) if origin == destination else rows
        kind = "domestic" if origin == destination else "foreign"
        return rows, {"origin_country": origin, "destination_country": destination, "kind": kind, "summary": self.total(rows), "by_event_type": self.by_type(rows)}


@route(f"{ANALYTICS}/countries", **_FILTERS)
def _country_table(served: Served, v: dict) -> dict:
    a = _Asked(served, v)
    abroad, home = (({r["destination_country"]: r for r in a.by(rows, "destination_country")}) for rows in (responses.foreign(a.rows), responses.domestic(a.rows)))
    covered = lambda side, c: side.get(c, {}).get("covered_events") or 0
    order = sorted({*abroad, *home}, key=lambda c: (-covered(abroad, c), -covered(home, c), c))
    return a.envelope({"publisher_countries": [{"publisher_country": c, "foreign": abroad.get(c), "domestic": home.get(c)} for c in order]})


@route(f"{ANALYTICS}/countries/{{country}}", **_FILTERS, top_origins=count(15, 100))
def _country_overview(served: Served, v: dict) -> dict:
    a = _Asked(served, v)
    code = a.code(v["country"])
    abroad, home = responses.foreign(a.where(destination=code)), responses.domestic(a.where(destination=code))
    return a.envelope({
        "publisher_country": code, "foreign": a.total(abroad), "domestic": a.total(home), "by_event_type": a.by_type(abroad), "by_origin": a.by(abroad, "origin_country", v["top_origins"]),
        "by_magnitude": sinks.records(responses.summarize_by_magnitude(abroad, a.support)), "domestic_by_event_type": a.by_type(home),
    })


@route(f"{ANALYTICS}/pairs", **_FILTERS, origin=Param(needed=True), destination=Param(needed=True), limit=Param(int, 200, 0, 2000))
def _pair(served: Served, v: dict) -> dict:
    a = _Asked(served, v)
    origin, destination = a.code(v["origin"]), a.code(v["destination"])
    rows, forward = a.pair(origin, destination)
    out = {"forward": forward | {"events": sinks.records(responses.event_records(rows, v["limit"]))}}
    return a.envelope(out if origin == destination else out | {"reverse": a.pair(destination, origin)[1]})


@route(f"{ANALYTICS}/matrix", **_FILTERS, origin=Param(many=True), destination=Param(many=True))
def _matrix(served: Served, v: dict) -> dict:
    a = _Asked(served, v)
    origins, destinations = a.codes(v["origin"]), a.codes(v["destination"])
    if not origins and not destinations:
        raise ValueError("name an origin or a destination")
    origins, destinations = origins or destinations, destinations or origins
    cells = serving.Analytics(served.part("observations"), a.support).matrix(a.filters, origins, destinations)
    into = a.where(destination=destinations)
    side = lambda rows: {r["destination_country"]: r for r in a.by(rows, "destination_country")}
    parts = {"foreign": side(responses.foreign(into)), "domestic": side(responses.domestic(into)), "foreign_from_selected_origins": side(responses.foreign(into.where(F.col("origin_country").isin(*origins))))}
    rows = [{"publisher_country": c} | {name: p.get(c) for name, p in parts.items()} for c in destinations]
    return a.envelope({"origins": origins, "destinations": destinations, "cells": sinks.records(cells), "destination_rows": rows})


@route(f"{ANALYTICS}/origins/{{country}}", **_FILTERS)
def _origin_view(served: Served, v: dict) -> dict:
    a = _Asked(served, v)
    code = a.code(v["country"])
    rows = a.where(origin=code)
    abroad = responses.foreign(rows)
    return a.envelope({"origin_country": code, "world": a.total(abroad), "domestic": a.total(responses.domestic(rows)), "by_destination": a.by(abroad, "destination_country"), "by_event_type": a.by_type(abroad)})


@route(f"{ANALYTICS}/destinations/{{country}}", **_FILTERS)
def _destination_view(served: Served, v: dict) -> dict:
    a = _Asked(served, v)
    code = a.code(v["country"])
    rows = a.where(destination=code)
    abroad = responses.foreign(rows)
    return a.envelope({"destination_country": code, "foreign": a.total(abroad), "domestic": a.total(responses.domestic(rows)), "by_origin": a.by(abroad, "origin_country")})


@route(
    f"{ANALYTICS}/events", **_FILTERS, origin=Param(many=True), destination=Param(many=True), kind=Param(default="all", among=("all", "foreign", "domestic")), covered_only=Param(_flag, False), limit=count(200, 5000), offset=Param(int, 0, 0)
)
def _drilldown(served: Served, v: dict) -> dict:
    a = _Asked(served, v)
    sides = {k: a.codes(v[k]) for k in ("origin", "destination")}
    rows = a.where(**{k: c for k, c in sides.items() if c})
    rows = {"all": lambda x: x, "foreign": responses.foreign, "domestic": responses.domestic}[v["kind"]](rows)
    rows = rows.where("covered") if v["covered_only"] else rows
    page = sinks.records(responses.event_records(rows, v["offset"] + v["limit"]).offset(v["offset"]))
    return a.envelope({"total": rows.count(), "offset": v["offset"], "limit": v["limit"], "summary": a.total(rows), "events": page})
