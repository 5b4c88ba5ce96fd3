"""Earlier generations of the resolution: event projection, article graph, entity and title mix."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, is_dataclass
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.core import lookup, no_strings
from newsloom.functions.fixed import BENCHMARK_PATTERNS, STOPWORDS, STORY_PATTERNS
from newsloom.functions.text import _unescape
from newsloom.functions.times import to_utc
from newsloom.functions.urls import clean_token, slug_path, url_domain, url_words
from newsloom.operators import filters, postings, similarity, vectors
from newsloom.operators.components import connected_components
from newsloom.operators.partition import communities
from newsloom.operators.ranking import gathered, mode_per_key, top_per_key
from newsloom.plans.cutpoint import materialize

# fixed values: an event's titles in five languages
QUAKE_TITLES = r"(?i)earthquake|quake|erdbeben|s[ée]isme|terremoto|sismo|地震"
# fixed values: what makes a document a bridge between incidents
BRIDGE_RISK = {"titleless": 1.0, "generic": 1.0, "degree": 0.25, "specificity": 1.0, "corroboration": 1.0}
# fixed values: the settings that sweeps try
GATE_SWEEP = {"title_veto": (0.0, 0.15, 0.25), "min_features": (1, 2, 3), "threshold": (0.3, 0.4)}
RESOLUTION_SWEEP = {"resolution": (0.02, 0.05, 0.1, 0.2)}
FAMILY_SWEEP = {"family_title": (0.3, 0.4, 0.5), "family_entity": (0.2, 0.3), "family_strong": (0.6, 0.7), "family_resolution": (0.5,)}
PROJECTION_SWEEP = (*(("jaccard", x) for x in (0.05, 0.1, 0.2)), *(("shared", x) for x in (2, 3, 5)))


# ---------------------------------------------------------------- articles of mentions


def articles(mentions: DataFrame, stories: Mapping[str, str] = STORY_PATTERNS) -> DataFrame:
    """Web pages of strictly read mentions: slug, host, time span and a flag a story."""
    web = mentions.where(filters.is_web(F.col("MentionType"), F.col("MentionIdentifier")))
    pages = web.groupBy("MentionIdentifier").agg(F.min("MentionTimeDate").alias("first_seen"), F.max("MentionTimeDate").alias("last_seen"))
    slug = slug_path(F.col("MentionIdentifier"))
    return pages.withColumn("slug", slug).withColumn("domain", url_domain(F.col("MentionIdentifier"))).withColumns({s: F.col("slug").rlike(p) for s, p in stories.items()})


def canonical_articles(mentions: DataFrame, pages: DataFrame) -> DataFrame:
    """``pages`` with ``canonical``: pages with the same set of linked events are wire copies."""
    parts = ["GlobalEventID", "SentenceID", "Actor1CharOffset", "Actor2CharOffset", "ActionCharOffset"]
    same = similarity.wire_fingerprints(mentions, "MentionIdentifier", parts).withColumnRenamed("document", "MentionIdentifier")
    return pages.join(same, "MentionIdentifier")


@dataclass(frozen=True)
class ProjectionSettings:
    confidence: int = 40
    most_events: int = 25
    recurring_articles: int = 1000
    recurring_days: float = 2
    gap_days: float = 3
    shared: int = 2
    most_contributions: int = 50_000_000
    seed: int = 2026


def event_graph(links: DataFrame, s: ProjectionSettings = ProjectionSettings()) -> DataFrame:
    """(left, right, shared, jaccard) of events by the canonical articles they share. ``links``:
    canonical, GlobalEventID, Confidence, MentionTimeDate."""
    kept = filters.without_roundups(links, "canonical", "GlobalEventID", s.most_events, "Confidence", s.confidence)
    often = filters.recurring_events(kept, "canonical", "GlobalEventID", "MentionTimeDate", s.recurring_articles, s.recurring_days)
    rest = filters.without(kept, often, "GlobalEventID")
    rows = rest.select(F.col("GlobalEventID").alias("node"), F.col("canonical").alias("feature")).distinct()
    similarity.guard(rows, s.most_contributions, cap=1 << 40)
    return similarity.projection(rest, "canonical", "GlobalEventID", s.shared, "MentionTimeDate", s.gap_days)


def partition_events(graph: DataFrame, metric: str, threshold: float, method: str, seed: int = 2026) -> DataFrame:
    """(node, community) by components, or by modularity over edges of ``metric`` and above."""
    edges = graph.where(F.col(metric) >= threshold)
    if method == "components":
        return connected_components(edges).withColumnRenamed("component", "community")
    return communities(edges, 1.0, metric, modularity=True, seed=seed)


def article_memberships(links: DataFrame, events: DataFrame) -> DataFrame:
    """(canonical, cluster): an article is in every cluster of its events."""
    own = events.select(F.col("node").alias("GlobalEventID"), F.col("community").alias("cluster"))
    return links.join(own, "GlobalEventID").select("canonical", "cluster").distinct()


# ---------------------------------------------------------------- article graph


def token_rows(pages: DataFrame, clean: bool = True) -> DataFrame:
    """(node, domain, day, feature): topic words of paths."""
    words = url_words(F.col("slug"))
    words = F.filter(words, clean_token) if clean else words
    return pages.select(F.col("canonical").alias("node"), "domain", F.col("first_seen").cast("date").alias("day"), F.explode(words).alias("feature")).distinct()


def label_rows(links: DataFrame, labels: DataFrame, days: DataFrame) -> DataFrame:
    """The same from the actors and places of an article's events; no host."""
    joined = links.join(labels, "GlobalEventID")
    named = lambda p, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(p), c))
    every = F.array_compact(F.array(named("actor:", F.col("Actor1Name")), named("actor:", F.col("Actor2Name")), named("geo:", F.col("ActionGeo_FullName"))))
    rows = joined.select(F.col("canonical").alias("node"), F.explode(every).alias("feature")).distinct()
    return rows.join(days.select(F.col("canonical").alias("node"), "day"), "node").select("node", F.lit("").alias("domain"), "day", "feature")


def filtered_rows(rows: DataFrame, steady: float = 0.95, burst_least: int = 100, host_least: int = 20, host_share: float = 0.2) -> DataFrame:
    """Without features of even spread over days, and without words that mark a host."""
    even = filters.bursty(rows, "feature", "node", F.col("day"), steady, burst_least).where("steady").select("feature")
    kept = filters.without(rows, even, "feature")
    marks = filters.host_boilerplate(kept, "domain", "feature", "node", host_least, host_share).select("domain", "feature")
    return filters.without(kept, marks, ["domain", "feature"]).select("node", "feature").distinct()


@dataclass(frozen=True)
class ArticleSettings:
    neighbours: int = 50
    cap: int = 2000
    most_contributions: int = 200_000_000
    min_channels: int = 2
    floor: float = 0.6
    family_least: float = 0.25
    family_size: int = 2
    family_neighbours: int = 10


def article_pairs(nodes: DataFrame, channels: Mapping[str, DataFrame], s: ArticleSettings = ArticleSettings(), caps: Mapping[str, int] | None = None) -> DataFrame:
    """Pairs that any channel proposes, with all channels' scores and the mean gate."""
    weights, proposed = {}, {}
    for name, rows in channels.items():
        cap = (caps or {}).get(name, s.cap)
        similarity.guard(rows, s.most_contributions, cap=cap)
        weights[name] = similarity.tfidf(rows, nodes, cap=cap)
        near = similarity.nearest(similarity.cosine_pairs(weights[name], most=None), s.neighbours)
        proposed[name] = near.select(F.col("node").alias("left"), F.col("neighbor").alias("right"))
    pairs = similarity.candidate_union(proposed)
    for name, w in weights.items():
        pairs = similarity.channel_scores(pairs, w, name)
    return similarity.mean_gate(pairs, list(channels), s.min_channels, s.floor)


def article_totals(nodes: DataFrame, channels: Mapping[str, DataFrame], s: ArticleSettings = ArticleSettings()) -> DataFrame:
    """(left, pairs, combined, gated): ``article_pairs`` with no neighbour and no feature cut
    off, added up by the smaller node, at a row a feature of a node instead of one a pair.

    Nodes are whole numbers, features of one type in all channels.
    """
    every = None
    for i, rows in enumerate(channels.values()):
        w = similarity.tfidf(rows, nodes, cap=1 << 62, keep_df=True).withColumns({"channel": F.lit(i), "has": F.lit(1 << i)})
        every = w if every is None else every.unionByName(w)
    return postings.mean_totals(materialize(postings.by_node(every), "postings"), s.min_channels, s.floor)


def plain_mean(pairs: DataFrame, names: Sequence[str] = ("event", "url")) -> DataFrame:
    """The first version's score: the channels' sum over their number, shared or not."""
    return pairs.withColumn("combined", sum((F.col(f"{n}_score") for n in names), F.lit(0.0)) / len(names))


def centroid_families(members: DataFrame, channels: Mapping[str, DataFrame], s: ArticleSettings = ArticleSettings()) -> DataFrame:
    """(node, cluster, family): clusters with close centroids, linked by components.

    ``members``: node, cluster. Clusters too small to compare are families of their own,
    numbered after the others.
    """
    fit = members.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= s.family_size).select("cluster")
    own = members.join(fit, "cluster", "left_semi")
    centroids, proposed = {}, {}
    for name, w in channels.items():
        sums = own.join(w, "node").groupBy(F.col("cluster").alias("node"), "feature").agg(F.sum("weight").alias("weight"))
        size = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("node")))
        centroids[name] = sums.withColumn("weight", F.col("weight") / size)
        near = similarity.nearest(similarity.cosine_pairs(centroids[name]), s.family_neighbours)
        proposed[name] = near.select(F.col("node").alias("left"), F.col("neighbor").alias("right"))
    pairs = similarity.candidate_union(proposed)
    for name, c in centroids.items():
        pairs = similarity.channel_scores(pairs, c, name)
    mean = sum((F.col(f"{n}_score") for n in channels), F.lit(0.0)) / max(len(channels), 1)
    linked = connected_components(pairs.where(mean >= s.family_least))
    led = fit.join(linked, F.col("cluster") == F.col("node"), "left").select("cluster", F.coalesce("component", "cluster").alias("lead"))
    # one row a family
    ids = led.select("lead").distinct().withColumn("family", (F.row_number().over(W.orderBy("lead")) - 1).cast("long"))
    offset = ids.agg(F.coalesce(F.max("family") + 1, F.lit(0)).alias("offset"))
    of = led.join(ids, "lead").select("cluster", "family")
    return members.join(of, "cluster", "left").join(offset).select("node", "cluster", F.coalesce("family", F.col("cluster") + F.col("offset")).alias("family"))


# ---------------------------------------------------------------- entity and title mix


def outlets(rows: DataFrame, countries: Mapping[str, str], source: str = "source") -> DataFrame:
    """Rows of the listed domains and below them, with their ``country``; the first fit counts."""
    s = F.col(source)
    found = F.coalesce(*[F.when((s == d) | F.endswith(s, F.lit(f".{d}")), F.lit(c)) for d, c in countries.items()])
    return rows.withColumn("country", found).where("country is not null")


def derived(rows: DataFrame) -> DataFrame:
    """Batch time, language (English by default) and plain title ('' by default)."""
    lang = F.coalesce(F.nullif(F.regexp_extract("translation_info", r"srclc:(\w+)", 1), F.lit("")), F.lit("eng"))
    title = _unescape(F.coalesce(F.regexp_extract("extras", r"<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1), F.lit("")))
    return rows.withColumns({"batch_time": to_utc(F.col("batch_date")), "language": lang, "title": title}).drop("batch_date", "translation_info", "extras")


def entity_tokens(kinds: str) -> Column:
    """Prefixed entities of a row: people, organisations, locations, names, events."""
    items = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != "")
    named = lambda c: F.transform(items(F.col(c)), lambda x: F.regexp_replace(x, ",[^,]*$", ""))
    ways: dict[str, Callable[[], Column]] = {
        "P": lambda: named("persons"), "O": lambda: named("organizations"), "N": lambda: named("all_names"),
        "L": lambda: F.transform(items(F.col("locations")), lambda x: F.get(F.split(x, "#"), F.lit(1))), "E": lambda: F.coalesce(F.col("event_ids").cast("array<string>"), no_strings()),
    }
    prefixed = lambda k: F.transform(ways[k](), lambda x: F.concat(F.lit(f"{k}:"), x))
    return F.concat(*[prefixed(k) for k in kinds])


def entity_weights(rows: DataFrame, nodes: DataFrame, min_df: int = 2, max_share: float = 1.0) -> DataFrame:
    """(node, feature, weight) of token lists: 1 + ln tf, ln((1 + N) / (1 + df)) + 1, length 1."""
    tf = rows.groupBy("node", "feature").agg((F.log(F.count("*")) + 1).alias("tf"))
    n = nodes.agg(F.count("*").alias("n"))
    df = tf.groupBy("feature").agg(F.count("*").alias("df")).join(n).where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n")))
    w = tf.join(df, "feature").withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return w.select("node", "feature", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("node")))).alias("weight"))


def mixed_edges(weights: DataFrame, titles: DataFrame, title_weight: float, threshold: float) -> DataFrame:
    """(left, right, weight): (1 - w) entity cosine + w title cosine, above the threshold.

    A pair needs a shared entity or a near title, whichever of the two can reach it.
    """
    by_entity = similarity.cosine_pairs(weights).withColumnRenamed("score", "e")
    least = max(1e-6, (threshold - (1 - title_weight)) / title_weight) if title_weight > 0 else 1.0
    pairs = by_entity.select("left", "right")
    if title_weight > 0:
        pairs = pairs.union(vectors.pairs_above(titles, least).select("left", "right")).distinct()
    side = lambda k, x: titles.select(F.col("id").alias(k), F.col("vector").alias(x))
    both = pairs.join(by_entity, ["left", "right"], "left").join(side("left", "a"), "left", "left").join(side("right", "b"), "right", "left")
    t = F.coalesce(vectors.dot(F.col("a"), F.col("b")), F.lit(0.0))
    mixed = (1 - title_weight) * F.coalesce("e", F.lit(0.0)) + title_weight * t
    return both.select("left", "right", mixed.alias("weight")).where(F.col("weight") >= threshold)


def event_report(members: DataFrame, pattern: str = QUAKE_TITLES, anchor: str | None = None) -> DataFrame:
    """One row: the cluster of most matching titles (in the anchor's country), its size, purity, recall."""
    rows = members.withColumn("hit", F.col("title").rlike(pattern))
    anchored = rows.where(F.col("hit") & (F.col("country") == anchor if anchor else F.lit(True)))
    best = mode_per_key(anchored.withColumn("one", F.lit(1)), ["one"], "cluster", "event_cluster").select("event_cluster")
    inside = F.col("cluster") == F.col("event_cluster")
    return rows.join(best).groupBy("event_cluster").agg(
        F.count_if(inside).alias("size"), (F.count_if(inside & F.col("hit")) / F.count_if(inside)).alias("purity"), (F.count_if(inside & F.col("hit")) / F.count_if("hit")).alias("recall")
    )


def first_per_country(members: DataFrame, start: str) -> DataFrame:
    """(country, hours_after, source, title): a cluster's first article in each country."""
    hours = F.floor(F.timestamp_diff("MINUTE", F.lit(start).cast("timestamp"), "batch_time") / 60).cast("int")
    return top_per_key(members.withColumn("hours_after", hours), ["country"], ["batch_time", "source", "title"]).select("country", "hours_after", "source", "title")


def hourly_pivot(members: DataFrame, start: str, countries: Sequence[str], hours: int = 48) -> DataFrame:
    after = F.floor(F.timestamp_diff("MINUTE", F.lit(start).cast("timestamp"), "batch_time") / 60).cast("int")
    rows = members.withColumn("hours_after", after).where(F.col("hours_after").between(0, hours - 1))
    return rows.groupBy("hours_after").pivot("country", list(countries)).count().fillna(0)


def top_terms(weights: DataFrame, members: DataFrame, k: int = 12) -> DataFrame:
    """(cluster, terms): the heaviest features of each cluster's mean vector."""
    sums = members.join(weights, "node").groupBy("cluster", "feature").agg(F.sum("weight").alias("w"))
    return gathered(top_per_key(sums, ["cluster"], [F.desc("w"), "feature"], k, "r"), ["cluster"], F.col("feature"), "terms")


# ---------------------------------------------------------------- audits and sweeps


def cluster_words(pages: DataFrame, k: int = 15) -> DataFrame:
    """(cluster, words): topic words by the number of addresses that have them."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.col("slug"), F.lit(r"(?U)([^\W\d_]{3,}|737)"), 1), lambda w: ~w.isin(*STOPWORDS)))
    counted = pages.select("cluster", F.explode(found).alias("w")).groupBy("cluster", "w").agg(F.count("*").alias("n"))
    return gathered(top_per_key(counted, ["cluster"], [F.desc("n"), "w"], k, "r"), ["cluster"], F.struct("w", "n"), "words")


def label_counts(labels: DataFrame, ids: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The most frequent values that aren't empty among the given events."""
    rows = labels.join(ids, "GlobalEventID", "left_semi").where(F.coalesce(column, F.lit("")) != "")
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def bridges(pairs: DataFrame, members: DataFrame, generic: DataFrame) -> DataFrame:
    """A family's documents with edges to other incidents, riskiest first. ``members``:
    document_id, incident_id, title of one family; ``generic``: documents of boilerplate titles."""
    inc = members.select("document_id", "incident_id")
    edges = (
        pairs.where("gated > 0").join(inc.withColumnsRenamed({"document_id": "left", "incident_id": "inc_l"}), "left").join(inc.withColumnsRenamed({"document_id": "right", "incident_id": "inc_r"}), "right")
    )
    cross = edges.where("inc_l <> inc_r").select("left", "right", "title_score", "event_score")
    ends = similarity.both_ways(cross, source="document_id", target="other")
    degree = ends.groupBy("document_id").agg(
        F.count("*").alias("cross_incident_edges"), F.avg("title_score").alias("title_specificity"), F.avg((F.col("event_score") > 0).cast("int")).alias("event_corroboration")
    )
    marked = degree.join(members, "document_id").join(generic.select("document_id", F.lit(True).alias("g")), "document_id", "left")
    r = BRIDGE_RISK
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    risk = (
        r["titleless"] * flag(F.col("title").isNull()) + r["generic"] * flag(F.col("g")) + r["degree"] * F.log(1.0 + F.col("cross_incident_edges"))
        - r["specificity"] * F.col("title_specificity") - r["corroboration"] * F.col("event_corroboration")
    )
    return marked.withColumn("bridge_risk", risk).drop("g").orderBy(F.desc("bridge_risk"), "document_id")


def cross_edges(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row: edges between incidents, and how many rest on one channel, or on words or entities alone."""
    inc = members.select("document_id", "incident_id")
    cross = (
        pairs.where("gated > 0").join(inc.withColumnsRenamed({"document_id": "left", "incident_id": "inc_l"}), "left")
        .join(inc.withColumnsRenamed({"document_id": "right", "incident_id": "inc_r"}), "right").where("inc_l <> inc_r")
    )
    only = lambda one: (F.col(f"{one}_score") > 0) & (sum((F.col(f"{c}_score") for c in ("title", "event", "url", "entity") if c != one), F.lit(0.0)) == 0)
    return cross.agg(F.count("*").alias("cross"), F.count_if(F.col("evidence_channels") == 1).alias("single_channel"), F.count_if(only("url")).alias("url_only"), F.count_if(only("entity")).alias("entity_only"))


def pick_family(members: DataFrame, pattern: str) -> DataFrame:
    """The family with most documents whose titles match."""
    hits = members.where(F.col("title").rlike(pattern) & (F.col("family_id") >= 0))
    return hits.groupBy("family_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "family_id").limit(1)


def candidate_reach(documents: DataFrame, candidates: DataFrame, gold: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Per story: labelled documents, how many have a candidate partner among the story's
    documents, and how many of them lie in its largest component of candidates."""
    matched = documents.select("document_id", F.explode(F.array_compact(F.array(*[F.when(F.col("title").rlike(p), F.lit(s)) for s, p in patterns.items()]))).alias("story"))
    universe = matched.union(gold.select("document_id", "story")).distinct()
    own = universe.groupBy("document_id").agg(F.collect_set("story").alias("stories"))
    sides = candidates.select("left", "right").join(own.withColumnsRenamed({"document_id": "left", "stories": "a"}), "left").join(own.withColumnsRenamed({"document_id": "right", "stories": "b"}), "right")
    edges = sides.select(F.explode(F.array_intersect("a", "b")).alias("story"), "left", "right")
    partner = similarity.both_ways(edges, source="document_id", target="other").join(matched.withColumnRenamed("document_id", "other"), ["story", "other"], "left_semi").select("story", "document_id").distinct().withColumn("reached", F.lit(True))
    names = {s: i for i, s in enumerate(patterns)}
    # stories share documents: nodes are numbered per story, so that components don't mix
    base = lambda c: F.col(c) * len(names) + lookup(names, F.col("story"))
    comp = connected_components(edges.select(base("left").alias("left"), base("right").alias("right")))
    of = comp.select(F.floor(F.col("node") / len(names)).cast("long").alias("document_id"), F.element_at(F.array(*[F.lit(s) for s in names]), (F.col("node") % len(names) + 1).cast("int")).alias("story"), "component")
    largest = top_per_key(of.groupBy("story", "component").agg(F.count("*").alias("n")), ["story"], [F.desc("n"), "component"]).select("story", F.col("component").alias("main"))
    joined = gold.select("document_id", "story").join(partner, ["story", "document_id"], "left").join(of, ["story", "document_id"], "left").join(largest, "story", "left")
    return joined.groupBy("story").agg(F.count("*").alias("gold"), F.count("reached").alias("reached"), F.count_if(F.col("component") == F.col("main")).alias("in_main_component")).withColumn("reach", F.col("reached") / F.col("gold"))


def run_inspection(members: DataFrame, pattern: str, cluster: str = "incident_id") -> DataFrame:
    """Per cluster that holds a matching title: size, hits, purity, and its part of all hits."""
    rows = members.withColumn("hit", F.coalesce(F.col("title").rlike(pattern), F.lit(False)))
    total = rows.agg(F.count_if("hit").alias("all_hits"))
    per = rows.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.count("*").alias("size"), F.count_if("hit").alias("hits")).where("hits > 0")
    return per.join(total).withColumn("purity", F.col("hits") / F.col("size")).withColumn("recall", F.col("hits") / F.col("all_hits")).orderBy(F.desc("hits"), cluster)


def story_comparison(runs: Mapping[str, DataFrame], pages: DataFrame, patterns: Mapping[str, str] = BENCHMARK_PATTERNS) -> DataFrame:
    """(run, story, unit, ...): runs side by side, by addresses and by canonical articles:
    the best cluster, its part and purity, and what the five best hold together."""
    flags = F.array_compact(F.array(*[F.when(F.col("slug").rlike(p), F.lit(s)) for s, p in patterns.items()]))
    tagged = pages.select("MentionIdentifier", "canonical", F.explode(flags).alias("story"))
    out = None
    for run, members in runs.items():
        for unit, key in (("url", "MentionIdentifier"), ("canonical", "canonical")):
            every = tagged.groupBy("story").agg(F.count_distinct(key).alias("all_units"))
            held = pages.select("MentionIdentifier", "canonical").join(members, "canonical").select(key, "cluster").distinct()
            hits = tagged.select("story", key).distinct().join(held, key)
            per = hits.groupBy("story", "cluster").agg(F.count("*").alias("n"))
            best = top_per_key(per, ["story"], [F.desc("n"), "cluster"], 5, "r")
            five = hits.join(best.select("story", "cluster"), ["story", "cluster"], "left_semi").groupBy("story").agg(F.count_distinct(key).alias("in_five"))
            size = held.groupBy("cluster").agg(F.count("*").alias("cluster_size"))
            rows = every.join(best.where("r = 1").join(size, "cluster"), "story", "left").join(five, "story", "left").select(
                F.lit(run).alias("run"), "story", F.lit(unit).alias("unit"), "all_units", F.col("cluster").alias("best_cluster"), F.col("n").alias("best_matches"),
                (F.col("n") / F.col("all_units")).alias("best_fraction"), (F.col("n") / F.col("cluster_size")).alias("best_purity"), (F.col("in_five") / F.col("all_units")).alias("top5_fraction"),
            )
            out = rows if out is None else out.unionByName(rows)
    return out


def sweep(base: Any, grid: Mapping[str, Iterable], run: Callable[[Any], DataFrame]) -> DataFrame:
    """``run`` for every combination of a small grid of settings, results under the settings' names.

    Scores are computed once outside; what is repeated is the gate and the partition.
    """
    from dataclasses import replace

    out = None
    for values in product(*grid.values()):
        chosen = dict(zip(grid, values))
        rows = run(replace(base, **chosen)).withColumn("run", F.lit(", ".join(f"{k}={v}" for k, v in chosen.items())))
        out = rows if out is None else out.unionByName(rows)
    return out


def prepared(spark: SparkSession, path: str, settings: Any, build: Callable[[], Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables of an earlier run with the same settings; else they are built and written.
    Tables of other settings are refused rather than mixed."""
    want = json.dumps(asdict(settings) if is_dataclass(settings) else settings, sort_keys=True, default=str)
    try:
        found = [r["value"] for r in spark.read.text(f"{path}/settings").collect()]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = []
    if not found:
        names = []
        for name, df in build().items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            names.append(name)
        spark.createDataFrame([(want,), (json.dumps(names),)], "value string").coalesce(1).write.text(f"{path}/settings")
        found = [want, json.dumps(names)]
    if found[0] != want:
        raise ValueError(f"{path} holds tables of other settings: {found[0]}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in json.loads(found[1])}


def relabelled(membership: DataFrame, families: DataFrame) -> DataFrame:
    """Memberships with the families of another run of the family stage; unassigned stay -1."""
    return membership.drop("family_id").join(families.select("incident_id", "family_id"), "incident_id", "left").withColumn("family_id", F.coalesce("family_id", F.lit(-1)))


def incident_coverage(members: DataFrame, pairs: DataFrame, incident: int) -> DataFrame:
    """Documents of one incident by their score, with the number of edges inside it."""
    own = members.where(F.col("incident_id") == incident)
    ids = own.select("document_id")
    inside = pairs.where("gated > 0").join(ids.withColumnRenamed("document_id", "left"), "left", "left_semi").join(ids.withColumnRenamed("document_id", "right"), "right", "left_semi")
    degree = similarity.both_ways(inside.select("left", "right"), source="document_id", target="o").groupBy("document_id").agg(F.count("*").alias("edges"))
    return own.join(degree, "document_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0))).orderBy("assignment_score", "document_id")


