import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from newsloom.operators import attention, evaluation, families, filters, partition, ranking, responses, similarity, vectors
from newsloom.operators.components import connected_components
from newsloom.plans import catalogue


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_onset(spark):
    rows = [(1, "o0", "2023-02-06 00:10:00")] + [(1, f"o{i}", f"2023-02-06 05:{i:02d}:00") for i in range(1, 21)] + [(2, "a", "2023-02-06 01:00:00"), (2, "b", "2023-02-06 02:00:00")]
    docs = frame(spark, rows, "k long, source_domain string, t string").withColumn("observed_time", F.col("t").cast("timestamp"))
    got = attention.onset(docs, ["k"]).collect()
    assert len(got) == 1 and got[0]["onset"].hour == 5


def test_higher_quantile(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(v)) for k in range(20) for v in rng.integers(0, 9, size=k + 1)]
    got = {r["k"]: r["q"] for r in attention.higher_quantile(frame(spark, rows, "k long, v long"), ["k"], "v", 0.1, "q").collect()}
    for k in range(20):
        assert got[k] == np.quantile([v for kk, v in rows if kk == k], 0.1, method="higher")


def test_coherence_types_and_top_lists(spark):
    members = frame(spark, [(1, 1, ["x", "y"], ["o"]), (1, 2, ["x"], None), (1, 3, None, ["p", "q"]), (1, 4, None, None), (2, 5, None, None)], "cluster long, document_id long, persons array<string>, organizations array<string>")
    got = {r[0]: r[1] for r in attention.entity_coherence(members).collect()}
    assert got == {1: 0.75, 2: 0.0}  # x, then o and p of the ties
    themed = frame(spark, [(1, i, ["PROTEST", "ELECTION_X"] if i < 2 else ["WILDFIRE_A"]) for i in range(4)], "cluster long, document_id long, themes array<string>")
    links = frame(spark, [(1, 0, "14"), (1, 1, "18"), (1, 2, "18"), (1, 3, "01")], "cluster long, document_id long, EventRootCode string")
    r = attention.event_types(themed, links).first()
    assert r["event_types"] == ["armed_conflict", "election", "fire"] and r["event_type_shares"] == [0.5, 0.5, 0.5]
    ties = frame(spark, [(1, [c for c in "lkjihgfedcba"])], "cluster long, v array<string>")
    assert ranking.top_list(ties, "cluster", "v", 3).first()["v"] == ["a", "b", "c"]


def test_dense_ids(spark):
    rows = [(i % 7, f"u{i:04d}") for i in range(500)] + [(None, "z")]
    got = ranking.dense_ids(frame(spark, rows, "t long, u string"), [F.col("t").asc_nulls_first(), "u"], "id").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["t"], r["u"]) for r in sorted(got, key=lambda r: r["id"])] == want and sorted(r["id"] for r in got) == list(range(501))


def test_filters(spark):
    titles = frame(spark, [(i, "h", "Live") for i in range(10)] + [(20 + i, "h", None) for i in range(12)] + [(40, "h", "Other")], "document_id long, domain string, title string")
    assert {r[0] for r in filters.boilerplate_titles(titles).select("document_id").collect()} == set(range(10))
    rows = [(f, f"n{i}", f"2023-02-{1 + (i % 5 if f == 'police' else 0):02d}") for f in ("police", "quake") for i in range(100)]
    got = {r["feature"]: r["steady"] for r in filters.bursty(frame(spark, rows, "feature string, node string, day string"), "feature", "node", F.col("day").cast("date")).collect()}
    assert got == {"police": True, "quake": False}
    events = [(i, 1, f"2023-02-{1 + 3 * (i % 2):02d}") for i in range(6)] + [(i, 2, "2023-02-01") for i in range(6)] + [(i, 3, f"2023-02-{1 + i:02d}") for i in range(3)]
    links = frame(spark, events, "d long, e long, t string")
    assert [r[0] for r in filters.recurring_events(links, "d", "e", "t", 5, 2).collect()] == [1]
    hosts = frame(spark, [("h", "cms", i) for i in range(20)] + [("h", "rare", 1), ("", "cms", 99)], "host string, feature string, node long")
    assert [(r["host"], r["feature"]) for r in filters.host_boilerplate(hosts, "host", "feature", "node").collect()] == [("h", "cms")]
    assert [r[0] for r in filters.frequent_features(hosts, "node", "feature", 20, 0.5).collect()] == ["cms"]


def dense(rows, n):
    features = sorted({f for _, f in rows})
    m = np.zeros((n, len(features)))
    for i, f in rows:
        m[i, features.index(f)] = 1
    return m * (np.log((n + 1) / (m.sum(axis=0) + 1)) + 1)


def test_tfidf_and_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = sorted({(int(i), f"f{j}") for i in range(25) for j in rng.integers(0, 15, size=4)})
    d = frame(spark, rows, "node long, feature string")
    w = dense(rows, 30)
    size = np.linalg.norm(w, axis=1, keepdims=True)
    w = w / np.where(size > 0, size, 1)
    cos = w @ w.T
    pairs = similarity.cosine_pairs(similarity.tfidf(d, 30)).collect()
    assert {(r["left"], r["right"]) for r in pairs} == {(i, j) for i, j in itertools.combinations(range(30), 2) if cos[i, j] > 0}
    assert all(abs(r["score"] - cos[r["left"], r["right"]]) < 1e-12 for r in pairs)
    near = similarity.nearest(similarity.cosine_pairs(similarity.tfidf(d, 30)), 3, 9).collect()
    for i in range(25):
        want = sorted(((-round(cos[i, j], 9), j) for j in range(30) if j != i and cos[i, j] > 0))[:3]
        assert [r["neighbor"] for r in sorted(near, key=lambda r: r["rank"]) if r["node"] == i] == [j for _, j in want]
    with pytest.raises(ValueError):
        similarity.guard(d, 3)
    ones = frame(spark, [(i, "x") for i in range(4)], "node long, feature string")
    ties = similarity.nearest(similarity.cosine_pairs(similarity.tfidf(ones, 4)), 1, 9).collect()
    assert sorted((r["node"], r["neighbor"]) for r in ties) == [(0, 1), (1, 0), (2, 0), (3, 0)]
    scored = similarity.channel_scores(frame(spark, [(0, 1), (0, 29)], "left long, right long"), similarity.tfidf(d, 30), "url").orderBy("right").collect()
    assert abs(scored[0]["url_score"] - cos[0, 1]) < 1e-12 and scored[1]["url_score"] == 0 and scored[1]["url_min_features"] == 0 and not scored[1]["url_both"]


def test_gate(spark):
    # title, both, event, event features, url, url features, combined
    rows = [
        (0, 1, 0.5, True, 0.0, 5, 0.0, 5, 0.5, True), (0, 2, 0.1, True, 0.9, 5, 0.0, 5, 0.5, True), (0, 3, 0.6, True, 0.0, 5, 0.0, 5, 0.6, True), (0, 4, 0.0, False, 0.9, 3, 0.0, 0, 0.4, True), (0, 5, 0.0, False, 0.9, 1, 0.0, 0, 0.4, True),
        (0, 6, 0.58, True, 0.0, 5, 0.0, 5, 0.7, False), (0, 7, 0.45, True, 0.1, 5, 0.0, 5, 0.3, False),
    ]
    schema = "left long, right long, title_score double, title_both boolean, event_score double, event_min_features int, url_score double, url_min_features int, combined double, same_language boolean"
    got = [r["gated"] for r in similarity.apply_gate(frame(spark, rows, schema), ["title", "event", "url"]).orderBy("right").collect()]
    assert got == [0, 0, 0.6, 0.4, 0, 0, 0.3]


def test_candidate_union_and_window(spark):
    a = frame(spark, [(0, 1), (1, 0), (2, 2)], "left long, right long")
    b = frame(spark, [(1, 2), (0, 1)], "left long, right long")
    got = {(r["left"], r["right"]): (r["from_a"], r["from_b"]) for r in similarity.candidate_union({"a": a, "b": b}).collect()}
    assert got == {(0, 1): (True, True), (1, 2): (False, True)}
    nodes = frame(spark, [(0, "2023-02-06 00:00:00"), (1, "2023-02-08 00:00:00"), (2, "2023-02-08 00:00:01")], "node long, first_seen string")
    pairs = frame(spark, [(0, 1), (0, 2)], "left long, right long")
    assert [(r["right"], r["delta_hours"]) for r in similarity.within_hours(pairs, nodes).collect()] == [(1, 48.0)]


def test_projection_and_fingerprints(spark):
    links = frame(spark, [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 3)], "d long, e long")
    got = similarity.projection(links, "d", "e", 1).collect()
    assert {(r["left"], r["right"]): (r["shared"], round(r["jaccard"], 6)) for r in got} == {(1, 2): (2, 0.666667), (1, 3): (1, 0.333333)}
    wide = spark.range(300).select(F.col("id").alias("d"), F.explode(F.array(F.lit(1), F.lit(2))).alias("e"))
    assert similarity.projection(wide, "d", "e").first()["shared"] == 300
    sets = frame(spark, [(1, "a", 1), (1, "b", 2), (2, "b", 2), (2, "a", 1), (3, "a", 1), (4, "a", 1), (5, "a", None), (5, "b", 2), (6, "a", None), (6, "b", 2)], "d long, x string, y long")
    assert {r[0]: r[1] for r in similarity.wire_fingerprints(sets, "d", ["x", "y"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 6)) + np.repeat([[3, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0]], [40, 20], axis=0)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lang = ["a"] * 40 + ["b"] * 20
    rows = frame(spark, [(i, lang[i], v[i].tolist()) for i in range(60)], "id long, lang string, vector array<double>")
    done = {r["id"]: np.array(r["vector"]) for r in vectors.center(rows, "lang", least=30).collect()}
    moved = v[:40] - v[:40].mean(axis=0)
    moved /= np.linalg.norm(moved, axis=1, keepdims=True)
    assert np.allclose([done[i] for i in range(40)], moved) and np.allclose([done[i] for i in range(40, 60)], v[40:])
    got = {(r["group_left"], r["group_right"]): r["quantile"] for r in vectors.pair_background(rows, "lang").collect()}
    cos = v @ v.T
    off = cos[:40, :40][~np.eye(40, dtype=bool)]
    assert abs(got["a", "a"] - np.clip(np.quantile(off, 0.9), 0, 0.99)) < 1e-9 and abs(got["a", "b"] - np.clip(np.quantile(cos[:40, 40:], 0.9), 0, 0.99)) < 1e-9
    sampled = {(r["group_left"], r["group_right"]): r["quantile"] for r in vectors.background(rows, "lang", least=10).collect()}
    assert all(abs(sampled[k] - got[k]) < 0.1 for k in got)
    near = vectors.knn(rows, 4, 0.2, block=16).collect()
    for i in range(60):
        s = cos[i].copy()
        s[i] = -1
        want = [j for j in np.lexsort((np.arange(60), -s))[:4] if s[j] >= 0.2]
        assert [r["neighbor"] for r in sorted(near, key=lambda r: r["rank"]) if r["node"] == i] == want
    every = {(r["left"], r["right"]): r["cosine"] for r in vectors.pairs_above(rows, 0.2, block=16).collect()}
    assert set(every) == {(i, j) for i, j in itertools.combinations(range(60), 2) if cos[i, j] >= 0.2} and all(abs(x - cos[k]) < 1e-9 for k, x in every.items())
    titled = rows.select(F.lit(1).alias("cluster"), F.col("id").alias("document_id"), "vector", F.concat(F.lit("t"), "id").alias("title")).where("id < 40")
    r = vectors.title_coherence(titled).first()
    c = v[:40].mean(axis=0)
    sims = v[:40] @ (c / np.linalg.norm(c))
    assert abs(r["title_coherence"] - sims.mean()) < 1e-9 and r["title"] == f"t{np.argmax(sims)}"


def test_background_over_all_pairs(spark, sf_dir):
    """Every pair of labels has its quantile over all pairs of rows, in blocks of any size."""
    plain = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    v, label = np.array([r["embedding"] for r in plain], dtype=float), np.array([r["label"] for r in plain])
    cos, apart = v @ v.T, ~np.eye(len(v), dtype=bool)
    want = {}
    for x, y in itertools.combinations_with_replacement(sorted(set(label.tolist())), 2):
        c = cos[np.ix_(label == x, label == y)][apart[np.ix_(label == x, label == y)]]
        if len(c):
            want[x, y] = (len(c), float(np.clip(np.quantile(c, 0.9), 0, 0.99)))
    rows = frame(spark, [(r["vec_id"], r["label"], [float(x) for x in r["embedding"]]) for r in plain], "id long, label long, vector array<double>")
    for got in (catalogue.QUERIES["background_quantile"](spark, sf_dir), vectors.pair_background(rows, "label", block=17)):
        found = {(r["group_left"], r["group_right"]): (r["pairs"], r["quantile"]) for r in got.collect()}
        assert set(found) == set(want) and all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-5 for k in want)


def test_background_holds_no_cosines(spark):
    """The quantile is exact without an aggregate that keeps every cosine, also with many copies and a row alone in its group."""
    rng = np.random.default_rng(4)
    v = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 40, axis=0), rng.normal(size=(61, 8)), np.zeros((3, 8))])
    label = np.array([i % 3 for i in range(len(v) - 1)] + [9])
    rows = frame(spark, [(i, f"L{label[i]}", v[i].tolist()) for i in range(len(v))], "id long, lang string, vector array<double>")
    got = vectors.pair_background(rows, "lang", block=30, bins=64)
    assert "percentile" not in got._jdf.queryExecution().toString()
    cos, apart, want = v @ v.T, ~np.eye(len(v), dtype=bool), {}
    for x, y in itertools.combinations_with_replacement((0, 1, 2, 9), 2):
        c = cos[np.ix_(label == x, label == y)][apart[np.ix_(label == x, label == y)]]
        if len(c):
            want[f"L{x}", f"L{y}"] = (len(c), float(np.clip(np.quantile(c, 0.9), 0, 0.99)))
    found = {(r["group_left"], r["group_right"]): (r["pairs"], r["quantile"]) for r in got.collect()}
    assert set(found) == set(want) and all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-9 for k in want)


def test_knn_is_exact_at_every_size(spark, monkeypatch):
    """The registered queries' neighbours never come from cells, however many rows there are."""
    monkeypatch.setattr(vectors, "cell_neighbours", lambda *a, **k: pytest.fail("approximate"))
    count = DataFrame.count
    monkeypatch.setattr(DataFrame, "count", lambda self: count(self) * 10_000)  # many small blocks, as a large table has
    v = np.random.default_rng(9).normal(size=(40, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = frame(spark, [(i, v[i].tolist()) for i in range(40)], "id long, vector array<double>")
    got = {}
    for r in vectors.knn(rows, 3, -1.0).collect():
        got.setdefault(r["node"], {})[r["rank"]] = r["neighbor"]
    for i in range(40):
        s = v @ v[i]
        s[i] = -9
        assert [got[i][k] for k in (1, 2, 3)] == np.argsort(-s, kind="stable")[:3].tolist()


def test_cells(spark):
    """Above the exact limit most true neighbours are still found, in blocks of any size."""
    rng = np.random.default_rng(8)
    v = np.repeat(rng.normal(size=(40, 16)), 25, axis=0) + 0.35 * rng.normal(size=(1000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = frame(spark, [(i, v[i].tolist()) for i in range(1000)], "id long, vector array<double>")
    cos = v @ v.T - 2 * np.eye(1000)
    want = {(i, int(j)) for i in range(1000) for j in np.argsort(-cos[i])[:5] if cos[i, j] >= 0.35}
    got = {(r["node"], r["neighbor"]) for r in vectors.knn(rows, 5, 0.35, block=20, exact_below=100).collect()}
    assert len(got & want) >= 0.95 * len(want) and all(cos[k] >= 0.35 for k in got)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, size=(250, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2100)]
    got = {r["node"]: r["component"] for r in connected_components(frame(spark, edges, "left long, right long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(frame(spark, [], "left long, right long")).count() == 0


def objective(edges, label, gamma):
    sizes = {}
    for c in label.values():
        sizes[c] = sizes.get(c, 0) + 1
    return sum(w for a, b, w in edges if label[a] == label[b]) - gamma * sum(n * (n - 1) / 2 for n in sizes.values())


def splits(nodes):
    if not nodes:
        yield []
        return
    for rest in splits(nodes[1:]):
        yield [[nodes[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [nodes[0], *rest[i]], *rest[i + 1 :]]


@pytest.mark.parametrize("seed", range(6))
def test_cpm_is_near_the_best(seed):
    rng = np.random.default_rng(seed)
    edges = [(a, b, float(rng.uniform(0.3, 1))) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.45]
    nodes = sorted({x for e in edges for x in e[:2]})
    found = partition.solve(edges, 0.4)
    best = max(objective(edges, {x: i for i, g in enumerate(s) for x in g}, 0.4) for s in splits(nodes))
    assert objective(edges, found, 0.4) >= best - 0.05 * abs(best) - 1e-9
    assert partition.solve(list(reversed(edges)), 0.4) == found
    for c in set(found.values()):
        group = {x for x in nodes if found[x] == c}
        reached, todo = {c}, [c]
        while todo:
            x = todo.pop()
            for a, b, _ in edges:
                for p, q in ((a, b), (b, a)):
                    if p == x and q in group and q not in reached:
                        reached.add(q)
                        todo.append(q)
        assert reached == group


def test_communities(spark):
    clique = lambda xs: [(a, b, 0.9) for a, b in itertools.combinations(xs, 2)]
    edges = clique(range(5)) + clique(range(10, 15)) + [(4, 10, 0.3)] + clique(range(20, 23))
    table = frame(spark, edges, "left long, right long, gated double")
    want = {x: 0 for x in range(5)} | {x: 10 for x in range(10, 15)} | {x: 20 for x in range(20, 23)}
    for kwargs in ({}, {"most_edges": 3}):
        assert {r["node"]: r["community"] for r in partition.communities(table, 0.3, **kwargs).collect()} == want
        assert {r["node"]: r["community"] for r in partition.communities(table, 1.0, modularity=True, **kwargs).collect()} == want
    labels = partition.communities(table, 0.3)
    assert abs(partition.quality(table.withColumnRenamed("gated", "weight"), labels, 0.3).first()[0] - objective(edges, want, 0.3)) < 1e-9
    docs = frame(spark, [(i,) for i in range(30)], "document_id long")
    inc = {r[0]: r[1] for r in partition.incidents(docs, labels).collect()}
    assert inc[0] == 0 and inc[12] == 1 and inc[22] == 2 and inc[29] == -1


def test_memberships_and_evidence(spark):
    edges = frame(spark, [(0, 1, 0.6), (1, 2, 0.4), (2, 3, 0.5), (1, 4, 0.2)], "left long, right long, gated double")
    inc = frame(spark, [(0, 0), (1, 0), (2, 1), (3, 1), (4, -1), (5, -1)], "document_id long, incident_id long")
    got = {(r["document_id"], r["incident_id"]): (round(r["assignment_score"], 6), r["is_primary"]) for r in partition.memberships(edges, inc).collect()}
    assert got == {(0, 0): (1.0, True), (1, 0): (0.5, True), (1, 1): (0.333333, False), (2, 1): (0.555556, True), (2, 0): (0.444444, False), (3, 1): (1.0, True), (4, -1): (0.0, True), (4, 0): (1.0, False), (5, -1): (0.0, True)}
    of = inc.withColumn("is_primary", F.lit(True))
    ev = [(r["document_id"], r["neighbor_document_id"], r["same_incident"], r["rank"]) for r in partition.evidence(edges, of, ["gated", "url_score"]).collect()]
    assert sorted(ev) == [(0, 1, True, 1), (1, 0, True, 1), (1, 2, False, 1), (2, 1, False, 1), (2, 3, True, 1), (3, 2, True, 1), (4, 1, False, 1)]


def test_families(spark):
    place = "array<struct<geo_type:long,name:string>>"
    unit = lambda *x: (np.array(x, dtype=float) / np.linalg.norm(x)).tolist()
    rows = [
        (0, 0, unit(1, 0.1, 0), "2023-02-06 00:00:00", ["p"], [(4, "Izmir")]), (1, 0, unit(1, 0, 0.1), "2023-02-06 01:00:00", ["p"], None), (2, 1, unit(1, 0.7, 0), "2023-02-07 00:00:00", ["q"], [(4, "Izmir")]), (3, 1, unit(1, 0.7, 0.1), "2023-02-07 00:00:00", ["q"], None),
        (4, 2, unit(0, 0, 1), "2023-02-06 00:00:00", ["p"], None), (5, 3, unit(1, 0, 0), "2023-02-12 00:00:00", ["p"], None),
    ]
    members = frame(spark, [(*r, "en", True, None, 1) for r in rows], f"document_id long, incident_id long, vector array<double>, first_seen string, persons array<string>, locations {place}, language string, has_gkg boolean, organizations array<string>, x int")
    members = members.withColumn("first_seen", F.col("first_seen").cast("timestamp"))
    background = frame(spark, [("en", "en", 0.2)], "group_left string, group_right string, quantile double")
    pairs = lambda **k: sorted((r["left"], r["right"]) for r in families.title_links(members, background, **k).collect())
    assert pairs(strong=0.99) == [] and pairs(strong=0.99, channels=("geo",)) == [(0, 1)] and pairs(strong=0.5) == [(0, 1)] and (0, 3) in pairs(hours=24 * 9)
    assert sorted((r["left"], r["right"]) for r in families.entity_links(members).collect()) == [(0, 2), (0, 3), (2, 3)]
    edges = frame(spark, [(0, 1, 0.9)], "left long, right long, weight double")
    assert {r[0]: r[1] for r in families.link_families(members, edges).collect()} == {0: 0, 1: 0, 2: 1, 3: 2}
    events = frame(spark, [(1, 7, "b", "lb", 3, 5), (2, 7, "a", "la", 4, 5), (3, 8, "c", "lc", 1, 1)], "macro_event_id long, family_id long, title string, label string, raw_documents long, effective_reports long")
    r = families.rollup(events.withColumn("start_time", F.lit(1)).withColumn("end_time", F.lit(2))).orderBy("family_id").collect()
    assert (r[0]["title"], r[0]["macro_event_ids"], r[0]["raw_documents"], r[0]["incident_count"]) == ("b", [1, 2], 7, 2)


def test_wilson_and_bootstrap(spark):
    r = frame(spark, [(5, 10), (0, 0), (10, 10)], "k long, n long").select(*responses.wilson(F.col("k"), F.col("n"))).collect()
    assert [round(x, 4) for x in r[0]] == [0.2366, 0.7634] and tuple(r[1]) == (0.0, 0.0) and abs(r[2][1] - 1.0) < 1e-12
    values = np.random.default_rng(0).normal(size=40)
    rows = frame(spark, [(1, float(x)) for x in values] + [(2, 3.5), (3, None)], "g long, v double")
    got = {x["g"]: (x["latency_ci_low"], x["latency_ci_high"]) for x in responses.bootstrap_median(rows, ["g"], "v").collect()}
    draws = np.random.default_rng(2026).integers(0, 40, size=(1000, 40))
    assert got[1] == tuple(np.percentile(np.median(np.sort(values)[draws], axis=1), [2.5, 97.5])) and got[2] == (3.5, 3.5) and 3 not in got
    assert responses.median_interval(values[::-1]) == got[1]


def test_evaluation(spark):
    gold, pred = [0, 0, 0, 1, 1, 2], [5, 5, 6, 6, 7, 7]
    rows = frame(spark, [(g, p) for g, p in zip(gold, pred)], "gold long, pred long")
    n = len(gold)
    same = lambda x, i: {j for j in range(n) if x[j] == x[i]}
    p = np.mean([len(same(gold, i) & same(pred, i)) / len(same(pred, i)) for i in range(n)])
    r = np.mean([len(same(gold, i) & same(pred, i)) / len(same(gold, i)) for i in range(n)])
    got = evaluation.b_cubed(rows).first()
    assert abs(got["precision"] - p) < 1e-12 and abs(got["recall"] - r) < 1e-12
    pairs = lambda x: {(i, j) for i, j in itertools.combinations(range(n), 2) if x[i] == x[j]}
    got = evaluation.pairwise(rows).first()
    assert abs(got["precision"] - len(pairs(gold) & pairs(pred)) / len(pairs(pred))) < 1e-12 and abs(got["recall"] - len(pairs(gold) & pairs(pred)) / len(pairs(gold))) < 1e-12
    for shape in ((3, 3), (2, 4), (5, 3)):
        gain = np.random.default_rng(sum(shape)).random(shape)
        best = max(sum(gain[i, j] for i, j in zip(a, b)) for k in [min(shape)] for a in itertools.combinations(range(shape[0]), k) for b in itertools.permutations(range(shape[1]), k))
        assert abs(sum(gain[i, j] for i, j in evaluation.assignment(gain)) - best) < 1e-9
    assert evaluation.ceaf_e(frame(spark, [(1, 9), (1, 9), (2, 8)], "gold long, pred long"))["f1"] == 1.0
    hood = frame(spark, [("h", True, 1, 10), ("h", True, 1, 11), ("h", True, -1, 12), ("h", False, 1, 13)], "neighborhood string, gold_story boolean, family_id long, document_id long")
    x = evaluation.neighbourhoods(hood).first()
    assert (x["documents"], x["unassigned"], x["main_family"], round(x["recall"], 3), round(x["purity"], 3)) == (3, 1, 1, 0.667, 0.667)
    m = frame(spark, [("a", 0.5, 0.5, 0.5, 0.5, 0.1), ("b", 0.9, 0.9, 0.9, 0.9, 0.2)], "run string, pair_fam_p double, pair_fam_f1 double, b3_fam_f1 double, pair_inc_f1 double, unassigned double")
    assert [r["run"] for r in evaluation.selection(m).collect()] == ["a", "b"]
    h = frame(spark, [("related", True, "a", "b", 0.4), ("same_event", True, "a", "a", 0.9)], "l string, s boolean, x string, y string, g double").select(evaluation.hardness(*[F.col(c) for c in "lsxyg"])).collect()
    assert [r[0] for r in h] == [7.0, 0.0]
