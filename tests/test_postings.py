"""Pairs by shared features without a row a pair, against the plain join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import postings, similarity
from newsloom.plans import catalogue, prototypes


def links(seed=3, nodes=120, wide=None, shift=0):
    rng = np.random.default_rng(seed)
    rows = {(int(n) * 3 + shift, int(f)) for n in range(nodes) for f in rng.choice(60, rng.integers(1, 7), p=np.arange(1, 61) / 1830)}
    rows |= {(n * 3 + shift, 7) for n in range(0, nodes, 2)}  # a feature of half the nodes
    rows |= {(n * 3 + shift, f) for n in (4, 5, 6) for f in (1, 2, 3)}
    return sorted(rows | {(n * 3 + shift, f) for n in (wide or ()) for f in range(60)})


@pytest.mark.parametrize("wide, shift, block", [(None, 0, 1024), ((8, 9), 0, 16), (None, -(1 << 40), 7)])
def test_nearest_cosine(spark, wide, shift, block):
    """Copies, ties, nodes of many features, features of many nodes in blocks, any ids."""
    rows = spark.createDataFrame(links(wide=wide, shift=shift), "node long, feature long").cache()
    want = similarity.nearest(similarity.cosine_pairs(similarity.tfidf(rows, 130)), 4, 9).collect()
    weights = postings.by_node(similarity.tfidf(rows, 130, keep_df=True))
    got = postings.nearest_cosine(weights, 4, block=block)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    key = lambda r: (r["node"], r["rank"], r["neighbor"], round(r["score"], 8))
    assert sorted(map(key, got.collect())) == sorted(map(key, want))


def test_topk_query_makes_no_pairs(spark, sf_dir):
    plan = catalogue.QUERIES["tfidf_cosine_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("block, channels, floor", [(1024, 2, 0.6), (9, 2, 0.3), (1024, 1, 0.6)])
def test_article_totals(spark, block, channels, floor, monkeypatch):
    """The sums over all pairs are those of the pairs' table, and no guard refuses them."""
    whole = postings.mean_totals
    monkeypatch.setattr(postings, "mean_totals", lambda w, c, f: whole(w, c, f, block))
    nodes = spark.range(0, 390, 3).select(F.col("id").alias("node"))
    one, two = (spark.createDataFrame(x, "node long, feature long").cache() for x in (links(), links(5, nodes=70, wide=(8, 9))))
    s = prototypes.ArticleSettings(neighbours=1 << 30, cap=1 << 30, min_channels=channels, floor=floor)
    want = prototypes.article_pairs(nodes, {"part": one, "owner": two}, s).groupBy("left").agg(F.count("*").alias("pairs"), F.sum("combined").alias("combined"), F.sum("gated").alias("gated"))
    got = prototypes.article_totals(nodes, {"part": one, "owner": two}, prototypes.ArticleSettings(most_contributions=1, min_channels=channels, floor=floor))
    key = lambda r: (r["left"], r["pairs"], round(r["combined"], 7), round(r["gated"], 7))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_candidates_are_written_step_by_step(spark, sf_dir, monkeypatch):
    """No two steps' shuffles meet: pairs by features, by items and their union are tables, and what is no longer read goes."""
    written, dropped = [], []
    write, drop = catalogue.materialize, catalogue.release
    monkeypatch.setattr(catalogue, "materialize", lambda df, tag: written.append(tag) or write(df, tag))
    monkeypatch.setattr(catalogue, "release", lambda df: dropped.append(df.columns) or drop(df))
    plan = catalogue.QUERIES["candidate_union"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert written == ["weights", "near", "second", "proposed"] and dropped == [["left", "right"], ["node", "items"]]
    assert "lineitem" not in plan and "MapInArrow" not in plan and "Aggregate" not in plan


def test_scores_are_written_channel_by_channel(spark, sf_dir, monkeypatch):
    written = []
    write = catalogue.materialize
    monkeypatch.setattr(catalogue, "materialize", lambda df, tag: written.append(tag) or write(df, tag))
    plan = catalogue.QUERIES["pair_scores_gate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert written == ["weights", "near", "second", "proposed", "candidates", "scores", "weights"] and "lineitem" not in plan


def test_written_tables_leave_no_shuffle_files(spark):
    from newsloom.plans.cutpoint import materialize

    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    done = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert done.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
