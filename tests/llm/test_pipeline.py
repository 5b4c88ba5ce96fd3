from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm.common import materialize
from tests.llm import brute
from tests.llm.test_operators import check_packing


def test_stages(spark, sf_dir):
    """Every stage against brute force on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    kept = {}
    for (name, stage), n in zip(corpus_pipeline.STAGES, (7, 6, 8, 10, 5)):
        docs = materialize(stage(spark, docs, sf_dir), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
            after = sorted(tuple(r) for r in docs.select("doc_id", "text", "source").collect())
            if n == 7:
                assert after == sorted((i, rest, s) for (i, _, s), (ok, _, rest) in zip(before, brute.quality(before)) if ok)
            elif n == 6:
                want = brute.dedup_lines([(i, t) for i, t, _ in before])
                assert after == sorted((i, want[i][0], s) for i, _, s in before)
            elif n == 8:
                want = brute.similar_groups([(i, t) for i, t, _ in before])
                assert set(r for r in before if want[r[0]] == r[0]) <= set(after) <= set(before)
                assert len(after) <= 1.01 * len(set(want.values()))
            else:
                counts = {}
                for r in after:
                    counts[r] = counts.get(r, 0) + 1
                assert set(counts) <= set(before) and max(counts.values()) <= 3
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
            before = after
    check_packing(docs.collect(), [(i, t) for i, t, _ in before], 2048)
    assert kept["quality"].count() > 100


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
