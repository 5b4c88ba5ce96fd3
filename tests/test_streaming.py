import os

from pyspark.sql import functions as F

from newsloom.functions.fixed import MENTION_COLUMNS
from newsloom.plans.ingest import typed_mentions
from newsloom.sources import raw, sinks
from newsloom.streaming import news
from tests import world


def rows(minute, event, domain):
    return world.row(MENTION_COLUMNS, GlobalEventID=event, EventTimeDate="20230206000000", MentionTimeDate=f"2023020600{minute:02d}00", MentionType=1, MentionSourceName=domain, MentionIdentifier=f"http://{domain}/a-{event}?ref=1", Confidence=50)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "20230206000000.mentions.CSV").write_text("\n".join([rows(0, 1, "a.com"), rows(1, 1, "a.com"), rows(2, 1, "b.com"), rows(3, 1, "c.com"), rows(4, 2, "a.com"), "bad\trow"]) + "\n")
    stream = news.mention_stream(spark, str(src))
    assert len(run(stream, "typed")) == 5
    batch = typed_mentions(raw.read_raw(spark, [f"{src}/20230206000000.mentions.CSV"], MENTION_COLUMNS)[0])
    assert sorted(spark.table("typed").collect(), key=str) == sorted(batch.select(*stream.columns).collect(), key=str)
    assert len(run(news.first_arrivals(news.mention_stream(spark, str(src))), "firsts")) == 4
    hourly = run(news.hourly_counts(news.mention_stream(spark, str(src)), ["GlobalEventID"], "MentionTimeDate", "domain"), "hourly", "update")
    assert {r["GlobalEventID"]: (r["raw_documents"], r["unique_domains"]) for r in hourly} == {1: (4, 3), 2: (1, 1)}
    third = run(news.third_outlets(news.mention_stream(spark, str(src)), "GlobalEventID", "MentionTimeDate", "domain"), "third")
    assert [(r["key"], r["outlet"]) for r in third] == [("1", "c.com")]


def test_third_outlet_state_expires(spark, tmp_path):
    """One file a trigger: the first group is forgotten before its third outlet comes a month later."""
    src = tmp_path / "in"
    src.mkdir()
    day = lambda n, event, domain: rows(0, event, domain).replace("20230206000000\t", f"{n}000000\t")
    for i, (n, event, domain) in enumerate([("20230206", 1, "a.com"), ("20230206", 1, "b.com"), ("20230207", 2, "a.com"), ("20230320", 2, "b.com"), ("20230321", 3, "a.com"), ("20230322", 1, "c.com"), ("20230323", 3, "b.com"), ("20230324", 3, "c.com")]):
        name = src / f"{i}.mentions.CSV"
        name.write_text(day(n, event, domain) + "\n")
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = news.mention_stream(spark, str(src), 1)
    third = run(news.third_outlets(stream, "GlobalEventID", "MentionTimeDate", "domain", keep="10 days"), "expired")
    assert [(r["key"], r["outlet"]) for r in third] == [("3", "c.com")]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "id long, title string")
    out = f"{tmp_path}/shards"
    sinks.write_shards(d, out, "id", 4, lambda x: x.withColumn("n", F.length("title")))
    sinks.write_shards(d, out, "id", 4, lambda x: x.withColumn("n", F.length("title")))
    assert spark.read.parquet(out).count() == 50 and sorted(sinks.existing_shards(spark, out)) == [0, 1, 2, 3]
    sinks.write_csv(d, f"{tmp_path}/c")
    sinks.write_json_lines(d, f"{tmp_path}/j")
    assert raw.json_lines(spark, f"{tmp_path}/j", "id long, title string").count() == 50 and sinks.reduction(12, 3) == 4
