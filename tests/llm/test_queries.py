"""Every registered query of the corpus operators on the smallest tables: against its SQL, or against brute force."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from newsloom.llm import queries
from tests.llm import brute
from tests.llm.test_operators import base_spans, check_packing

TABLES = "documents embeddings pages labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(queries.SQL))
def test_against_sql(spark, sf_dir, con, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def documents(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


def test_ann(spark, sf_dir, con):
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    got = {}
    for r in queries.op1_ann(spark, sf_dir).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    v = {i: np.array(x, dtype=float) for i, x in rows}
    hits = asked = 0
    for q in (i for i in v if i % 50 == 0):
        score = {i: float(v[q] @ x / (np.linalg.norm(v[q]) * np.linalg.norm(x))) for i, x in v.items() if i != q}
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        hits, asked = hits + len(set(best) & set(got[q])), asked + len(best)
        assert len(got[q]) == len(best) and all(abs(s - score[i]) < 1e-12 for i, s in got[q].items())
    assert hits >= 0.9 * asked


def test_secrets(spark, sf_dir, con):
    kinds = ("assign", "access", "hex")
    got = {r["doc_id"]: r for r in queries.op3_secrets(spark, sf_dir).collect()}
    assert len(got) == len(documents(con))
    for i, t in documents(con):
        spans = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert [got[i][f"n_{kinds[k]}"] for k in range(3)] == [sum(k == x for _, x, _ in spans) for k in range(3)]
        assert {f"{kinds[k]}:{a}:{b}" for a, k, b in spans} <= set(got[i]["spans"].split(","))


def test_shards(spark, sf_dir, con):
    rows = queries.op4_shards(spark, sf_dir).collect()
    want = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in documents(con)}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want and {r["law"] for r in rows} == {"bytes"}
    for k in range(24):
        part = [r for r in rows if r["shard"] == k]
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - sum(s for s, _ in want.values()) / 24) <= max(s for s, _ in want.values())


def test_packing(spark, sf_dir, con):
    rows = queries.op5_packing(spark, sf_dir).collect()
    n = check_packing(rows, documents(con), 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1


def test_simhash(spark, sf_dir, con):
    docs = documents(con)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, sf_dir).collect()}
    groups = brute.simhash_groups(docs)
    assert got == {i: (f"{brute.fingerprint(t):016x}", groups[i]) for i, t in docs}


def test_chat_probe(spark, sf_dir):
    row = queries.op9_chat(spark, sf_dir).where("conv_id = -1").first()
    assert (row["n_turns"], row["loss_chars"]) == (2, len(queries.PROBE))
    assert row["loss_sha256"] == hashlib.sha256(queries.PROBE.encode()).hexdigest() and not re.search(r"</s>", row["turns_sha256"])
