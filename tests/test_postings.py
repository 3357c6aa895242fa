"""The stored inverted index and the release store."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovelight.operators import postings as P
from trovelight.operators import search as S
from trovelight.plans import search_queries
from trovelight.sources.store import Folder, ReleaseStore, fingerprint

FIELDS = ["title", "content"]


def corpus(n=300, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["foo-bar", "Café"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, rnd.choice(["", None, "w1 w2", "foo-bar"]), " ".join(rnd.choices(words, weights, k=rnd.randrange(0, 60)))) for i in range(n)]


def tokens(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower().replace("é", "e"))


def brute(rows, queries, k, weights=(1.0, 1.0), within=None):
    """{query: [(score, chunk)]} by the formula, over all rows."""
    texts = {i: [tokens(t), tokens(c)] for i, t, c in rows}
    lens = {i: sum(map(len, f)) for i, f in texts.items()}
    avg = sum(lens.values()) / len(lens)
    out = {}
    for q, text in queries:
        terms = {t for t in text.split() if tokens(t)}
        scores = collections.defaultdict(float)
        for term in sorted(terms):
            p = tokens(term)
            tf = {i: sum(w * sum(f[a : a + len(p)] == p for a in range(len(f) - len(p) + 1)) for w, f in zip(weights, fs)) for i, fs in texts.items()}
            df = sum(v > 0 for v in tf.values())
            idf = math.log((len(rows) - df + 0.5) / (df + 0.5))
            idf = idf if idf > 0 else 1e-6
            for i, v in tf.items():
                if v:
                    scores[i] += idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * lens[i] / avg))
        best = sorted(((-round(s, 9), i) for i, s in scores.items() if within is None or i in within))[:k]
        if best:
            out[q] = [(i, -s) for s, i in best]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r.full_text_rank, r.chunk_id, -r.bm25))
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-8)


QUERIES = [("a", "w0 w1 w40"), ("b", "w59 w0"), ("c", "foo-bar w3 W3 w3"), ("d", "cafe"), ("e", "w0"), ("f", "absent"), ("g", "?! "), ("h", "bar-foo"), *((f"r{i}", f"w{i} w{59 - i} w{i * 7 % 60} w0 w1") for i in range(20))]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id string, query string")


@pytest.mark.parametrize("block,at_once", [(512, 4096), (3, 16)])
def test_bm25_from_postings(spark, asked, tmp_path, monkeypatch, block, at_once):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "QUESTIONS_AT_ONCE", at_once)
    rows = corpus()
    index = P.PostingIndex(spark, f"file://{tmp_path}/i", FIELDS)
    assert index.append(spark.createDataFrame(rows, "chunk_id long, title string, content string")) == 1
    if block == 512:
        same(found(index.bm25(asked, 5)), brute(rows, QUERIES, 5))
        return
    same(found(index.bm25(asked, 4, {"title": 3.0})), brute(rows, QUERIES, 4, (3.0, 1.0)))
    some = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "chunk_id long")
    same(found(index.bm25(asked, 5, within=some)), brute(rows, QUERIES, 5, within=set(range(0, 300, 3))))


def test_added_segments_replace_chunks(spark, asked, tmp_path):
    first, more = corpus(), [*corpus(40, 2), (500, "w59", "w59 w58 brand new"), (3, None, None)]
    index = P.PostingIndex(spark, f"file://{tmp_path}/i", FIELDS)
    for rows in (first, more[:-1], more[-1:]):
        index.append(spark.createDataFrame(rows, "chunk_id long, title string, content string"))
    now = {r[0]: r for r in [*first, *more]}
    assert index.segments == [1, 2, 3] and index.chunks().count() == len(now)
    same(found(index.bm25(asked, 6)), brute(list(now.values()), QUERIES, 6))


def test_a_failed_segment_leaves_none(spark, tmp_path):
    index = P.PostingIndex(spark, f"file://{tmp_path}/i", FIELDS)
    bad = spark.createDataFrame(corpus(5), "chunk_id long, title string, content string").withColumn("content", F.when(F.col("chunk_id") == 3, F.raise_error("broken")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        index.append(bad)
    assert index.segments == [] and index.folder.names() == []


def test_only_the_folders_of_the_terms_are_read(spark, tmp_path):
    index = P.PostingIndex(spark, f"file://{tmp_path}/i", FIELDS)
    index.append(spark.createDataFrame(corpus(), "chunk_id long, title string, content string"))
    one = index.postings(pa.table({"token": ["w7"]}))
    assert index._postings.select("bucket").distinct().count() > 10
    # Without the other folders it is the same.
    for name in Folder(spark, f"{index.path}/segment-000001/postings").names():
        if name.startswith("bucket=") and name != f"bucket={zlib.crc32(b'w7') % P.BUCKETS}":
            index.folder.remove(f"segment-000001/postings/{name}")
    rows = one.collect()
    assert {r.token for r in rows} == {"w7"} and sum(r.n for r in rows) == sum("w7" in tokens(t) + tokens(c) for _, t, c in corpus())


def test_a_frequent_token_is_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 50)
    index = P.PostingIndex(spark, f"file://{tmp_path}/i", ["content"])
    index.append(spark.range(2_000).select(F.col("id").alias("chunk_id"), F.lit("the same words").alias("content")))
    rows = index.postings(pa.table({"token": ["the"]})).collect()
    assert max(r.n for r in rows) <= 50 and sum(r.n for r in rows) == 2_000


def test_terms_that_cannot_matter_are_spared(spark, tmp_path, monkeypatch):
    rows = [(i, "", "common " * (1 + i % 3) + ("rare " * 3 if i % 50 == 0 else "")) for i in range(400)]
    index = P.PostingIndex(spark, f"file://{tmp_path}/i", FIELDS)
    index.append(spark.createDataFrame(rows, "chunk_id long, title string, content string"))
    seen = []
    hits = index._hits
    monkeypatch.setattr(index, "_hits", lambda phrases, weights: seen.append(list(phrases.values())) or hits(phrases, weights))
    q = [("q", "common rare")]
    same(found(index.bm25(spark.createDataFrame(q, "query_id string, query string"), 5)), brute(rows, q, 5))
    assert seen[-1] == [("common",)] and seen[-2] == [("rare",)]


def test_a_replaced_table_gives_new_rows(spark, sf_dir, tmp_path):
    folder = f"{tmp_path}/t"
    for name in ("benchmark", "documents"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    assert search_queries.bm25_topk(spark, folder).select("chunk_id").distinct().count() > 5
    five = spark.createDataFrame(spark.read.parquet(f"{folder}/documents.parquet").limit(5).collect(), spark.read.parquet(f"{folder}/documents.parquet").schema)
    five.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert search_queries.bm25_topk(spark, folder).select("chunk_id").distinct().count() <= 5
    assert search_queries.hybrid_search(spark, folder).select("chunk_id").distinct().count() <= 5


def test_release_store(spark, tmp_path):
    store = ReleaseStore(spark, most=2, root=f"file://{tmp_path}/s")
    made = []
    table = lambda n: store.table("t", str(n), lambda: made.append(n) or spark.range(n))
    assert [table(n).count() for n in (1, 2, 1, 3)] == [1, 2, 1, 3]
    assert made == [1, 2, 3] and [n for n in store.folder.names() if n.startswith("t-")] == ["t-1", "t-3"]
    with pytest.raises(ZeroDivisionError):
        store.path("t", "bad", lambda path: 1 // 0)
    assert not [n for n in store.folder.names() if "bad" in n or n.startswith("_new")]
    assert not Folder(spark, f"file://{tmp_path}/s").rename("t-1", "t-3")


def test_fingerprint(spark):
    rows = [(1, "a"), (2, None), (2, None)]
    one = spark.createDataFrame(rows, "i int, s string")
    assert fingerprint(one) == fingerprint(one.repartition(3)) != fingerprint(one.distinct())
    assert fingerprint(one) != fingerprint(spark.createDataFrame([(1, None), (2, "a"), (2, None)], "i int, s string"))
    assert fingerprint(one.limit(0)).startswith("0-")


def test_vector_plan_does_not_grow_with_questions(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERIES_AT_ONCE", 4)
    chunks = spark.range(50).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    sizes = []
    for n in (8, 40):
        plan = S.vector_channel(chunks.limit(n).withColumnRenamed("chunk_id", "query_id"), chunks, 3)
        sizes.append(plan._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        assert plan.count() == 3 * n
    assert sizes[0] == sizes[1]
    monkeypatch.setattr(S, "BLOCKS_TO_ALL", 0)
    lanes = S.vector_channel(chunks.withColumnRenamed("chunk_id", "query_id"), chunks, 3)
    assert lanes.count() == 150 and {r.chunk_id for r in lanes.collect()} == {47, 48, 49, 0, 1, 2}


def test_postings_travel_by_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SHARD_CHUNKS", 700)
    index = P.PostingIndex(spark, f"file://{tmp_path}/i", ["content"])
    rows = [(i, " ".join(["the", f"w{i % 7}"] * (1 + i % 3)) if i % 11 else "") for i in range(2_000)]
    index.append(spark.createDataFrame(rows, "chunk_id long, content string").coalesce(1))
    hits = index._hits({0: ("the",), 1: ("w3", "the")}, {}).collect()
    assert len(hits) < 20  # a row for each block or phrase and shard, not one for each chunk
    assert {p: sum(len(r.places) for r in hits if r.pid == p) for p in (0, 1)} == {0: sum(bool(t) for _, t in rows), 1: sum("w3 the" in t for _, t in rows)}
    q = [("q", "the w3 w5-the")]
    same(found(index.bm25(spark.createDataFrame(q, "query_id string, query string"), 9)), brute([(i, "", t) for i, t in rows], q, 9))
