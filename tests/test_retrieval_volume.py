"""What retrieval sends through shuffles: neither the texts of all chunks, nor a row for each pair, nor a channel twice."""

import random

from trovelight.operators import postings as P
from trovelight.operators import search as S
from trovelight.plans import search_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_found_chunks_travel_to_the_ranking(spark):
    fused = spark.createDataFrame([("q", 3, 0.1, 1, -1.0, 1, 0.03), ("q", 5, 0.0, 2, None, None, 0.01)], "query_id string, chunk_id long, vector_score double, vector_rank int, bm25 double, full_text_rank int, fusion double")
    chunks = spark.range(1_000).selectExpr("id AS chunk_id", "concat('some text ', id) AS content")
    asked = spark.createDataFrame([("q", "some text 5")], "query_id string, query string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ranked = S.rerank(fused, asked, chunks, 8)
        assert "LeftSemi, BuildRight" in plan(ranked)
        assert [(r.chunk_id, r.content, round(r.rerank_score, 6)) for r in ranked.orderBy("rank").collect()] == [(3, "some text 3", 0.666667), (5, "some text 5", 1.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_profiles_share_their_channels(spark, sf_dir):
    assert "MapInArrow" not in plan(search_queries.trace_compare(spark, sf_dir))


def test_shared_terms_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(P, "CHUNKS_AT_ONCE", 7)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    chunks = [(i, rnd.sample(words, rnd.randrange(0, 20))) for i in range(100)]
    asked = [(q, rnd.sample([*words, "absent"], q % 9)) for q in range(11)] + [(50, ["absent"])]
    got = P.shared_terms(spark.createDataFrame(asked, "query_id long, terms array<string>"), spark.createDataFrame(chunks, "chunk_id long, terms array<string>"), 4).collect()
    want = set()
    for q, terms in asked:
        hits = sorted((-len(set(terms) & set(t)), i) for i, t in chunks)
        want |= {(q, i, -h, n + 1, len(terms)) for n, (h, i) in enumerate(hits[:4]) if h < 0}
    assert {tuple(r[c] for c in ("query_id", "chunk_id", "hits", "rank", "n_terms")) for r in got} == want
    assert "mapInArrow" not in "".join(plan(P.shared_terms(spark.createDataFrame([], "query_id long, terms array<string>"), spark.createDataFrame(chunks, "chunk_id long, terms array<string>"), 4)))
