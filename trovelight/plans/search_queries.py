"""Retrieval queries over documents: one block per document, a small batch of questions."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight import config
from trovelight.functions import text as T
from trovelight.functions import vectors as V
from trovelight.operators import lifecycle as L
from trovelight.operators import postings as P
from trovelight.operators import search as S
from trovelight.plans.tables import read
from trovelight.sources.store import ReleaseStore, fingerprint, written

QUESTIONS = [
    ("q1", "the thing of reach that er"),
    ("q2", "der die und sicherung"),
    ("q3", "dans elle pour les mentions"),
    ("q4", "License version 3.0 GNU-General"),
    ("q5", "how to install LICENSE-2004 count"),
]
LIMIT, DEPTH = 8, 20


def fixed_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id string, query string")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed questions and all benchmark items."""
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    return fixed_questions(spark).unionByName(items)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.coalesce("text", F.lit("")).alias("content"))


class Release:
    """The chunks of a folder, and what the release store holds of them by their content."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.chunks = chunks(spark, sf_dir)
        self.store, self.content = ReleaseStore(spark), fingerprint(self.chunks)

    def embedded(self) -> DataFrame:
        return self.store.table("embeddings", self.content, lambda: V.embed(self.chunks, "chunk_id", "content"))

    def postings(self) -> P.PostingIndex:
        return P.stored_index(self.chunks, ["title", "content"], self.content)


def _vector(spark: SparkSession, sf_dir: str, k: int = DEPTH, release: Release | None = None) -> DataFrame:
    return S.vector_channel(V.embed(questions(spark, sf_dir), "query_id", "query"), (release or Release(spark, sf_dir)).embedded(), k)


def _full_text(spark: SparkSession, sf_dir: str, k: int = DEPTH, within: DataFrame | None = None, release: Release | None = None) -> DataFrame:
    return (release or Release(spark, sf_dir)).postings().bm25(questions(spark, sf_dir), k, within=within)


def _channels(spark: SparkSession, sf_dir: str, k: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Both channels, worked out once and written: at most ``k`` rows a question each."""
    release = Release(spark, sf_dir)
    return written(spark, _vector(spark, sf_dir, k, release), "channel"), written(spark, _full_text(spark, sf_dir, k, release=release), "channel")


def _ranked(spark: SparkSession, sf_dir: str, vector: DataFrame, full_text: DataFrame, p: dict, limit: int, rows: DataFrame | None = None) -> DataFrame:
    fused = S.fuse(vector, full_text, p["fusion"]["k"], p["fusion"]["vectorWeight"], p["fusion"]["fullTextWeight"])
    return S.rerank(fused, questions(spark, sf_dir), chunks(spark, sf_dir) if rows is None else rows, limit)


def _results(spark: SparkSession, sf_dir: str, limit: int = LIMIT) -> DataFrame:
    p = config.profile()
    depth = max(2 * limit, p["vector"]["topK"])
    return _ranked(spark, sf_dir, *_channels(spark, sf_dir, depth), p, limit)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).drop("content", "title")


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.embedding_slots(chunks(spark, sf_dir), "chunk_id", "content")


def vector_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose vec_id is divisible by 20 against all rows."""
    e = read(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = S.vector_channel(q, e.select(F.col("vec_id").alias("chunk_id"), "embedding"), 10)
    return found.select("query_id", "chunk_id", F.round("vector_score", 6).alias("vector_score"), "vector_rank")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full_text(spark, sf_dir, 10).select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"), "full_text_rank")


def bm25_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text hits of the documents of good quality only, scored by the statistics of all."""
    good = read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("chunk_id")).distinct()
    return _full_text(spark, sf_dir, 10, good).select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"), "full_text_rank")


def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).crossJoin(F.broadcast(fixed_questions(spark)))  # five rows
    rows = rows.select("query_id", "chunk_id", T.lexical_score(F.col("query"), F.col("content")).alias("lexical"))
    return S.top(rows, ["query_id"], [F.desc("lexical"), F.col("chunk_id")], 10, "rank").select("query_id", "chunk_id", F.round("lexical", 6).alias("lexical"), "rank")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    release = Release(spark, sf_dir)
    return S.fuse(_vector(spark, sf_dir, release=release), _full_text(spark, sf_dir, release=release), 60, 1.0, 1.4)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", "chunk_id", "vector_rank", "full_text_rank", F.round("fusion", 8).alias("fusion"))


def rrf_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select(
        "query_id", "chunk_id", F.round("vector_part", 8).alias("vector_part"), F.round("full_text_part", 8).alias("full_text_part"), F.array_join(L.channels(F.col("vector_rank"), F.col("full_text_rank")), "+").alias("channels")
    )


def evidence_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_evidence(_results(spark, sf_dir)).filter("selected").select("query_id", "chunk_id", "rank", "ordinal")


def evidence_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_evidence(_results(spark, sf_dir)).filter("not selected").select("query_id", "chunk_id", "rank", "reason")


def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = S.select_evidence(_results(spark, sf_dir))
    answers = S.validate_citations(S.extractive_answers(evidence, questions(spark, sf_dir)), evidence)
    return answers.select("query_id", "answer", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"), "status", "valid")


def evidence_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prompts(S.select_evidence(_results(spark, sf_dir)), questions(spark, sf_dir), config.profile()["prompt"]["maxEvidenceChars"])


def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last question of each conversation with the turns before it, as it is sent to a model; the evidence is that of the prompt alone."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    last = c.filter("role = 'user'").groupBy("conv_id").agg(F.max(F.struct("turn", "content")).alias("m")).select("conv_id", F.col("m.turn").alias("_turn"), F.col("m.content").alias("prompt"))
    past = c.join(last.select("conv_id", "_turn"), "conv_id").filter("turn < _turn").select(F.col("conv_id").alias("query_id"), "turn", "role", "content")
    sent = S.messages(last.select(F.col("conv_id").alias("query_id"), "prompt"), past)
    return sent.select(F.col("query_id").alias("conv_id"), F.size("messages").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")).alias("messages_md5"))


def trace_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two profiles that differ in fusion only share their channels."""
    p, over = config.profile(), config.profile({"fusion": {"vectorWeight": 0.0, "k": 31}})
    vector, full_text = _channels(spark, sf_dir)
    rows = written(spark, S.those_found(chunks(spark, sf_dir), vector.select("chunk_id").union(full_text.select("chunk_id"))), "candidates")
    left, right = (_ranked(spark, sf_dir, vector, full_text, x, LIMIT, rows) for x in (p, over))
    return L.compare_candidates(left, right, ["query_id", "chunk_id"])


def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = S.fuse(*_channels(spark, sf_dir), 60, 1.0, 1.4)
    rows = fused.join(S.those_found(chunks(spark, sf_dir), fused), "chunk_id").withColumn("channels", L.channels(F.col("vector_rank"), F.col("full_text_rank"))).withColumn("fusion_score", F.col("fusion"))
    return L.filter_candidates(rows, "the", "fullText", 0.015).select("query_id", "chunk_id", F.round("fusion_score", 8).alias("fusion_score"))


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a benchmark item's terms that its best documents hold: documents are held against all items as they are read, and only the best of some documents go on."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(T.hash_tokens(F.coalesce("text", F.lit("")))).alias("terms"))
    best = P.shared_terms(items, chunks(spark, sf_dir).select("chunk_id", F.array_distinct(T.hash_tokens(F.col("content"))).alias("terms")), 3)
    return best.select(F.col("query_id").alias("item_id"), "chunk_id", "rank", "hits", F.round(F.col("hits") / F.col("n_terms"), 6).alias("overlap"))


def parse_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    p = q.select("conv_id", "turn", T.parse_plan(F.col("t"), F.col("conv_id") % 2 == 0).alias("p")).select("conv_id", "turn", "p.*")
    return p.withColumn("entities", F.array_join("entities", "|"))


def _intents(spark: SparkSession) -> DataFrame:
    words = ["怎么安装", "如何", "有多少", "统计数量", "表格字段", "第一列", "一行", "AB-12", "编号 4711", "you", ""]
    return spark.createDataFrame([(2_000_000 + i, t) for i, t in enumerate(words)], "item_id long, t string")


def route_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent, weights and strategy of all benchmark items and some questions; the item's number says which channels are on."""
    q = read(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("t")).unionByName(_intents(spark))
    t, on = F.col("t"), F.col("item_id") % 4
    return q.select("item_id", T.intent(t).alias("intent"), T.vector_weight(t).alias("vector_weight"), T.full_text_weight(t).alias("full_text_weight"), T.strategy(on != 1, ~on.isin(1, 2)).alias("strategy"))


def supplied_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of every row whose vec_id is divisible by 20 with the mean vector of each label, so that no pairs are made: mean cosine per row and label."""
    e = read(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    probe = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe_id"), F.posexplode("embedding").alias("i", "p"))
    sums = probe.join(S.checked_broadcast(means), "i").groupBy("probe_id", "label").agg(F.sum(F.col("p").cast("double") * F.col("s")).alias("c"), F.max("n").alias("n"))
    return sums.select("probe_id", "label", F.round(F.col("c") / F.col("n"), 6).alias("mean_cosine"), "n")


QUERIES = {f.__name__: f for f in (
    hybrid_search, hash_embedding, vector_topk_exact, bm25_topk, bm25_within, prompt_messages, lexical_rerank, rrf_fusion, rrf_explain, evidence_select, evidence_rejected, extractive_answer,
    evidence_prompt, trace_compare, candidate_filter, benchmark_overlap, parse_question, route_query, supplied_embedding_pairs,
)}

_VALUES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in QUESTIONS)
_TOKEN = r"[\x{3400}-\x{9fff}]|[a-z0-9_./-]+"


def _slots(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in {name}_s(key, slot, weight)."""
    return rf"""
{name}_t AS (SELECT {key}, unnest(regexp_extract_all(replace(lower({text}), chr(12288), ' '), '{_TOKEN}')) AS tk FROM {source}),
{name}_c AS (SELECT {key}, sha256(tk) AS g, count(*) AS n FROM {name}_t GROUP BY ALL),
{name}_b AS (SELECT {key}, n, g, i, ('0x' || substr(g, 2*i+1, 2))::INT AS b0, ('0x' || substr(g, 2*i+3, 2))::INT AS b1, ('0x' || substr(g, 2*i+5, 2))::INT AS b2
             FROM {name}_c, (SELECT unnest(generate_series(0, 7)) AS i)),
{name}_r AS (SELECT {key}, (b0 * 256 + b1) % 128 AS slot, sum(CASE WHEN b2 % 2 = 1 THEN n ELSE -n END) AS s FROM {name}_b GROUP BY ALL),
{name}_s AS (SELECT {key}, slot, round(s / sqrt(sum(s * s) OVER (PARTITION BY {key})), 8) AS weight FROM {name}_r WHERE s <> 0)"""


_BASE = rf"""fixed(query_id, query) AS (VALUES {_VALUES}),
questions AS (SELECT * FROM fixed UNION ALL SELECT 'b' || item_id, coalesce(text, '') FROM benchmark),
chunks AS (SELECT doc_id AS chunk_id, source AS title, coalesce(text, '') AS content FROM documents)"""
_VECTOR = rf"""{_slots('d', 'chunks', 'chunk_id', 'content')},{_slots('q', 'questions', 'query_id', 'query')},
dots AS (SELECT query_id, chunk_id, sum(q_s.weight * d_s.weight) AS s FROM q_s JOIN d_s USING (slot) GROUP BY ALL),
vec_all AS (SELECT query_id, chunk_id, coalesce(s, 0) AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 9) DESC, chunk_id) AS vector_rank
            FROM questions CROSS JOIN chunks LEFT JOIN dots USING (query_id, chunk_id))"""
_BM25 = r"""
f_terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(string_split_regex(trim(query), '\s+')) AS term FROM questions)),
f_phr AS (SELECT query_id, list_transform(regexp_extract_all(lower(term), '[\p{L}\p{N}\p{Co}]+'), lambda x: strip_accents(x)) AS phrase FROM f_terms),
f_q AS (SELECT * FROM f_phr WHERE len(phrase) > 0),
f_tok AS (SELECT chunk_id, list_transform(regexp_extract_all(lower(title), '[\p{L}\p{N}\p{Co}]+'), lambda x: strip_accents(x)) AS tk FROM chunks
          UNION ALL SELECT chunk_id, list_transform(regexp_extract_all(lower(content), '[\p{L}\p{N}\p{Co}]+'), lambda x: strip_accents(x)) FROM chunks),
f_len AS (SELECT chunk_id, sum(len(tk)) AS len FROM f_tok GROUP BY 1),
f_pos AS (SELECT chunk_id, row_number() OVER () AS r, tk FROM f_tok),
f_ex AS (SELECT chunk_id, tk, unnest(generate_series(1, len(tk))) AS i FROM f_pos),
f_tf AS (SELECT chunk_id, phrase, count(*) AS tf FROM f_ex JOIN (SELECT DISTINCT phrase FROM f_q) ON tk[i] = phrase[1] AND tk[i : i + len(phrase) - 1] = phrase GROUP BY ALL),
f_idf AS (SELECT phrase, (SELECT count(*) FROM f_len) AS n, count(*) AS d FROM f_tf GROUP BY 1),
f_w AS (SELECT phrase, CASE WHEN ln((n - d + 0.5) / (d + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d + 0.5) / (d + 0.5)) END AS idf FROM f_idf),
f_score AS (SELECT query_id, chunk_id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM f_len)))) AS bm25
            FROM f_q JOIN f_w USING (phrase) JOIN f_tf USING (phrase) JOIN f_len USING (chunk_id) GROUP BY ALL),
fts_all AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), chunk_id) AS full_text_rank FROM f_score)"""
_CHANNELS = f"WITH {_BASE}, {_VECTOR}, {_BM25}"


def _fused_sql(name: str, k: int, vw: float, fw: float) -> str:
    return f"""{name} AS (SELECT query_id, chunk_id, vector_score, vector_rank, bm25, full_text_rank,
 coalesce({vw} / ({k} + vector_rank), 0) AS vector_part, coalesce({fw} / ({k} + full_text_rank), 0) AS full_text_part
 FROM (SELECT * FROM vec_all WHERE vector_rank <= {DEPTH}) FULL JOIN (SELECT * FROM fts_all WHERE full_text_rank <= {DEPTH}) USING (query_id, chunk_id))"""


def _ranked_sql(name: str, fused: str) -> str:
    return rf"""{name}_l AS (SELECT f.*, vector_part + full_text_part AS fusion, c.content,
  coalesce(len(list_filter(list_distinct(regexp_extract_all(lower(query), '{_TOKEN}')), lambda t: contains(lower(c.content), t))) / nullif(len(list_distinct(regexp_extract_all(lower(query), '{_TOKEN}'))), 0), 0.0) AS lexical
  FROM {fused} f JOIN questions USING (query_id) JOIN chunks c USING (chunk_id)),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion + 0.01 * lexical, 12) DESC, vector_rank ASC NULLS LAST, full_text_rank ASC NULLS LAST, chunk_id) AS rank FROM {name}_l) WHERE rank <= {LIMIT}),
{name}_e AS (SELECT *, row_number() OVER (PARTITION BY query_id, good ORDER BY rank) AS place FROM
  (SELECT *, coalesce(lexical, 0) > 0 OR coalesce(round(-bm25, 6), 0) > 0 OR coalesce(round(vector_score, 6), 0) > 0.35 AS good FROM {name}))"""


_SEARCH = f"{_CHANNELS}, {_fused_sql('fused', 60, 1.0, 1.0)}, {_ranked_sql('ranked', 'fused')}"
ORACLES = {
    "hybrid_search": _SEARCH + " SELECT query_id, rank, chunk_id, round(vector_score, 6) AS vector_score, vector_rank, round(-bm25, 6) AS full_text_score, full_text_rank, round(fusion, 8) AS fusion_score, lexical AS rerank_score FROM ranked",
    "hash_embedding": f"WITH {_BASE}, {_slots('d', 'chunks', 'chunk_id', 'content')} SELECT chunk_id, slot, weight FROM d_s",
    "vector_topk_exact": """SELECT query_id, chunk_id, round(s, 6) AS vector_score, vector_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS vector_rank FROM
 (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE vector_rank <= 10""",
    "bm25_topk": f"WITH {_BASE}, {_BM25} SELECT query_id, chunk_id, round(bm25, 6) AS bm25, full_text_rank FROM fts_all WHERE full_text_rank <= 10",
    "lexical_rerank": rf"""WITH {_BASE}, l AS (SELECT query_id, chunk_id, len(list_filter(list_distinct(regexp_extract_all(lower(query), '{_TOKEN}')), lambda t: contains(lower(content), t))) / len(list_distinct(regexp_extract_all(lower(query), '{_TOKEN}'))) AS lexical FROM chunks CROSS JOIN fixed)
 SELECT query_id, chunk_id, round(lexical, 6) AS lexical, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) AS rank FROM l) WHERE rank <= 10""",
    "rrf_fusion": f"{_CHANNELS}, {_fused_sql('fused', 60, 1.0, 1.4)} SELECT query_id, chunk_id, vector_rank, full_text_rank, round(vector_part + full_text_part, 8) AS fusion FROM fused",
    "rrf_explain": f"{_CHANNELS}, {_fused_sql('fused', 60, 1.0, 1.4)} SELECT query_id, chunk_id, round(vector_part, 8) AS vector_part, round(full_text_part, 8) AS full_text_part, concat_ws('+', CASE WHEN vector_rank IS NOT NULL THEN 'vector' END, CASE WHEN full_text_rank IS NOT NULL THEN 'fullText' END) AS channels FROM fused",
    "evidence_select": _SEARCH + " SELECT query_id, chunk_id, rank, place AS ordinal FROM ranked_e WHERE good AND place <= 6",
    "evidence_rejected": _SEARCH + " SELECT query_id, chunk_id, rank, CASE WHEN good THEN 'over_limit' ELSE 'no_signal' END AS reason FROM ranked_e WHERE NOT (good AND place <= 6)",
    "bm25_within": f"WITH {_BASE}, {_BM25} SELECT query_id, chunk_id, round(bm25, 6) AS bm25, full_text_rank FROM (SELECT query_id, chunk_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), chunk_id) AS full_text_rank FROM f_score WHERE chunk_id IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE full_text_rank <= 10",
    "prompt_messages": """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS content FROM conversations), l AS (SELECT conv_id, turn AS t, content AS p FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, content DESC) AS n FROM c WHERE role = 'user') WHERE n = 1),
 h AS (SELECT conv_id, role, substr(content, 1, 800) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS n FROM c JOIN l USING (conv_id) WHERE turn < t AND role IN ('user', 'assistant')),
 a AS (SELECT conv_id, count(*) AS k, string_agg(role || ':' || content, chr(10) ORDER BY n DESC) AS s FROM h WHERE n <= 6 GROUP BY 1)
 SELECT conv_id, (coalesce(k, 0) + 1)::INT AS n, md5(coalesce(s || chr(10), '') || 'user:' || p) AS messages_md5 FROM l LEFT JOIN a USING (conv_id)""",
    "extractive_answer": _SEARCH + rf""", norm AS (SELECT query_id, place, content AS c FROM ranked_e WHERE good AND place <= 3),
 cut AS (SELECT query_id, place, substr(CASE WHEN regexp_extract(c, '^[^。！？.!?]*[。！？.!?]') = '' THEN c ELSE regexp_extract(c, '^[^。！？.!?]*[。！？.!?]') END, 1, 280) AS s FROM norm),
 line AS (SELECT query_id, place, CASE WHEN regexp_matches(s, '[。！？.!?]$') THEN s ELSE s || '。' END || ' [' || place || ']' AS s FROM cut),
 agg AS (SELECT query_id, '{T.BY_EVIDENCE}' || chr(10) || chr(10) || string_agg(s, chr(10) || chr(10) ORDER BY place) AS answer, string_agg(place::VARCHAR, ',' ORDER BY place) AS citations FROM line GROUP BY 1)
 SELECT query_id, coalesce(answer, '{T.NO_EVIDENCE}') AS answer, coalesce(citations, '') AS citations, CASE WHEN citations IS NULL THEN 'insufficient' ELSE 'sufficient' END AS status, true AS valid FROM questions LEFT JOIN agg USING (query_id)""",
    "evidence_prompt": _SEARCH + f""", body AS (SELECT query_id, string_agg('[' || place || '] ' || coalesce(title, '') || ' | {T.WHOLE_DOCUMENT}' || chr(10) || e.content, chr(10) || chr(10) ORDER BY place) AS b FROM ranked_e e JOIN chunks USING (chunk_id) WHERE good AND place <= 6 GROUP BY 1)
 SELECT query_id, '问题：' || query || chr(10) || chr(10) || '证据：' || chr(10) || substr(coalesce(b, ''), 1, 12000) AS prompt FROM questions LEFT JOIN body USING (query_id)""",
    "trace_compare": f"{_SEARCH}, {_fused_sql('fused2', 31, 0.0, 1.0)}, {_ranked_sql('ranked2', 'fused2')}" + """ SELECT query_id, chunk_id, CASE WHEN a.chunk_id IS NULL THEN 'added' WHEN b.chunk_id IS NULL THEN 'removed' ELSE 'common' END AS change
 FROM (SELECT query_id, chunk_id, 1 AS one FROM ranked) x FULL JOIN (SELECT query_id, chunk_id, 1 AS two FROM ranked2) y USING (query_id, chunk_id)""".replace("a.chunk_id IS NULL", "one IS NULL").replace("b.chunk_id IS NULL", "two IS NULL"),
    "candidate_filter": f"{_CHANNELS}, {_fused_sql('fused', 60, 1.0, 1.4)} SELECT query_id, chunk_id, round(vector_part + full_text_part, 8) AS fusion_score FROM fused JOIN chunks USING (chunk_id) WHERE full_text_rank IS NOT NULL AND vector_part + full_text_part >= 0.015 AND (contains(lower(content), 'the') OR contains(lower(title), 'the'))",
    "benchmark_overlap": rf"""WITH i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}')) AS term FROM benchmark),
 d AS (SELECT DISTINCT doc_id AS chunk_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}')) AS term FROM documents),
 s AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1), h AS (SELECT item_id, chunk_id, count(*) AS hits FROM i JOIN d USING (term) GROUP BY ALL)
 SELECT item_id, chunk_id, rank, hits, round(hits / n, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, chunk_id) AS rank FROM h) JOIN s USING (item_id) WHERE rank <= 3""",
    "parse_question": r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS n FROM conversations WHERE role = 'user'),
 e AS (SELECT *, regexp_extract_all(n, '[A-Za-z]+[-_.]?[A-Za-z0-9]*|[\x{4e00}-\x{9fff}]{2,8}') AS en FROM t)
 SELECT conv_id, turn, n AS normalised, array_to_string(list_filter(en, lambda x, i: list_position(en, x) = i)[1:12], '|') AS entities,
 CASE WHEN regexp_matches(n, '[\x{4e00}-\x{9fff}]') THEN 'zh-CN' ELSE 'und' END AS language,
 CASE WHEN regexp_matches(n, '_PROCEDURE_') THEN 'procedure' WHEN regexp_matches(n, '_FACT_') THEN 'fact' ELSE 'knowledge_query' END AS intent, length(n) < 2 AS needs_clarification,
 CASE WHEN conv_id % 2 = 0 THEN 'strict_evidence' ELSE 'evidence_preferred' END AS policy FROM e""".replace("_PROCEDURE_", T.PROCEDURE).replace("_FACT_", T.FACT),
    "route_query": rf"""WITH t AS (SELECT item_id, coalesce(text, '') AS t FROM benchmark UNION ALL SELECT 2000000 + i, t FROM (VALUES (0, '怎么安装'), (1, '如何'), (2, '有多少'), (3, '统计数量'), (4, '表格字段'), (5, '第一列'), (6, '一行'), (7, 'AB-12'), (8, '编号 4711'), (9, 'you'), (10, '')) v(i, t))
 SELECT item_id, CASE WHEN regexp_matches(t, '{T.PROCEDURE}') THEN 'procedure' WHEN regexp_matches(t, '{T.FACT}') THEN 'fact' ELSE 'knowledge_query' END AS intent, CASE WHEN regexp_matches(t, '{T.TABULAR}') THEN 0.9 ELSE 1.0 END::DOUBLE AS vector_weight,
 CASE WHEN regexp_matches(t, '[A-Z]{{2,}}[-_]?\d+|\b\d{{3,}}\b') THEN 1.4 ELSE 1.0 END::DOUBLE AS full_text_weight, CASE item_id % 4 WHEN 1 THEN 'none' WHEN 2 THEN 'full_text' ELSE 'hybrid' END AS strategy FROM t""",
    "supplied_embedding_pairs": """SELECT a.vec_id AS probe_id, b.label, round(avg(c), 6) AS mean_cosine, count(*) AS n FROM embeddings a, embeddings b, LATERAL (SELECT list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c) WHERE a.vec_id % 20 = 0 GROUP BY ALL""",
}
