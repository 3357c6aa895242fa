"""Retrieval operators over batches of questions: channels, fusion, evidence, answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelight.functions import text as T

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Scores that agree to so many places are a tie, whatever the order of summation.
TIE_PLACES = 9


def rank(by: list[str], *order: Column) -> Column:
    """1-based place without gaps; the last of ``order`` must break all ties."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    return df.withColumn(name, rank(by, *order)).filter(F.col(name) <= k)


#: Questions and chunks of a block, and blocks of questions that are sent to all tasks.
QUERIES_AT_ONCE, CHUNKS_AT_ONCE, BLOCKS_TO_ALL = 256, 2_048, 64
#: Hits (term and chunk) that are weighed at a time.
HITS_AT_ONCE = 20_000
#: A side of a join is broadcast only when it was counted to have at most so many rows.
BROADCAST_ROWS = 500_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting; a larger table joins by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def _best(query_ids: pa.Array, chunk_ids: pa.Array, scores: np.ndarray, hit: np.ndarray, k: int, name: str) -> pa.RecordBatch:
    """(query_id, chunk_id, ``name``): the ``k`` highest hits of each question (a row of ``scores``), ties to the smaller chunk_id."""
    n = len(chunk_ids)
    by_id = np.zeros(n, np.int64)  # places in the order of chunk_id
    by_id[pc.sort_indices(chunk_ids).to_numpy()] = np.arange(n)
    rounded = np.where(hit, np.round(scores, TIE_PLACES), -np.inf)
    least = np.partition(rounded, n - min(k, n), axis=1)[:, n - min(k, n)] if n else np.zeros(len(scores))
    out_q, out_c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(scores)):
        some = np.flatnonzero((rounded[i] >= least[i]) & (rounded[i] > -np.inf))
        best = some[np.lexsort((by_id[some], -rounded[i, some]))][:k]
        out_q.append(np.full(len(best), i))
        out_c.append(best)
    q, c = np.concatenate(out_q).astype(np.int64), np.concatenate(out_c).astype(np.int64)
    return pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), chunk_ids.take(pa.array(c)), pa.array(scores[q, c])], ["query_id", "chunk_id", name])


def _packed(rows: DataFrame, key: str, rows_at_once: int) -> DataFrame:
    """(ids, dims, vectors): up to ``rows_at_once`` rows of an Arrow batch in one, those of a length together; a null vector is one of length 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for dims in np.unique(size):
                rows = np.flatnonzero(size == dims)
                for a in range(0, len(rows), rows_at_once):
                    at = pa.array(rows[a : a + rows_at_once])
                    v = pc.fill_null(batch.column(1).take(at).flatten(), 0.0)
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (batch.column(0).take(at), v)]
                    yield pa.RecordBatch.from_arrays([lists[0], pa.array([dims], pa.int32()), lists[1]], ["ids", "dims", "vectors"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, F.col("embedding").cast("array<double>")).mapInArrow(run, f"ids array<{kind}>, dims int, vectors array<double>")


def vector_channel(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """queries(query_id, embedding) against all chunks(chunk_id, embedding): query_id, chunk_id, vector_score, vector_rank.

    Questions and chunks travel in blocks; each pair of blocks is one matrix product, of which only the best k of a question go on. A few blocks of questions are
    sent to all tasks; more of them meet the blocks of chunks on as many lanes as there are shuffle partitions. The plan is the same for any number of
    questions. Vectors of another length than the question's, and null ones, score 0; ties go to the smaller chunk_id.
    """
    spark = queries.sparkSession
    n = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    few = n <= BLOCKS_TO_ALL
    lanes = 1 if few else int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = _packed(queries.select("query_id", "embedding").repartition(n), "query_id", QUERIES_AT_ONCE).toDF("query_ids", "query_dims", "query_vectors")
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    blocks = _packed(chunks.select("chunk_id", "embedding"), "chunk_id", CHUNKS_AT_ONCE)
    blocks = blocks.withColumn("lane", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(lanes)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                query_ids, chunk_ids = batch.column(0)[i].values, batch.column(3)[i].values
                dims = batch.column(1)[i].as_py()
                if dims == batch.column(4)[i].as_py():
                    q, v = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(-1, dims) for c in (2, 5))
                    scores = q @ v.T
                else:
                    scores = np.zeros((len(query_ids), len(chunk_ids)))
                yield _best(query_ids, chunk_ids, scores, np.ones(len(chunk_ids), bool), k, "vector_score")

    pairs = blocks.join(F.broadcast(asked) if few else asked, "lane").select("query_ids", "query_dims", "query_vectors", "ids", "dims", "vectors")
    kinds = dict(queries.dtypes) | dict(chunks.dtypes)
    found = pairs.mapInArrow(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, vector_score double")
    return top(found, ["query_id"], [F.desc(F.round("vector_score", TIE_PLACES)), F.col("chunk_id")], k, "vector_rank")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, phrase): white-space terms, each as the tokens that the index would hold; terms without tokens drop out."""
    terms = queries.select("query_id", F.explode(F.split(F.trim("query"), r"\s+")).alias("term")).distinct()
    return terms.withColumn("phrase", F.transform(T.index_tokens(F.col("term")), lambda t: T.fold(t))).filter(F.size("phrase") > 0)


def field_tokens(field: str) -> Column:
    """The index tokens of a field; the text is folded once as a whole, before it is cut."""
    return T.index_tokens(T.fold(F.coalesce(F.col(field).cast("string"), F.lit(""))))


def with_tokens(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """``chunks`` with a column <field>_tokens per field, for ``bm25_channel`` to read."""
    return chunks.withColumns({f"{f}_tokens": field_tokens(f) for f in fields if f"{f}_tokens" not in chunks.columns})


def fuse(vector: DataFrame, full_text: DataFrame, k: int = 60, vector_weight: float = 1.0, full_text_weight: float = 1.0) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists."""
    both = vector.join(full_text, ["query_id", "chunk_id"], "full_outer")
    part = lambda r, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return both.withColumn("vector_part", part("vector_rank", vector_weight)).withColumn("full_text_part", part("full_text_rank", full_text_weight)).withColumn("fusion", F.col("vector_part") + F.col("full_text_part"))


def those_found(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``chunks`` that ``found(chunk_id)``, a written table, names; texts of others don't travel."""
    return chunks.join(checked_broadcast(found.select("chunk_id").distinct()), "chunk_id", "left_semi")


def rerank(fused: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Order by fusion + 0.01 lexical; scores rounded as they are returned. Columns title and locator of the chunks are kept. ``fused`` is a written table."""
    more = [c for c in ("title", "locator") if c in chunks.columns]
    low = F.col("content_low") if "content_low" in chunks.columns else F.lower("content")
    chunks = those_found(chunks, fused)
    asked = queries.select("query_id", F.array_distinct(T.hash_tokens(F.col("query"))).alias("_terms"))
    rows = fused.join(checked_broadcast(asked), "query_id").join(chunks.select("chunk_id", "content", low.alias("_low"), *more), "chunk_id")
    rows = rows.withColumn("lexical", T.share_found(F.col("_terms"), F.col("_low")))
    rows = rows.withColumn("_order", F.round(F.col("fusion") + 0.01 * F.col("lexical"), 12))
    order = [F.desc("_order"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("full_text_rank"), F.col("chunk_id")]
    rows = top(rows, ["query_id"], order, limit, "rank")
    return rows.select(
        "query_id", "rank", "chunk_id", "content", *more, F.round("vector_score", 6).alias("vector_score"), "vector_rank",
        F.round(-F.col("bm25"), 6).alias("full_text_score"), "full_text_rank", F.round("fusion", 8).alias("fusion_score"), F.col("lexical").alias("rerank_score"),
    )


def select_evidence(results: DataFrame, most: int = 6, threshold: float | None = None) -> DataFrame:
    """Mark ``selected`` (with its evidence ``ordinal``) and give the ``reason`` of a rejection.

    By default any signal is enough: a lexical or full-text score over 0, or a vector score over 0.35. With a threshold the rerank score decides.
    """
    good = (F.coalesce("rerank_score", F.lit(0.0)) > 0) | (F.coalesce("full_text_score", F.lit(0.0)) > 0) | (F.coalesce("vector_score", F.lit(0.0)) > 0.35)
    if threshold is not None:
        good = F.coalesce("rerank_score", F.lit(0.0)) >= threshold
    place = F.row_number().over(Window.partitionBy("query_id", "_good").orderBy("rank"))
    rows = results.withColumn("_good", good).withColumn("_place", place)
    selected = F.col("_good") & (F.col("_place") <= most)
    reason = F.when(selected, F.lit(None).cast("string")).when(F.col("_good"), "over_limit").otherwise("no_signal")
    return rows.withColumn("selected", selected).withColumn("ordinal", F.when(selected, F.col("_place"))).withColumn("reason", reason).drop("_good", "_place")


def extractive_answers(evidence: DataFrame, queries: DataFrame, sentences: int = 3) -> DataFrame:
    """query_id, answer, citations, status: first sentences of the best evidence with their ordinals; a refusal without evidence."""
    first = evidence.filter("selected").filter(F.col("ordinal") <= sentences)
    line = F.concat(T.first_sentence(F.col("content")), F.lit(" ["), F.col("ordinal").cast("string"), F.lit("]"))
    parts = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("s")))).alias("p"))  # at most ``sentences`` a question
    rows = queries.select("query_id").join(parts, "query_id", "left")
    answer = F.concat(F.lit(T.BY_EVIDENCE + "\n\n"), F.array_join(F.transform("p", lambda x: x["s"]), "\n\n"))
    marks = F.coalesce(F.transform("p", lambda x: x["ordinal"]), F.array().cast("array<int>"))
    return rows.select("query_id", F.coalesce(answer, F.lit(T.NO_EVIDENCE)).alias("answer"), marks.alias("citations")).withColumn("status", F.when(F.size("citations") > 0, "sufficient").otherwise("insufficient"))


def prompts(evidence: DataFrame, queries: DataFrame, most_chars: int = 12_000) -> DataFrame:
    """query_id, prompt: the numbered evidence (title, place, content) up to a number of characters, and the question."""
    most_chars = max(100, min(100_000, most_chars))
    place = T.locator(F.col("locator")) if "locator" in evidence.columns else F.lit(T.WHOLE_DOCUMENT)
    title = F.coalesce(F.col("title"), F.lit("")) if "title" in evidence.columns else F.lit("")
    head = F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit("] "), title, F.lit(" | "), place, F.lit("\n"))
    rows = evidence.filter("selected").withColumn("line", F.concat(head, F.substring("content", 1, most_chars)))  # what a cut would drop anyway doesn't travel
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n\n")
    joined = queries.select("query_id", "query").join(rows.groupBy("query_id").agg(body.alias("body")), "query_id", "left")
    return joined.select("query_id", F.concat(F.lit("问题："), F.col("query"), F.lit("\n\n证据：\n"), F.substring(F.coalesce("body", F.lit("")), 1, most_chars)).alias("prompt"))


def messages(prompted: DataFrame, history: DataFrame, turns: int = 6, most_chars: int = 800) -> DataFrame:
    """query_id, messages array<struct<role, content>>: the last ``turns`` of history(query_id, turn, role, content) by users and assistants, then the prompt."""
    told = history.filter(F.col("role").isin("user", "assistant"))
    told = told.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("turn"), F.desc("role")))).filter(F.col("_n") <= turns)
    each = F.struct((-F.col("_n")).alias("n"), "role", F.substring(F.coalesce("content", F.lit("")), 1, most_chars).alias("content"))
    past = told.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(each)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("past"))
    own = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    return prompted.join(past, "query_id", "left").select("query_id", F.when(F.col("past").isNull(), own).otherwise(F.concat("past", own)).alias("messages"))


def validate_citations(answers: DataFrame, evidence: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``valid``: every cited ordinal is evidence, and strict answers cite or refuse."""
    known = evidence.filter("selected").groupBy("query_id").agg(F.collect_set("ordinal").alias("_known"))
    rows = answers.join(known, "query_id", "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<int>")))
    inside = F.forall("citations", lambda c: F.array_contains(F.col("_known"), c))
    enough = (F.size("citations") > 0) | T.refuses(F.col("answer")) if strict else F.lit(True)
    return rows.withColumn("valid", inside & enough).drop("_known")
