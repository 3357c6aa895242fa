"""Queries of the chunk workbench, signatures, requests and trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovelight.functions import text as T
from trovelight.operators import workbench as W
from trovelight.plans.tables import read

SECRET = "widget-secret"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "source", "lang")


def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", W.graph_level(F.col("vec_id")).alias("level"))


def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sensitive_spans(_docs(spark, sf_dir), "doc_id", "t", ("email",)).select("doc_id", "start", F.col("end").alias("stop"))


def sensitive_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of e-mail addresses and credentials with what replaces them."""
    return W.sensitive_spans(_docs(spark, sf_dir), "doc_id", "t", ("email", "credential")).select("doc_id", "kind", "start", F.col("end").alias("stop"), "replacement")


def default_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = W.midpoint_parts(F.col("t"))
    return _docs(spark, sf_dir).filter("length(t) >= 2").select("doc_id", F.md5(parts[0]).alias("first_md5"), F.md5(parts[1]).alias("second_md5"))


def conversation_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    listed = W.chapters(c, "conv_id", "turn", "text")
    return listed.select("conv_id", F.size("chapters").alias("n"), F.md5(F.array_join(F.transform("chapters", lambda x: x["title"]), "|")).alias("titles_md5"))


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = W.grouped_tree(_docs(spark, sf_dir), "source", "lang")
    return tree.select("source", "n", F.array_join(F.transform("children", lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), ",").alias("children"))


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id").join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    excluded = read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("e"))
    return W.chunk_stats(d.join(excluded, "doc_id", "left").withColumn("excluded", F.coalesce("e", F.lit(False))))


def default_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "available").when(F.col("o_orderstatus") == "P", "unverified").otherwise("failed")
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", state.alias("status"))
    return W.choose_default(o, ["o_custkey"], "status", F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "status")


def signed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    text = W.canonical_request(F.lit("post"), F.concat(F.lit("/"), F.col("event_type")), F.unix_timestamp("ts"), F.col("event_id").cast("string"), F.lit("https://example.org"), F.col("props"))
    return e.select("event_id", W.hmac_sha256(SECRET, text).alias("signature"))


def citation_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = read(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").alias("doc_id"))
    docs = _docs(spark, sf_dir).select("doc_id", "source")
    released = read(spark, sf_dir, "labels").filter("quality = 1")
    return W.open_citations(cited, docs, released).select("item_id", "source", "state")


def trace_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return W.draft_versions(e, ["user_id", "event_type"], F.col("event_id"))


def replay_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "ts", F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("key"), "event_type")
    return W.judge_requests(e, "key", "event_type", F.col("ts"), F.col("event_id")).select("event_id", "outcome")


def document_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = W.axis_scatter(read(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("t")), "item_id", "t")
    return s.select("item_id", *[(F.round(n, 6) + F.lit(0.0)).alias(n) for n in "xy"])


def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with their document, dataset and shown status: three inner joins, the two small sides by key."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    state = W.shown_status(F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "queued").otherwise("running"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", state.alias("status")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name", "status", "n_lines")  # 25 nations


def part_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bridge both ways: of each part, its distinct suppliers and the orders that hold it."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    return lines.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n_suppliers"), F.count_distinct("l_orderkey").alias("n_orders"))


def revision_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w))
    return W.unified_diffs(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "before", F.col("text").alias("after")))


QUERIES = {f.__name__: f for f in (
    graph_levels, email_spans, sensitive_spans, default_split, conversation_chapters, source_tree, chunk_stats, default_choice, signed_requests, citation_open,
    trace_drafts, replay_requests, document_scatter, task_list, part_suppliers, revision_diffs,
)}

_D = "d AS (SELECT doc_id, coalesce(text, '') AS t, source, lang FROM documents)"
_EMAIL = T.wide(T.EMAIL)


def _spans(pattern: str) -> str:
    """Spans of a pattern in d(doc_id, t)."""
    return rf"""SELECT doc_id, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS start, (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::INT AS stop
 FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m FROM d))"""


_KEY = SECRET.encode().ljust(64, b"\0")
_INNER, _OUTER = (bytes(b ^ x for b in _KEY).hex() for x in (0x36, 0x5C))


def _slots(table: str, key: str) -> str:
    """Hash embedding of ``table(key, t)`` as rows (key, slot, w)."""
    digest = f"SELECT {key}, sha256(unnest(regexp_extract_all(replace(lower(t), chr(12288), ' '), '[\\x{{3400}}-\\x{{9fff}}]|[a-z0-9_./-]+'))) AS h FROM {table}"
    each = f"SELECT {key}, (('0x' || substr(h, i * 2 + 1, 4))::INT % 128) AS slot, CASE WHEN ('0x' || substr(h, i * 2 + 5, 2))::INT % 2 = 1 THEN 1 ELSE -1 END AS s FROM ({digest}), (SELECT unnest(generate_series(0, 7)) AS i)"
    summed = f"SELECT {key}, slot, sum(s)::BIGINT AS s FROM ({each}) GROUP BY ALL"
    return f"SELECT {key}, slot, round(s / sqrt(sum(s * s) OVER (PARTITION BY {key})), 8) AS w FROM ({summed})"


ORACLES = {
    "graph_levels": "SELECT vec_id, least(16, floor(-ln((('0x' || substr(sha256(vec_id::VARCHAR), 1, 16))::UBIGINT::DOUBLE + 1) / 18446744073709551617.0::DOUBLE) / ln(12.0::DOUBLE)))::INT AS level FROM embeddings",
    "email_spans": f"WITH {_D} {_spans(_EMAIL)}",
    "sensitive_spans": f"WITH {_D} SELECT 'email' AS kind, *, '[EMAIL]' AS replacement FROM ({_spans(_EMAIL)}) UNION ALL SELECT 'credential', *, '[CREDENTIAL]' FROM ({_spans(T.wide(T.CREDENTIAL))})",
    "default_split": f"WITH {_D} SELECT doc_id, md5(substr(t, 1, length(t) // 2)) AS first_md5, md5(substr(t, length(t) // 2 + 1)) AS second_md5 FROM d WHERE length(t) >= 2",
    "conversation_chapters": r"SELECT conv_id, count(*)::INT AS n, md5(string_agg(title, '|' ORDER BY turn, title)) AS titles_md5 FROM (SELECT conv_id, turn, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 120) AS title FROM conversations) GROUP BY 1",
    "source_tree": "SELECT source, sum(n)::BIGINT AS n, string_agg(concat_ws(':', lang, n::VARCHAR), ',' ORDER BY lang NULLS FIRST) AS children FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1",
    "chunk_stats": "SELECT count(*) AS total, count(*) FILTER (WHERE len(embedding) > 0 AND NOT x) AS vectorised, count(*) FILTER (WHERE NOT coalesce(len(embedding) > 0, false) AND NOT x) AS pending, count(*) FILTER (WHERE x) AS disabled FROM (SELECT embedding, coalesce(toxic = 1, false) AS x FROM documents d LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id)",
    "default_choice": "SELECT o_custkey, o_orderkey, status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE status WHEN 'available' THEN 0 WHEN 'unverified' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS n FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'available' WHEN 'P' THEN 'unverified' ELSE 'failed' END AS status FROM orders)) WHERE n = 1",
    "signed_requests": rf"SELECT event_id, sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(concat_ws(chr(10), 'POST', '/' || event_type, floor(epoch(ts))::BIGINT::VARCHAR, event_id::VARCHAR, 'https://example.org', sha256(coalesce(props, ''))))))) AS signature FROM events",
    "citation_open": "SELECT item_id, source, CASE WHEN item_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'open' ELSE 'gone' END AS state FROM benchmark LEFT JOIN documents ON doc_id = item_id",
    "trace_drafts": "SELECT user_id, event_type, event_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id))::INT AS version, event_id = max(event_id) OVER (PARTITION BY user_id, event_type) AS current FROM events",
    "replay_requests": "SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN event_type = first_value(event_type) OVER w THEN 'reused' ELSE 'conflict' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)",
    "document_scatter": f"WITH b AS (SELECT item_id, coalesce(text, '') AS t FROM benchmark), a AS (SELECT * FROM (VALUES (0, 'projection axis x'), (1, 'projection axis y')) v(axis, t)), bs AS ({_slots('b', 'item_id')}), ax AS ({_slots('a', 'axis')}) SELECT b.item_id, round(coalesce(sum(CASE WHEN axis = 0 THEN bs.w * ax.w END), 0), 6) + 0.0::DOUBLE AS x, round(coalesce(sum(CASE WHEN axis = 1 THEN bs.w * ax.w END), 0), 6) + 0.0::DOUBLE AS y FROM b LEFT JOIN bs ON bs.item_id = b.item_id LEFT JOIN ax ON ax.slot = bs.slot GROUP BY 1",
    "task_list": "SELECT o_orderkey, n_name, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, n_lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey",
    "part_suppliers": "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1",
}
