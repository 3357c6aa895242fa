"""Queries of releases, sources, traces and versions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.functions import text as T
from trovelight.operators import lifecycle as L
from trovelight.operators import publishing as P
from trovelight.plans import search_queries
from trovelight.plans.tables import read
from trovelight.sources import connectors, files
from trovelight.streaming import events as E


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a state from their labels."""
    bad = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = read(spark, sf_dir, "documents").dropDuplicates(["doc_id"]).join(bad, "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "deleted").when((F.col("quality") == 0) & (F.col("doc_id") % 3 == 0), "review_required").otherwise("ready")
    return d.select(F.col("source").alias("dataset"), F.col("doc_id").alias("document"), status.alias("status"), F.coalesce("text", F.lit("")).alias("content"))


def release_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    chunks = d.select("dataset", F.col("document").alias("chunk_id"), "document", "content", (F.col("document") % 11 == 0).alias("excluded"))
    asked = d.select("dataset").distinct().select(
        "dataset", F.lit(1).alias("version"), (F.length("dataset") % 2 == 0).alias("allow_review"), F.when(F.col("dataset").endswith("3"), "stale").alias("expected_hash")
    )
    return P.build_releases(chunks, d.select("dataset", "document", "status"), asked, "cfg1")


def release_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ["ready", "superseded", "failed", "building"])), (F.col("release") % 4 + 1).cast("int"))
    releases = e.select((F.col("user_id") % 20).alias("dataset"), F.col("user_id").alias("release")).distinct().withColumn("status", status)
    switches = e.filter("event_type = 'purchase'").select((F.col("user_id") % 20).alias("dataset"), F.col("user_id").alias("release"), F.col("event_id").alias("sequence"))
    return P.switch_releases(releases, switches)


def document_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    blocks = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"))
    return P.delete_documents(d.filter("status != 'deleted'").select("document", "status"), d.filter("document % 5 = 0").select("document"), blocks)


def release_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return P.visible_chunks(d.select("dataset", "document"), d.select("document", "status")).groupBy("dataset").agg(F.count("*").alias("in_release"), F.count_if("in_next").alias("in_next"))


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).filter("status != 'deleted'")
    sources = d.groupBy("dataset").agg(F.count("*").alias("n_documents")).select(F.col("dataset").alias("id"), F.col("dataset").alias("name"), F.lit("folder").alias("type"), "dataset", F.lit("ready").alias("status"), "n_documents")
    loose = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("name"), F.when(F.col("page_id") % 2 == 0, "unassigned").otherwise("assigned").alias("status"))
    return P.all_sources(sources, loose).filter(L.like_any(["name", "id"], "1"))


def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter(P.starts_with_any("event_type", ["p", "si"])).groupBy("event_type").agg(F.count("*").alias("n"))


def folder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the language that is null, and of one that is not."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.filter(P.in_folder("lang", F.lit(None).cast("string")) | P.in_folder("lang", F.lit("de")))


def scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("dataset"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 50).alias("override"))
    return e.groupBy(P.widened(e, {"override": "dataset"}).alias("widened")).agg(F.count("*").alias("n"))


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, P.STAGES))
    status = F.when(F.col("value") > 90, "degraded").otherwise("succeeded")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace"), F.element_at(names, (F.col("event_id") % 9 % 8 + 1).cast("int")).alias("stage"), status.alias("status"), F.round(F.col("value") * 10).cast("long").alias("duration_ms"), F.col("event_id").alias("recorded")
    )


def trace_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.transform("stages", lambda x: F.concat_ws(":", x["position"].cast("string"), x["stage"], x["status"], F.coalesce(x["duration_ms"].cast("string"), F.lit("-"))))
    return P.trace_records(_stages(spark, sf_dir).filter("trace % 7 != 0 or stage != 'rerank'")).select("trace", F.array_join(line, " ").alias("stages"))


def stage_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stages(spark, sf_dir)
    drafts = s.filter("recorded % 10 = 0").select("trace", "stage", F.col("recorded").alias("at"), (F.col("recorded") % 4).alias("version"))
    return P.stage_logs(s, drafts).groupBy("trace", "stage", "message").agg(F.count("*").alias("n"), F.max("version").alias("version"))


def stage_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stages(spark, sf_dir).withColumn("output", F.when(F.col("recorded") % 2 == 0, "{}")).withColumn("status", F.when(F.col("recorded") % 5 == 0, "failed").otherwise(F.col("status")))
    return L.inspect_stages(s).groupBy("stage", "provenance").agg(F.count("*").alias("n"))


def trace_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("event_id").alias("trace"), F.when(F.col("event_id") % 3 != 0, F.floor(F.col("event_id") / 2)).alias("parent"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 100).alias("root"))
    return P.lineage(t)


def ontology_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("base"), "event_id", (F.col("event_type") == "signup").alias("published"))
    return P.versions(e, "base", "event_id", "published").select("base", "event_id", "version", "status")


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from answers: the assistant's turns are revisions, those of even turns are published, and the user's turn before is the source."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("body"), F.count("*").alias("n"))
    return P.versions(c.filter("body is not null").withColumn("published", F.col("turn") % 2 == 0), "conv_id", "turn", "published").select("conv_id", "turn", "version", "status", F.md5("body").alias("body_md5"))


def assistant_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("dataset"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 5).alias("version"))
    active = read(spark, sf_dir, "nation").filter("n_regionkey != 2").select(F.col("n_nationkey").alias("dataset"), F.concat(F.lit("rel_"), "n_name").alias("release"))
    return P.publish_assistants(c, active)


def delete_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.conflicts(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def feature_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gated(read(spark, sf_dir, "events"), "event_type", {"view": True, "click": False, "purchase": True}).groupBy("event_type").agg(F.count("*").alias("n"))


def incremental_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.after_watermark(read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), "day", "1997-01-01")


def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", T.iso_millis(F.col("ts")).alias("at"))


def scoped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select(F.col("dataset").alias("workspace_id"), "document", "status", F.when(F.col("document") % 13 == 0, F.lit("2024-01-01")).alias("deleted_at"))
    return L.scoped(d).groupBy("workspace_id").agg(F.count("*").alias("n"))


def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.provenance_faults(read(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "text"])


def clamped_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of pages that orders ask for, kept between 1 and 50."""
    asked = F.floor(F.col("o_totalprice") / 5_000).cast("int") - 10
    return read(spark, sf_dir, "orders").select("o_orderkey", T.clamp(asked, 1, 50).alias("result_limit"))


def parse_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of seven kinds through the parse dispatcher."""
    kinds = F.array(*map(F.lit, ["md", "txt", "pdf", "xyz", "png", "docx", "zip"]))
    d = read(spark, sf_dir, "documents").dropDuplicates(["doc_id"])
    listing = d.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(kinds, (F.col("doc_id") % 7 + 1).cast("int"))).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    results, _ = files.parse(listing)
    return results.select("path", "state", "error", "warning", "n_blocks", "quality_status", "publishable")


def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of orders as files of CSV, a file per customer, read as blocks."""
    o = read(spark, sf_dir, "orders")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(', "")"')), F.col("o_orderstatus"))
    each = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return each.select("o_custkey", F.md5(files.csv_block(F.encode(F.col("t"), "UTF-8"))).alias("block_md5"))


def revision_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits, splits and restored texts of the first turn of each conversation, and what is then the latest."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.min(F.coalesce("text", F.lit(""))).alias("content"))
    base = c.select(F.col("conv_id").cast("string").alias("logical_id"), F.lit(1).cast("long").alias("revision_number"), "content", F.lit(False).alias("excluded"))
    edits = c.filter("conv_id % 2 = 0").select(F.col("conv_id").cast("string").alias("logical_id"), (F.col("conv_id") % 4 / 2 + 1).cast("long").alias("base_revision"), F.lit("edited").alias("content"), (F.col("conv_id") % 3 == 0).alias("excluded"))
    new, refused = L.append_revision(base, edits)
    now = L.latest(new, ["logical_id"], F.desc("revision_number")).select("logical_id", "revision_number", F.md5("content").alias("content_md5"), "excluded")
    return now.join(refused.select("logical_id", "error"), "logical_id", "left")


def vectorised_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("chunk"), F.lit(1).alias("number"), F.coalesce("text", F.lit("")).alias("content"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1.0))).alias("embedding"))
    out = P.vectorise_pending(d, "chunk", "number", "content", "embedding")
    return L.latest(out, ["chunk"], F.desc("number")).groupBy("number").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))


def exact_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.exact_rates(read(spark, sf_dir, "events"), "user_id", "ts", 3, 12 * 3600)
    return out.select("user_id", "event_id", "n_recent", "limited")


def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = search_queries._results(spark, sf_dir)
    return r.select(
        "query_id", F.col("chunk_id").alias("chunk_revision_id"), F.col("chunk_id").alias("document_id"), F.col("chunk_id").alias("document_revision_id"), "title", F.md5("content").alias("content_md5"),
        F.lit(T.WHOLE_DOCUMENT).alias("locator"), "rank", F.col("fusion_score").alias("score"), "fusion_score", F.lit("rel_1").alias("release_id"), "vector_rank", "vector_score", "full_text_rank", "full_text_score", "rerank_score",
    )


def candidate_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as CSV lines: id, title, text, rank and score."""
    r = search_queries._results(spark, sf_dir)
    cells = [F.col("chunk_id").cast("string"), F.coalesce("title", F.lit("")), F.col("content"), F.col("rank").cast("string")]
    return r.select("query_id", "rank", F.md5(F.concat_ws(",", *[T.csv_cell(c) for c in cells])).alias("line_md5"), F.col("fusion_score"))


def counted_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    t = connectors.Template("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = ? ORDER BY o_orderkey", row_limit=3)
    return connectors.execute_counted(spark, t, [1])


def revision_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of all revisions, old ones too, as a rebuild makes them: the breadcrumb is the type alone, at first it is title, type and number."""
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.col("role").alias("breadcrumb"), F.size(T.index_tokens(F.coalesce("text", F.lit("")))).alias("n_tokens"))


QUERIES = {f.__name__: f for f in (
    release_build, release_switch, document_delete, release_visibility, source_union, prefix_filter, folder_filter, scope_check, trace_record, stage_logs, stage_provenance, trace_lineage, ontology_versions,
    wiki_pages, assistant_publish, delete_conflicts, feature_gate, incremental_rows, iso_times, scoped_rows, provenance_check, clamped_limits, parse_states, csv_tables, revision_edits, vectorised_revisions,
    exact_rate_limit, candidate_summary, candidate_export, counted_template, revision_index,
)}

_DOCS = """lb AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
docs AS (SELECT source AS dataset, d.doc_id AS document, CASE WHEN toxic = 1 THEN 'deleted' WHEN quality = 0 AND d.doc_id % 3 = 0 THEN 'review_required' ELSE 'ready' END AS status, coalesce(text, '') AS content FROM documents d LEFT JOIN lb USING (doc_id))"""
_NAMES = "[" + ", ".join(f"'{s}'" for s in P.STAGES) + "]"
_STAGES = f"st AS (SELECT user_id AS trace, {_NAMES}[event_id % 9 % 8 + 1] AS stage, CASE WHEN value > 90 THEN 'degraded' ELSE 'succeeded' END AS status, round(value * 10)::BIGINT AS duration_ms, event_id AS recorded FROM events)"
_VERSIONS = "CASE WHEN NOT published THEN 'draft' WHEN version = max(CASE WHEN published THEN version END) OVER (PARTITION BY k) THEN 'active' ELSE 'superseded' END AS status"
_CELL = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
ORACLES = {
    "release_build": f"""WITH {_DOCS}, pub AS (SELECT dataset, sha256(string_agg(document::VARCHAR || ':' || sha256(content), '|' ORDER BY document) || '|cfg1') AS h, count(*) AS n FROM docs WHERE status <> 'deleted' AND document % 11 <> 0 GROUP BY 1),
 g AS (SELECT dataset, count(*) AS b FROM docs WHERE status = 'review_required' GROUP BY 1),
 r AS (SELECT dataset, 1 AS version, coalesce(n, 0) AS n_chunks, coalesce(b, 0) AS n_blocking, h, CASE WHEN dataset LIKE '%3' THEN 'RELEASE_CONTENT_CHANGED' WHEN coalesce(b, 0) > 0 AND length(dataset) % 2 <> 0 THEN 'RELEASE_QUALITY_BLOCKED' WHEN coalesce(n, 0) = 0 THEN 'NO_PUBLISHABLE_CHUNKS' END AS error
  FROM (SELECT DISTINCT dataset FROM docs) LEFT JOIN pub USING (dataset) LEFT JOIN g USING (dataset))
 SELECT dataset, version, CASE WHEN error IS NULL THEN 'ready' ELSE 'failed' END AS status, error, n_chunks, n_blocking, CASE WHEN error IS NULL THEN h END AS content_hash FROM r""",
    "release_switch": """WITH r AS (SELECT DISTINCT user_id % 20 AS dataset, user_id AS release, ['ready', 'superseded', 'failed', 'building'][user_id % 4 + 1] AS status FROM events),
 s AS (SELECT user_id % 20 AS dataset, user_id AS release, max(event_id) AS last FROM events WHERE event_type = 'purchase' AND user_id % 4 < 2 GROUP BY ALL), a AS (SELECT dataset, arg_max(release, last) AS act FROM s GROUP BY 1)
 SELECT dataset, release, CASE WHEN act IS NULL THEN status WHEN release = act THEN 'active' WHEN s.last IS NOT NULL THEN 'superseded' ELSE status END AS status FROM r LEFT JOIN a USING (dataset) LEFT JOIN s USING (dataset, release)""",
    "document_delete": f"WITH {_DOCS}, c AS (SELECT conv_id AS document, count(*) AS n FROM conversations GROUP BY 1) SELECT document, CASE WHEN document % 5 = 0 THEN 'deleted' ELSE status END AS status, CASE WHEN document % 5 = 0 THEN coalesce(n, 0) END AS n_references FROM docs LEFT JOIN c USING (document) WHERE status <> 'deleted'",
    "release_visibility": f"WITH {_DOCS} SELECT dataset, count(*) AS in_release, count_if(status <> 'deleted')::BIGINT AS in_next FROM docs GROUP BY 1",
    "source_union": f"""WITH {_DOCS}, u AS (SELECT dataset AS id, dataset AS name, 'folder' AS type, dataset, 'ready' AS status, count(*) AS n_documents FROM docs WHERE status <> 'deleted' GROUP BY dataset
 UNION ALL SELECT page_id::VARCHAR, url, 'upload', NULL, 'unassigned', 1 FROM pages WHERE page_id % 2 = 0) SELECT * FROM u WHERE name ILIKE '%1%' OR id ILIKE '%1%'""",
    "prefix_filter": "SELECT event_type, count(*) AS n FROM events WHERE event_type LIKE 'p%' OR event_type LIKE 'si%' GROUP BY 1",
    "folder_filter": "SELECT doc_id, lang FROM documents WHERE lang IS NOT DISTINCT FROM NULL OR lang IS NOT DISTINCT FROM 'de'",
    "scope_check": "SELECT coalesce(CASE WHEN event_id % 3 = 0 THEN event_id % 50 <> user_id END, false) AS widened, count(*) AS n FROM events GROUP BY 1",
    "trace_record": f"""WITH {_STAGES}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace, stage ORDER BY recorded DESC) AS n FROM st WHERE trace % 7 <> 0 OR stage <> 'rerank') WHERE n = 1),
 x AS (SELECT trace, i, {_NAMES}[i] AS stage FROM (SELECT DISTINCT trace FROM l), (SELECT unnest(generate_series(1, 8)) AS i))
 SELECT x.trace, string_agg(concat_ws(':', i::VARCHAR, x.stage, coalesce(status, 'not_recorded'), coalesce(duration_ms::VARCHAR, '-')), ' ' ORDER BY i) AS stages FROM x LEFT JOIN l USING (trace, stage) GROUP BY 1""",
    "stage_logs": f"WITH {_STAGES}, u AS (SELECT trace, stage, 'stage_recorded' AS message, NULL::BIGINT AS version FROM st UNION ALL SELECT trace, stage, 'draft_saved', recorded % 4 FROM st WHERE recorded % 10 = 0) SELECT trace, stage, message, count(*) AS n, max(version) AS version FROM u GROUP BY ALL",
    "stage_provenance": f"WITH {_STAGES} SELECT stage, CASE WHEN recorded % 2 = 0 THEN 'recorded' WHEN recorded % 5 = 0 THEN 'unavailable' ELSE 'reconstructed' END AS provenance, count(*) AS n FROM st GROUP BY ALL",
    "trace_lineage": """WITH t AS (SELECT event_id AS trace, CASE WHEN event_id % 3 <> 0 THEN event_id // 2 END AS parent, CASE WHEN event_id % 3 <> 0 THEN event_id % 100 END AS root FROM events WHERE event_type = 'click')
 SELECT trace, parent, root, CASE WHEN parent IS NULL THEN 'none' WHEN parent IN (SELECT trace FROM t) THEN 'known' ELSE 'gone' END AS parent_state, CASE WHEN root IS NULL THEN 'none' WHEN root IN (SELECT trace FROM t) THEN 'known' ELSE 'gone' END AS root_state FROM t""",
    "ontology_versions": f"SELECT k AS base, event_id, version, {_VERSIONS} FROM (SELECT user_id AS k, event_id, event_type = 'signup' AS published, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events)",
    "wiki_pages": f"SELECT k AS conv_id, turn, version, {_VERSIONS}, md5(body) AS body_md5 FROM (SELECT conv_id AS k, turn, body, turn % 2 = 0 AS published, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version FROM (SELECT conv_id, turn, max(CASE WHEN role = 'assistant' THEN text END) AS body FROM conversations GROUP BY ALL) WHERE body IS NOT NULL)",
    "assistant_publish": "SELECT c_custkey AS id, c_nationkey AS dataset, 'rel_' || n_name AS release, CASE WHEN n_name IS NOT NULL THEN coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 5 END, 0) + 1 END AS version, CASE WHEN n_name IS NOT NULL THEN 'published' ELSE 'ACTIVE_RELEASE_REQUIRED' END AS outcome FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey",
    "delete_conflicts": "SELECT c_custkey, coalesce(n, 0) AS n_dependents, CASE WHEN n > 0 THEN 'DEPENDENCY_CONFLICT' ELSE 'deleted' END AS outcome FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey)",
    "feature_gate": "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1",
    "incremental_rows": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') > '1997-01-01'",
    "iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM events",
    "scoped_rows": f"WITH {_DOCS} SELECT dataset AS workspace_id, count(*) AS n FROM docs WHERE status <> 'deleted' AND document % 13 <> 0 GROUP BY 1",
    "provenance_check": "SELECT count_if(doc_id IS NULL OR source IS NULL OR source = '' OR lang IS NULL OR lang = '' OR text IS NULL OR text = '')::BIGINT AS faults, count(*) AS total FROM documents",
    "clamped_limits": "SELECT o_orderkey, greatest(1, least(50, floor(o_totalprice / 5000)::INT - 10))::INT AS result_limit FROM orders",
    "parse_states": r"""WITH d AS (SELECT doc_id, ['md', 'txt', 'pdf', 'xyz', 'png', 'docx', 'zip'][doc_id % 7 + 1] AS ext, string_split(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), chr(10)) AS ls FROM documents),
 x AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, ls FROM d WHERE ext IN ('md', 'txt')), y AS (SELECT doc_id, i, trim(regexp_replace(ls[i], '\s', ' ', 'g')) = '' AS blank FROM x),
 z AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM y), b AS (SELECT doc_id, count(DISTINCT island) AS n FROM z WHERE NOT blank GROUP BY 1),
 e AS (SELECT doc_id, ext, coalesce(n, 0) AS n, CASE ext WHEN 'pdf' THEN 'MIME_MISMATCH' WHEN 'docx' THEN 'MIME_MISMATCH' WHEN 'xyz' THEN 'UNSUPPORTED_FORMAT' WHEN 'zip' THEN 'ARCHIVE_REQUIRES_IMPORT' END AS error FROM d LEFT JOIN b USING (doc_id))
 SELECT 'in/' || doc_id || '.' || ext AS path, CASE WHEN ext IN ('pdf', 'docx') THEN 'quarantined' WHEN ext = 'xyz' THEN 'unsupported' WHEN ext = 'zip' THEN 'failed' WHEN ext = 'png' THEN 'review_required' ELSE 'ready' END AS state, error, CASE WHEN ext = 'png' THEN 'OCR_PROVIDER_REQUIRED' END AS warning, n AS n_blocks,
 CASE WHEN error IS NULL THEN CASE WHEN ext = 'png' THEN 'review_required' ELSE 'publishable' END END AS quality_status, error IS NULL AND ext <> 'png' AND n > 0 AS publishable FROM e""",
    "csv_tables": """SELECT o_custkey, md5(string_agg(o_orderkey || ' | ' || o_orderpriority || ', ") | ' || o_orderstatus, chr(10) ORDER BY o_orderkey)) AS block_md5 FROM orders GROUP BY 1""",
    "revision_edits": """WITH c AS (SELECT conv_id, min(coalesce(text, '')) AS content FROM conversations GROUP BY 1) SELECT conv_id::VARCHAR AS logical_id, CASE WHEN conv_id % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS revision_number, md5(CASE WHEN conv_id % 4 = 0 THEN 'edited' ELSE content END) AS content_md5,
 conv_id % 4 = 0 AND conv_id % 3 = 0 AS excluded, CASE WHEN conv_id % 4 = 2 THEN 'CHUNK_REVISION_CONFLICT' END AS error FROM c""",
    "vectorised_revisions": "SELECT CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS number, count(*) AS n, min(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 128 END) AS least, max(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 128 END) AS most FROM documents GROUP BY 1",
    "exact_rate_limit": "SELECT user_id, event_id, n_recent, n_recent > 3 AS limited FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 43200 SECOND PRECEDING AND CURRENT ROW) AS n_recent FROM events)",
    "candidate_summary": search_queries._SEARCH + f" SELECT query_id, chunk_id AS chunk_revision_id, chunk_id AS document_id, chunk_id AS document_revision_id, title, md5(r.content) AS content_md5, '{T.WHOLE_DOCUMENT}' AS locator, rank, round(fusion, 8) AS score, round(fusion, 8) AS fusion_score, 'rel_1' AS release_id, vector_rank, round(vector_score, 6) AS vector_score, full_text_rank, round(-bm25, 6) AS full_text_score, lexical AS rerank_score FROM ranked r JOIN chunks USING (chunk_id)",
    "candidate_export": search_queries._SEARCH + f" SELECT query_id, rank, md5(concat_ws(',', chunk_id::VARCHAR, {_CELL.format('''coalesce(title, '')''')}, {_CELL.format('r.content')}, rank::VARCHAR)) AS line_md5, round(fusion, 8) AS fusion_score FROM ranked r JOIN chunks USING (chunk_id)",
    "counted_template": "SELECT o_orderkey, o_custkey, (SELECT count(*) >= 3 FROM (SELECT 1 FROM orders WHERE o_custkey = 1 LIMIT 3)) AS truncated FROM orders WHERE o_custkey = 1 ORDER BY o_orderkey LIMIT 3",
    "revision_index": r"SELECT conv_id, turn, role, role AS breadcrumb, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{Co}]+'))::INT AS n_tokens FROM conversations",
}
