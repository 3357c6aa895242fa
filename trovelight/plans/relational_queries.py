"""Lifecycle, analytics, source and event queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovelight.functions import text as T
from trovelight.functions import vectors as V
from trovelight.operators import lifecycle as L
from trovelight.plans.tables import read
from trovelight.sources import connectors, files
from trovelight.streaming import events as E


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "source", "lang")


def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = files.split_blocks(_docs(spark, sf_dir), "doc_id", "t")
    return b.select("doc_id", "ordinal", "type", F.md5("content_md").alias("content_md5"), "start_line", "end_line")


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.token_estimate(F.col("t")).alias("parser_tokens"), T.token_estimate(F.col("t"), "ceil").alias("revision_tokens"))


def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", F.explode(T.scan_sensitive(F.col("t"))).alias("f"))
    return found.groupBy("doc_id", F.col("f.kind").alias("kind")).agg(F.count("*").alias("n"), F.min("f.value").alias("least"))


def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.md5(T.mask_sensitive(F.col("t"))).alias("masked_md5"), (T.mask_sensitive(F.col("t")) != F.col("t")).alias("changed"))


def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2("t", 256)
    return _docs(spark, sf_dir).groupBy(sha.alias("sha256")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return L.latest(c, ["conv_id", "role"], F.desc("turn"), F.desc("text")).select("conv_id", "role", "turn", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def revision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = read(spark, sf_dir, "conversations").withColumn("revision", F.row_number().over(w))
    return c.select("conv_id", "revision", "turn", F.lag("turn").over(w).alias("supersedes"), (F.length(F.coalesce("text", F.lit(""))) - F.lag(F.length(F.coalesce("text", F.lit("")))).over(w)).alias("grown"))


def _gated(spark, sf_dir):
    """Documents whose label, if there is one, is of quality 1."""
    return _docs(spark, sf_dir).join(read(spark, sf_dir, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_anti")


def release_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.release_snapshot(_gated(spark, sf_dir), "source", ["lang", "doc_id"])
    return s.select("source", "doc_id", "ordinal")


def release_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = L.fingerprint(_gated(spark, sf_dir), ["source"], "doc_id", "t", "cfg1")
    return f.withColumn("release_id", L.release_id(F.concat_ws(":", "source", "content_hash")))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "labels")
    state = F.when(F.col("quality") == 0, "review_required").when(F.col("toxic") == 1, "quarantined").otherwise("ready")
    return L.quality_gate(l.select(state.alias("status")))


def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    return c.withColumn("n", F.row_number().over(w)).filter("n <= 6").select("conv_id", "turn", "role", F.substring(F.coalesce("text", F.lit("")), 1, 800).alias("excerpt"), "n")


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events")


def trace_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", "event_id", F.when(F.col("event_id") % 97 != 0, F.round(F.col("value") * 10).cast("long")).alias("duration_ms"))
    return L.waterfall(e, "user_id", "event_id", "duration_ms")


def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain per user over the events, hashed event by event, of which some rows were tampered with afterwards."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("workspaceId"), F.col("event_id").alias("eventId"), F.col("event_type").alias("action"), F.coalesce("props", F.lit("{}")).alias("details"))
    chained = L.append_events(e.limit(0).select("*", F.lit("").alias("previous_hash"), F.lit("").alias("event_hash")), e, "workspaceId", "eventId", L.AUDIT_JSON)
    changed = chained.withColumn("action", F.when(F.col("eventId") % 501 == 0, "changed").otherwise(F.col("action")))
    changed = changed.filter(F.col("eventId") % 997 != 5)
    found = L.verify_chain(changed, "workspaceId", "eventId", L.AUDIT_JSON)
    return found.select(F.col("workspaceId").alias("user_id"), "n_events", "n_broken", "first_broken", "reason")


def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    s = F.col("o_orderstatus")
    return o.agg(F.count("*").alias("total"), F.count_if(s == "F").alias("done"), F.count_if(s.isin("O", "P")).alias("pending"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"))


def status_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.counts_by(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


def request_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    day = F.to_date("ts")
    last = e.agg(F.max(day).alias("last"))
    rows = e.withColumn("day", day).crossJoin(F.broadcast(last)).filter(F.col("day") >= F.date_sub("last", 6))
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


def minute_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling_counts(_events(spark, sf_dir), "ts", "1 minute").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "n")


def pipeline_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    rows = e.agg(*[F.count_if(F.col("value") >= t).alias(f"p{t}") for t in (25, 55, 95, 100)])
    return rows.unpivot([], ["p25", "p55", "p95", "p100"], "stage", "n")


def impact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    per = o.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").fillna(0, ["n_orders", "n_lines"])


def parent_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region"))
    out = L.child_counts(n, "nation", {"customers": read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation"), "suppliers": read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation")})
    return out.join(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), "r_name"), "region").select("n_name", "r_name", "customers", "suppliers")


def global_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"), ("document", "doc_id", "source")]
    hits = None
    for i, (t, key, name) in enumerate(each):
        one = read(spark, sf_dir, "documents" if t == "document" else t).filter(L.like_any([name], "a%1")).select(F.lit(i).alias("source_order"), F.lit(t).alias("kind"), F.col(key).cast("long").alias("id"), F.col(name).alias("title"))
        hits = one if hits is None else hits.unionByName(one)
    return hits.orderBy("source_order", "id").limit(50)


def star_join_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 200000)
    c = read(spark, sf_dir, "customer")
    n = F.broadcast(read(spark, sf_dir, "nation"))  # 25 rows at every scale
    r = F.broadcast(read(spark, sf_dir, "region"))  # 5 rows at every scale
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select("o_orderkey", "c_name", "n_name", "r_name", F.round("o_totalprice", 2).alias("o_totalprice"))


def left_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels")
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.md5("text").alias("item_md5"))
    return d.join(l, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", "source", "quality", "toxic", "item_md5")


def paged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").filter(L.conjunction([F.col("o_orderstatus") == "O", None, F.col("o_totalprice") >= 1000]))
    return L.page(o.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price")), [F.desc("price"), F.col("o_orderkey")], 25, 50)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))
    return L.upsert_latest(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "labels").select("doc_id", "quality")
    seeds = read(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return L.insert_or_ignore(l, seeds, ["doc_id"])


def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.next_version(read(spark, sf_dir, "conversations"), ["conv_id"], "turn")


def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("y"))
    a, b = o.filter("y = 1995").select("custkey").distinct(), o.filter("y = 1996").select("custkey").distinct()
    return L.compare_candidates(a, b, ["custkey"])


def compare_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).groupBy((F.col("user_id") % 2).alias("side"), F.col("event_type").alias("name")).agg(F.min("event_id").alias("position"), F.sum(F.round(F.col("value") * 10).cast("long")).alias("duration_ms")).withColumn("status", F.when(F.col("duration_ms") > 1000, "succeeded").otherwise("degraded"))
    return L.compare_stages(e.filter("side = 0").drop("side"), e.filter("side = 1").drop("side"))


def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct().withColumn("relation_type", F.lit("supplied_by"))
    few = read(spark, sf_dir, "part").filter("p_size = 7").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"))
    more = read(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"))
    return L.neighbours(edges, few.unionByName(more))


def graph_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1).alias("dst"), F.when(F.col("o_orderkey") % 3 == 0, "uses").otherwise("unknown").alias("relation_type"), (F.col("o_custkey") % 4).alias("dataset_id"))
    ent = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") % 4).alias("dataset_id"))
    ent = ent.unionByName(ent.select("entity_id", ((F.col("dataset_id") + 3) % 4).alias("dataset_id")))
    return L.valid_relations(rel, ent, ["uses"]).select("id", "src", "dst", "dataset_id")


def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/+$", "")
    parts = read(spark, sf_dir, "pages").select(F.split(path, "/").alias("p"))
    folders = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", 1, i), "/"))).alias("folder"))
    rows = folders.groupBy("folder").agg(F.count("*").alias("n_pages"))
    return rows.select("folder", F.regexp_replace("folder", "/?[^/]*$", "").alias("parent"), F.size(F.split("folder", "/")).alias("depth"), "n_pages")


TEMPLATE = connectors.Template("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity >= ? AND l_discount <= ? GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus;", row_limit=100)


def query_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return connectors.execute(spark, TEMPLATE, [10.0, 0.05])


def schema_introspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    return connectors.introspect(spark, {n: read(spark, sf_dir, n) for n in names})


def snapshot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")  # 25 rows at every scale
    return connectors.snapshot_lines(n, ["n_nationkey"])


def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.rate_limits(_events(spark, sf_dir), "user_id", "ts", 2, "1 hour", "15 minutes")
    return out.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "limited")


def nonce_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("ts", "event_id", "user_id", F.get_json_object("props", "$.k").alias("nonce"))
    return E.first_nonces(e, ["user_id", "nonce"], "ts").select("user_id", "nonce", "event_id")


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    noon = F.date_trunc("day", "ts") + F.expr("INTERVAL 12 HOURS")
    return E.timely(e.withColumn("now", noon), "ts", F.col("now"), 30).groupBy("event_type").agg(F.count("*").alias("n"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.sessions(_events(spark, sf_dir), "user_id", "ts", "6 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def task_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ["queued", "running", "paused", "succeeded", "failed"])), (F.col("event_id") % 5 + 1).cast("int"))
    e = _events(spark, sf_dir).select("user_id", "event_id", state.alias("state"))
    return L.fold_tasks(e, "user_id", [F.desc("event_id")], "state")


def json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter(F.get_json_object("props", "$.k") == "7")
    return e.select("event_id", T.stable_json(F.col("props")).alias("props"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.md5(T.collapse(F.col("t"))).alias("collapsed"), F.size(T.entities(F.col("t"))).alias("n_entities"), T.human_size(F.length("t").cast("long") * 1024).alias("size"), F.md5(T.csv_cell(F.col("t"))).alias("cell"), F.md5(T.redact(F.col("t"))).alias("redacted"))


def url_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").groupBy(T.origin(F.col("url")).alias("origin")).agg(F.count("*").alias("n"))


def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = [1.0 if i % 2 else -1.0 for i in range(64)], [1.0 if i % 3 else 0.5 for i in range(64)]
    p = V.project(F.col("embedding"), first, second)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


def storage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2("t", 256)
    blobs = _docs(spark, sf_dir).select("source", sha.alias("sha256"), F.octet_length("t").cast("long").alias("size")).dropDuplicates(["source", "sha256"])
    return blobs.groupBy("source").agg(F.count("*").alias("n_blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


QUERIES = {f.__name__: f for f in (
    split_blocks, token_estimate, pii_scan, pii_mask, content_dedupe, latest_revision, revision_history, release_snapshot, release_fingerprint, quality_gate, conversation_context, trace_waterfall,
    audit_chain_verify, dashboard_counts, status_groupby, request_trend, minute_throughput, pipeline_thresholds, impact_counts, parent_child_counts, global_search, star_join_list, left_chain, paged_list,
    upsert_latest, insert_or_ignore, next_version, set_diff, compare_stages, graph_neighbors, graph_validate, folder_tree, query_template, schema_introspect, snapshot_export, rate_limit_windows, nonce_dedupe,
    late_events, user_sessions, task_state_fold, json_predicate, text_functions, url_origins, embedding_norms, storage_totals,
)}

_D = "d AS (SELECT doc_id, coalesce(text, '') AS t, source, lang FROM documents)"
_G = "g AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0))"
_EMAIL, _CRED, _SECRET, _CONNECTION = (T.wide(p) for p in (T.EMAIL, T.CREDENTIAL, T.SECRET_VALUE, T.CONNECTION))
#: RE2 has no lookaround: a mobile number is a whole run of eleven digits.
_PHONE = "list_filter(regexp_extract_all(t, '[0-9]+'), lambda x: regexp_full_match(x, '1[3-9][0-9]{9}'))"
ORACLES = {
    "schema_introspect": """SELECT table_name, column_name, (ordinal_position - 1)::INT AS position, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date' ELSE data_type END AS type, true AS nullable
 FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')""",
    "split_blocks": rf"""WITH {_D}, l AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d), x AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, len(ls) AS n, ls FROM l),
 y AS (SELECT doc_id, i, n, ls[i] AS line, trim(regexp_replace(ls[i], '\s', ' ', 'g')) = '' AS blank FROM x), z AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM y),
 b AS (SELECT doc_id, min(i) AS a, max(i) AS b, max(n) AS n, string_agg(line, chr(10) ORDER BY i) AS c FROM z WHERE NOT blank GROUP BY doc_id, island)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS ordinal, CASE WHEN regexp_matches(c, '^#{{1,6}}\s') THEN 'heading' WHEN starts_with(c, '```') THEN 'code' ELSE 'paragraph' END AS type, md5(c) AS content_md5, a AS start_line, CASE WHEN b = n THEN b ELSE b + 1 END AS end_line FROM b""",
    "token_estimate": rf"""WITH {_D}, x AS (SELECT doc_id, len(regexp_extract_all(t, '[\x{{3400}}-\x{{9fff}}]'))::DOUBLE * 0.7::DOUBLE + len(regexp_extract_all(t, '[A-Za-z0-9_]+'))::DOUBLE * 1.3::DOUBLE AS v FROM d)
 SELECT doc_id, greatest(1, trunc(v + 0.999999::DOUBLE)::BIGINT) AS parser_tokens, greatest(1, ceil(v)::BIGINT) AS revision_tokens FROM x""",
    "pii_scan": rf"""WITH {_D}, f AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(t, '{_EMAIL}')) AS v FROM d UNION ALL SELECT doc_id, 'phone', unnest({_PHONE}) FROM d UNION ALL SELECT doc_id, 'credential', unnest(regexp_extract_all(t, '{_CRED}')) FROM d)
 SELECT doc_id, kind, count(*) AS n, min(v) AS least FROM f GROUP BY ALL""",
    "pii_mask": rf"""WITH {_D}, m AS (SELECT doc_id, t, regexp_replace(regexp_replace(regexp_replace(t, '{_EMAIL}', '[EMAIL]', 'g'), '(^|[^0-9])1[3-9][0-9]{{9}}([^0-9]|$)', '\1[PHONE]\2', 'g'), '{_CRED}', '[CREDENTIAL]', 'g') AS m FROM d) SELECT doc_id, md5(m) AS masked_md5, m <> t AS changed FROM m""",
    "content_dedupe": f"WITH {_D} SELECT sha256(t) AS sha256, min(doc_id) AS first_doc, count(*) AS copies FROM d GROUP BY 1",
    "latest_revision": "SELECT conv_id, role, turn, md5(coalesce(text, '')) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS n FROM conversations) WHERE n = 1",
    "revision_history": "SELECT conv_id, row_number() OVER w AS revision, turn, lag(turn) OVER w AS supersedes, length(coalesce(text, '')) - lag(length(coalesce(text, ''))) OVER w AS grown FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)",
    "release_snapshot": f"WITH {_D}, {_G} SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS ordinal FROM g",
    "release_fingerprint": f"WITH {_D}, {_G}, f AS (SELECT source, sha256(string_agg(doc_id::VARCHAR || ':' || sha256(t), '|' ORDER BY doc_id) || '|cfg1') AS content_hash, count(*) AS n_chunks FROM g GROUP BY 1) SELECT *, 'rel_' || substr(sha256(source || ':' || content_hash), 1, 32) AS release_id FROM f",
    "quality_gate": "SELECT status, count(*) AS n FROM (SELECT CASE WHEN quality = 0 THEN 'review_required' WHEN toxic = 1 THEN 'quarantined' ELSE 'ready' END AS status FROM labels) WHERE status <> 'ready' GROUP BY 1",
    "conversation_context": "SELECT conv_id, turn, role, substr(coalesce(text, ''), 1, 800) AS excerpt, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations) WHERE n <= 6",
    "trace_waterfall": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 97 <> 0 THEN round(value * 10)::BIGINT END AS duration_ms FROM events), s AS (SELECT *, CASE WHEN coalesce(count_if(duration_ms IS NULL) OVER w, 0) = 0 THEN coalesce(sum(duration_ms) OVER w, 0)::BIGINT END AS start_ms FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT user_id, event_id, duration_ms, start_ms, start_ms + duration_ms AS end_ms FROM s""",
    "audit_chain_verify": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS a, coalesce(props, '{}') AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 c AS (SELECT user_id, event_id, a, p, n, 'GENESIS' AS prev, sha256('{"eventId":' || event_id || ',"workspaceId":' || user_id || ',"action":' || to_json(a)::VARCHAR || ',"details":' || p || ',"previous":"GENESIS"}') AS h FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.a, e.p, e.n, c.h, sha256('{"eventId":' || e.event_id || ',"workspaceId":' || e.user_id || ',"action":' || to_json(e.a)::VARCHAR || ',"details":' || e.p || ',"previous":"' || c.h || '"}') FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1),
 t AS (SELECT *, lag(h, 1, 'GENESIS') OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM c WHERE event_id % 997 <> 5),
 j AS (SELECT *, CASE WHEN prev <> before THEN 'previous_hash mismatch' WHEN event_id % 501 = 0 THEN 'event_hash mismatch' END AS reason FROM t)
 SELECT user_id, count(*) AS n_events, count(reason) AS n_broken, min(CASE WHEN reason IS NOT NULL THEN event_id END) AS first_broken, arg_min(reason, event_id) AS reason FROM j GROUP BY 1""",
    "dashboard_counts": "SELECT count(*) AS total, count_if(o_orderstatus = 'F')::BIGINT AS done, count_if(o_orderstatus IN ('O', 'P'))::BIGINT AS pending, count_if(o_totalprice > 100000)::BIGINT AS large, count_if(starts_with(o_orderpriority, '1'))::BIGINT AS urgent FROM orders",
    "status_groupby": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "request_trend": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts::DATE >= (SELECT max(ts::DATE) FROM events) - 6 GROUP BY ALL",
    "minute_throughput": "SELECT strftime(time_bucket(INTERVAL 1 MINUTE, ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events GROUP BY 1",
    "pipeline_thresholds": " UNION ALL ".join(f"SELECT 'p{t}' AS stage, count_if(value >= {t})::BIGINT AS n FROM events" for t in (25, 55, 95, 100)),
    "impact_counts": "WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT o_custkey, count(*) AS n_orders, coalesce(sum(n), 0)::BIGINT AS n_lines FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines FROM customer LEFT JOIN p ON o_custkey = c_custkey",
    "parent_child_counts": "SELECT n_name, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey",
    "global_search": """SELECT * FROM (SELECT 0 AS source_order, 'customer' AS kind, c_custkey AS id, c_name AS title FROM customer WHERE c_name ILIKE '%a%1%' UNION ALL SELECT 1, 'supplier', s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%a%1%'
 UNION ALL SELECT 2, 'part', p_partkey, p_name FROM part WHERE p_name ILIKE '%a%1%' UNION ALL SELECT 3, 'nation', n_nationkey, n_name FROM nation WHERE n_name ILIKE '%a%1%' UNION ALL SELECT 4, 'region', r_regionkey, r_name FROM region WHERE r_name ILIKE '%a%1%'
 UNION ALL SELECT 5, 'document', doc_id, source FROM documents WHERE source ILIKE '%a%1%') ORDER BY source_order, id LIMIT 50""",
    "star_join_list": "SELECT o_orderkey, c_name, n_name, r_name, round(o_totalprice, 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 200000",
    "left_chain": "SELECT d.doc_id, source, quality, toxic, md5(b.text) AS item_md5 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id",
    "paged_list": "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 ORDER BY price DESC, o_orderkey LIMIT 25 OFFSET 50",
    "upsert_latest": "SELECT user_id, event_type, event_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "insert_or_ignore": "SELECT doc_id, quality FROM labels UNION ALL SELECT DISTINCT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "next_version": "SELECT conv_id, coalesce(max(turn), 0) + 1 AS next_version FROM conversations GROUP BY 1",
    "set_diff": "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1995), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996) SELECT coalesce(a.k, b.k) AS custkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'common' END AS change FROM a FULL JOIN b ON a.k = b.k",
    "compare_stages": """WITH e AS (SELECT user_id % 2 AS side, event_type AS name, min(event_id) AS position, sum(round(value * 10)::BIGINT)::BIGINT AS d FROM events GROUP BY ALL), s AS (SELECT *, CASE WHEN d > 1000 THEN 'succeeded' ELSE 'degraded' END AS status FROM e)
 SELECT coalesce(a.name, b.name) AS name, coalesce(a.position, b.position + 1000) AS position, a.status AS left_status, b.status AS right_status, coalesce(b.d, 0) - coalesce(a.d, 0) AS delta_ms FROM (SELECT * FROM s WHERE side = 0) a FULL JOIN (SELECT * FROM s WHERE side = 1) b ON a.name = b.name""",
    "graph_neighbors": """WITH e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), n AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size = 7 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey = 3)
 SELECT id AS entity_id, 'out' AS direction, 'supplied_by' AS relation_type, dst AS other_id FROM n JOIN e ON src = id UNION ALL SELECT id, 'in', 'supplied_by', src FROM n JOIN e ON dst = id""",
    "graph_validate": """WITH ent AS (SELECT c_custkey AS e, c_custkey % 4 AS d FROM customer UNION ALL SELECT c_custkey, (c_custkey % 4 + 3) % 4 FROM customer) SELECT o_orderkey AS id, o_custkey AS src, o_custkey + 1 AS dst, o_custkey % 4 AS dataset_id FROM orders o
 WHERE o_orderkey % 3 = 0 AND EXISTS (SELECT 1 FROM ent WHERE e = o.o_custkey AND d = o.o_custkey % 4) AND EXISTS (SELECT 1 FROM ent WHERE e = o.o_custkey + 1 AND d = o.o_custkey % 4)""",
    "folder_tree": r"""WITH p AS (SELECT string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', ''), '/') AS p FROM pages), f AS (SELECT array_to_string(p[1:i], '/') AS folder FROM (SELECT p, unnest(generate_series(1, len(p))) AS i FROM p))
 SELECT folder, regexp_replace(folder, '/?[^/]*$', '') AS parent, len(string_split(folder, '/')) AS depth, count(*) AS n_pages FROM f GROUP BY ALL""",
    "query_template": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity >= 10.0 AND l_discount <= 0.05 GROUP BY ALL",
    "snapshot_export": "SELECT row_number() OVER (ORDER BY n_nationkey) AS line_no, concat_ws(',', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR) AS line, sha256(concat_ws(',', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR)) AS sha256 FROM nation",
    "rate_limit_windows": "SELECT user_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count(*) > 2 AS limited FROM (SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS w FROM events, (SELECT unnest(generate_series(0, 3)) AS k)) GROUP BY user_id, w",
    "nonce_dedupe": "SELECT user_id, nonce, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, nonce ORDER BY ts, event_id) AS n FROM (SELECT *, json_extract_string(props, '$.k') AS nonce FROM events)) WHERE n = 1",
    "late_events": "SELECT event_type, count(*) AS n FROM events WHERE abs(epoch_us(ts) - epoch_us(date_trunc('day', ts) + INTERVAL 12 HOUR)) <= 30 * 60000000 GROUP BY 1",
    "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
 SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1""",
    "task_state_fold": "SELECT user_id, event_id, state, n_events, state IN ('succeeded', 'partial', 'failed', 'cancelled') AS ended FROM (SELECT user_id, event_id, ['queued', 'running', 'paused', 'succeeded', 'failed'][event_id % 5 + 1] AS state, count(*) OVER (PARTITION BY user_id) AS n_events, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "json_predicate": "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS props FROM events WHERE json_extract_string(props, '$.k') = '7'",
    "text_functions": rf"""WITH {_D}, c AS (SELECT *, trim(regexp_replace(t, '\s+', ' ', 'g')) AS c, t AS s FROM d)
 SELECT doc_id, md5(c) AS collapsed, least(12, len(list_distinct(regexp_extract_all(t, '[A-Za-z]+[-_.]?[A-Za-z0-9]*|[\x{{4e00}}-\x{{9fff}}]{{2,8}}'))))::INT AS n_entities, CASE WHEN length(t) < 1024 THEN printf('%.2f KB', length(t)::DOUBLE) ELSE printf('%.2f MB', length(t) / 1024.0::DOUBLE) END AS size,
 md5(CASE WHEN regexp_matches(s, '[",\r\n]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END) AS cell, md5(regexp_replace(regexp_replace(t, '{_SECRET}', '\1=[REDACTED]', 'g'), '{_CONNECTION}', '[REDACTED_CONNECTION]', 'g')) AS redacted FROM c""",
    "url_origins": "SELECT lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin, count(*) AS n FROM pages GROUP BY 1",
    "embedding_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * CASE WHEN (i - 1) % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE)), 6) AS x, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * CASE WHEN (i - 1) % 3 <> 0 THEN 1.0 ELSE 0.5 END::DOUBLE)), 6) AS y FROM embeddings",
    "storage_totals": f"WITH {_D} SELECT source, count(*) AS n_blobs, sum(size)::BIGINT AS bytes FROM (SELECT DISTINCT source, sha256(t), octet_length(encode(t)) AS size FROM d) GROUP BY 1",
}
