"""Queries of split and merged revisions, idempotent requests, backups and locators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.functions import text as T
from trovelight.operators import lifecycle as L
from trovelight.plans.tables import read
from trovelight.sources import files


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("logical_id"), F.lit(1).cast("long").alias("revision_number"), F.coalesce("text", F.lit("")).alias("content"), F.lit(False).alias("excluded"))


def _digest(revisions: DataFrame) -> DataFrame:
    return revisions.select("logical_id", "revision_number", F.sha2("content", 256).alias("content_sha256"), "excluded")


def revision_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document split at its lines: those of 2 to 50 lines end as excluded parents with a child for each line."""
    rows = _revisions(spark, sf_dir)
    parts = F.filter(F.split("content", "\n"), lambda x: x != "")
    return _digest(L.split_revision(rows, rows.select("logical_id", parts.alias("parts"))))


def revision_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents merged by source within each thousand ids, where 2 to 50 come together."""
    d = read(spark, sf_dir, "documents")
    group = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("und")), F.expr("doc_id div 1000").cast("string"))
    return _digest(L.merge_revisions(_revisions(spark, sf_dir), d.select(group.alias("group_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("logical_id"), F.col("doc_id").alias("ordinal"))))


def task_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests of their customers, whose segment says whether a task is known and whose balance whether it failed."""
    c = read(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    tasks = c.select(F.col("c_custkey").alias("idempotency_key"), F.lit("1-URGENT").alias("fingerprint"), F.when(F.col("c_acctbal") < 2_000, "failed").otherwise("succeeded").alias("status"))
    requests = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("idempotency_key"), F.col("o_orderpriority").alias("fingerprint"), F.col("o_orderkey").alias("sequence"))
    return L.create_in_order(tasks, requests)


def backup_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents against a listing in which short ones are missing, French ones changed and pages are not expected."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    changed = F.when(F.col("lang") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    listing = d.filter(F.length("text") >= 100).select("path", F.sha2(changed, 256).alias("sha256"))
    more = read(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))
    return files.verify_manifest(d.select("path", F.sha2("text", 256).alias("sha256")), listing.unionByName(more))


def citation_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cited by page, slide, rows of a sheet, lines or as a whole, by their language and length."""
    n, lang = F.length(F.coalesce("text", F.lit(""))), F.coalesce("lang", F.lit(""))
    place = F.struct(
        F.when(lang == "en", F.expr("n_chars div 1000") + 1).alias("page"), F.when(lang == "de", n % 40).alias("slide"), F.when(lang == "fr", F.col("source")).alias("sheet"),
        F.when(n % 3 > 0, n % 100).alias("start"), F.when(n % 2 > 0, n).alias("end"),
    )
    return read(spark, sf_dir, "documents").select("doc_id", T.locator(place).alias("locator"))


QUERIES = {f.__name__: f for f in (revision_splits, revision_merges, task_requests, backup_verify, citation_locators)}

_D = "d AS (SELECT doc_id, 'doc' || doc_id AS logical_id, coalesce(text, '') AS content, coalesce(source, 'none') || '/' || coalesce(lang, 'und') || '/' || (doc_id // 1000) AS group_id FROM documents)"
_FIRST = "SELECT logical_id, 1::BIGINT AS revision_number, sha256(content) AS content_sha256, false AS excluded FROM d"

ORACLES = {
    "revision_splits": f"""WITH {_D}, p AS (SELECT *, list_filter(string_split(content, chr(10)), lambda x: x <> '') AS parts FROM d), s AS (SELECT * FROM p WHERE len(parts) BETWEEN 2 AND 50),
c AS (SELECT logical_id, unnest(range(len(parts))) AS i, unnest(parts) AS content FROM s)
{_FIRST} UNION ALL SELECT logical_id, 2, sha256(content), true FROM s UNION ALL SELECT 'chk_' || substr(sha256(logical_id || ':' || i || ':' || content), 1, 32), 1, sha256(content), false FROM c""",
    "revision_merges": f"""WITH {_D}, g AS (SELECT group_id, string_agg(content, chr(10) || chr(10) ORDER BY doc_id) AS content FROM d GROUP BY group_id HAVING count(*) BETWEEN 2 AND 50)
{_FIRST} UNION ALL SELECT logical_id, 2, sha256(content), true FROM d WHERE group_id IN (SELECT group_id FROM g)
UNION ALL SELECT 'chk_' || substr(sha256(group_id || ':' || content), 1, 32), 1, sha256(content), false FROM g""",
    "task_requests": """WITH t AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 2000 THEN 'failed' ELSE 'succeeded' END AS status FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
r AS (SELECT o_custkey AS idempotency_key, o_orderpriority AS fingerprint, o_orderkey AS sequence, t.status, t.k IS NOT NULL AS known FROM orders LEFT JOIN t ON k = o_custkey),
w AS (SELECT *, CASE WHEN known THEN '1-URGENT' ELSE first_value(fingerprint) OVER (PARTITION BY idempotency_key ORDER BY sequence) END AS owner, row_number() OVER (PARTITION BY idempotency_key, fingerprint ORDER BY sequence) AS i FROM r)
SELECT idempotency_key, fingerprint, sequence, CASE WHEN fingerprint <> owner THEN 'conflict' WHEN i > 1 THEN 'reused' WHEN NOT known THEN 'created' WHEN status = 'failed' THEN 'requeued' ELSE 'reused' END AS outcome FROM w""",
    "backup_verify": """SELECT 'documents/' || doc_id AS path, CASE WHEN length(coalesce(text, '')) < 100 THEN 'missing' ELSE 'changed' END AS fault FROM documents WHERE length(coalesce(text, '')) < 100 OR lang = 'fr'
UNION ALL SELECT 'pages/' || page_id, 'unexpected' FROM pages""",
    "citation_locators": f"""WITH n AS (SELECT doc_id, coalesce(lang, '') AS lang, source, n_chars, length(coalesce(text, '')) AS n FROM documents),
l AS (SELECT *, CASE WHEN n % 3 > 0 THEN n % 100 END AS a, CASE WHEN n % 2 > 0 THEN n END AS b FROM n)
SELECT doc_id, CASE WHEN lang = 'en' AND n_chars IS NOT NULL THEN '第 ' || (n_chars // 1000 + 1) || ' 页' WHEN lang = 'de' THEN '幻灯片 ' || (n % 40)
 WHEN lang = 'fr' AND source IS NOT NULL THEN source || ' 第 ' || coalesce(a::VARCHAR, '1') || '-' || coalesce(b::VARCHAR, '?') || ' 行'
 WHEN a IS NOT NULL THEN '第 ' || a || '-' || coalesce(b, a) || ' 行' ELSE '{T.WHOLE_DOCUMENT}' END AS locator FROM l""",
}
