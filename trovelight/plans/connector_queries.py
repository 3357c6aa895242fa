"""Queries of databases read as sources and of releases published to shared storage, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.plans.tables import read
from trovelight.sources import releases, sqlite, store


def sqlite_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as SQLite shards and read back: four columns of the rows that the databases find, summed."""
    path = f"{store.shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    sqlite.write(read(spark, sf_dir, "orders"), path, "orders")
    where = [("o_orderpriority", "in", ["1-URGENT", "2-HIGH", "5-LOW"]), ("o_totalprice", ">=", 50_000.0), ("o_custkey", "<>", 1)]
    found = sqlite.read(spark, path, "orders", "o_custkey bigint, o_totalprice double, o_orderpriority string, o_orderdate timestamp_ntz", where, timeout_ms=30_000)
    price = F.col("o_totalprice")
    return found.groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"), F.sum(F.round(price * 100).cast("long")).alias("cents"), F.max("o_orderdate").cast("string").alias("last")
    )


def release_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks published twice: the second time the German ones are revised and those of the first source by name are deleted; rows of the release that is active at the end."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    log = releases.ReleaseLog(spark, f"{store.shared_dir(spark)}/published-{uuid.uuid4().hex}")
    document = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    empty = F.col("text") == ""

    def build(text, revision: int, status) -> None:
        chunks = docs.select(F.col("doc_id").alias("chunk_id"), document.alias("document"), F.lit(revision).alias("revision"), F.sha2("text", 256).alias("artifact"), text.alias("content"), empty.alias("excluded"))
        log.build("documents", chunks, docs.select(document.alias("document"), status.alias("status")))

    build(F.col("text"), 1, F.lit("ready"))
    gone = docs.agg(F.min("source")).first()[0]
    german = F.coalesce(F.col("lang") == "de", F.lit(False))
    build(F.when(german & ~empty, F.concat("text", F.lit("\nStand 2"))).otherwise(F.col("text")), 2, F.when(F.col("source") == gone, "deleted").otherwise("ready"))
    return log.chunks("documents").select("ordinal", "chunk_id", "document", "reused", "content_sha256")


QUERIES = {f.__name__: f for f in (sqlite_orders, release_publish)}

ORACLES = {
    "sqlite_orders": """SELECT o_orderpriority, year(o_orderdate)::INT AS year, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents,
 strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_totalprice >= 50000 AND o_custkey <> 1 GROUP BY 1, 2""",
    "release_publish": r"""WITH d AS (SELECT doc_id, lang, coalesce(source, 'none') AS source, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, source, CASE WHEN lang = 'de' THEN text || chr(10) || 'Stand 2' ELSE text END AS content FROM d WHERE text <> '' AND source <> (SELECT min(source) FROM d)),
h AS (SELECT doc_id AS chunk_id, source || '/' || doc_id AS document, sha256(content) AS content_sha256 FROM n)
SELECT row_number() OVER (ORDER BY chunk_id, document, content_sha256) AS ordinal, chunk_id, document, content_sha256 IN (SELECT sha256(text) FROM d WHERE text <> '') AS reused, content_sha256 FROM h""",
}
