"""Queries of folders, traces and directory imports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.operators import hierarchy as H
from trovelight.plans.tables import read
from trovelight.sources import files

MAX_FILES, MAX_BYTES, MAX_FILE_BYTES = 40, 100_000, 4_000


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/+$", "")
    parts = read(spark, sf_dir, "pages").select(F.split(path, "/").alias("p"))
    node = F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", 1, i), "/")))
    rows = parts.select(node.alias("node")).distinct()
    return rows.select("node", F.when(F.contains(F.col("node"), F.lit("/")), F.regexp_replace("node", "/[^/]*$", "")).alias("parent"), F.regexp_extract("node", "[^/]*$", 0).alias("name"))


def folder_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the pages' addresses after moves: hosts below their own folders (refused), folders below the first host, deeper ones to the top."""
    nodes = _folders(spark, sf_dir)
    depth, n = F.size(F.split("node", "/")), F.length("node")
    first = nodes.agg(F.min("node").alias("first"))  # one row
    asked = nodes.crossJoin(F.broadcast(first)).filter(((depth == 1) & (n % 5 == 0)) | ((depth == 2) & (n % 3 == 0)) | ((depth == 3) & (n % 4 == 0)))
    moves = asked.select("node", F.when(depth == 1, F.concat("node", F.lit("/en"))).when(depth == 2, F.col("first")).alias("target"))
    return H.move(nodes, moves).select(F.col("node").alias("folder"), "outcome", "state", "root", "depth", "path")


def trace_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces that were replayed from a few events before, hundreds deep; stored roots are held against the chain of parents."""
    i = F.col("event_id")
    parent = F.when(i % 97 == 5, -i - 1).when(i % 500 >= 4, i - 1 - i % 3)
    return H.trace_roots(read(spark, sf_dir, "events").select(i.alias("trace"), parent.alias("parent"), F.when(i % 10 != 3, i - i % 500).alias("root")))


def directory_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the directory of their source: which files an import takes, in order of their paths, under budgets of files and bytes."""
    ext = F.element_at(F.array(*map(F.lit, ["md", "txt", "zip", "xyz", "csv"])), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.coalesce("lang", F.lit("und")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    listing = read(spark, sf_dir, "documents").select(F.col("source").alias("root"), path.alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return files.plan_import(listing, ["de/"], MAX_FILES, MAX_BYTES, MAX_FILE_BYTES)


QUERIES = {f.__name__: f for f in (folder_moves, trace_roots, directory_import)}

ORACLES = {
    "folder_moves": r"""WITH RECURSIVE p AS (SELECT DISTINCT string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', ''), '/') AS p FROM pages),
n AS (SELECT DISTINCT array_to_string(p[1 : i], '/') AS node FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p)),
t AS (SELECT node, CASE WHEN contains(node, '/') THEN regexp_replace(node, '/[^/]*$', '') END AS parent, regexp_extract(node, '[^/]*$') AS name, len(string_split(node, '/')) AS d, length(node) AS l FROM n),
m AS (SELECT node, CASE d WHEN 1 THEN node || '/en' WHEN 2 THEN (SELECT min(node) FROM t) END AS target FROM t WHERE (d = 1 AND l % 5 = 0) OR (d = 2 AND l % 3 = 0) OR (d = 3 AND l % 4 = 0)),
k AS (SELECT t.node, t.parent, t.name, m.node IS NOT NULL AS asked, m.target, m.node IS NOT NULL AND (m.target IS NULL OR m.target IN (SELECT node FROM t)) AS goes FROM t LEFT JOIN m USING (node)),
a AS (SELECT node, CASE WHEN goes THEN target ELSE parent END AS parent FROM k),
r AS (SELECT node FROM a WHERE parent IS NULL UNION ALL SELECT a.node FROM r JOIN a ON a.parent = r.node),
o AS (SELECT k.*, CASE WHEN NOT asked THEN 'kept' WHEN NOT goes THEN 'PARENT_NOT_FOUND' WHEN node NOT IN (SELECT node FROM r) THEN 'FOLDER_CYCLE' ELSE 'moved' END AS outcome FROM k),
b AS (SELECT node, name, outcome, CASE WHEN outcome = 'moved' THEN target ELSE parent END AS parent FROM o),
s AS (SELECT node, node AS root, 0::BIGINT AS depth, name AS path FROM b WHERE parent IS NULL UNION ALL SELECT b.node, s.root, s.depth + 1, s.path || '/' || b.name FROM s JOIN b ON b.parent = s.node)
SELECT b.node AS folder, outcome, CASE WHEN s.node IS NULL THEN 'cycle' ELSE 'rooted' END AS state, root, depth, path FROM b LEFT JOIN s USING (node)""",
    "trace_roots": """WITH RECURSIVE e AS (SELECT event_id AS trace, CASE WHEN event_id % 97 = 5 THEN -event_id - 1 WHEN event_id % 500 >= 4 THEN event_id - 1 - event_id % 3 END AS parent,
 CASE WHEN event_id % 10 <> 3 THEN event_id - event_id % 500 ELSE event_id END AS stored FROM events),
s AS (SELECT trace, trace AS found, 0::BIGINT AS depth, parent IS NOT NULL AS gone FROM e WHERE parent IS NULL OR parent NOT IN (SELECT trace FROM e) UNION ALL SELECT e.trace, s.found, s.depth + 1, s.gone FROM s JOIN e ON e.parent = s.trace)
SELECT trace, found, depth, CASE WHEN gone THEN 'parent_gone' WHEN stored = found THEN 'sound' ELSE 'wrong_root' END AS verdict FROM s JOIN e USING (trace)""",
    "directory_import": f"""WITH f AS (SELECT source AS root, coalesce(lang, 'und') || '/' || doc_id || '.' || ['md', 'txt', 'zip', 'xyz', 'csv'][doc_id % 5 + 1] AS path, strlen(coalesce(text, '')) AS size, doc_id FROM documents),
c AS (SELECT *, row_number() OVER w AS position, (sum(size) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS bytes FROM f WHERE NOT contains(lower(path), 'de/') WINDOW w AS (PARTITION BY root ORDER BY path, size)),
t AS (SELECT *, max(CASE WHEN position <= {MAX_FILES} THEN bytes END) OVER (PARTITION BY root) AS total FROM c)
SELECT root, path, size, position, bytes, CASE WHEN position > {MAX_FILES} THEN 'beyond_files' WHEN total > {MAX_BYTES} THEN 'refused' WHEN doc_id % 5 IN (2, 3) THEN 'unsupported' WHEN size > {MAX_FILE_BYTES} THEN 'resource_limit' ELSE 'selected' END AS status FROM t""",
}
