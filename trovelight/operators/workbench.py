"""Chunk workbench, signatures, drafts, requests and graph levels as DataFrame operators."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelight.functions import text as T
from trovelight.functions import vectors as V

#: How task states are shown, and the order in which a default model is chosen.
SHOWN = {"ready": "completed", "queued": "pending"}
PRIORITY = ("available", "unverified")
MAX_LEVEL, DEGREE = 16, 12
AXES = ("projection axis x", "projection axis y")


def shown_status(status: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair])
    return F.coalesce(F.try_element_at(names, status), status)


def graph_level(node: Column, degree: int = DEGREE) -> Column:
    """Layer of a proximity-graph node, from the first 64 bits of its id's SHA-256."""
    uniform = (F.conv(F.substring(F.sha2(node.cast("string"), 256), 1, 16), 16, 10).cast("double") + 1) / float(2**64 + 1)
    return F.least(F.lit(MAX_LEVEL), F.floor(-F.ln(uniform) / F.ln(F.lit(float(degree)))).cast("int"))


KINDS = {"email": (T.EMAIL, "@"), "phone": (T.MOBILE, "1"), "credential": (T.CREDENTIAL, None)}


def sensitive_spans(df: DataFrame, key: str, text: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """key, kind, start, end (code points, 0-based, end excluded), replacement of every find of the given kinds.

    Offsets of finds can't be had from Spark's functions but by work that grows with the square of the finds, so texts are scanned in Arrow batches. A text
    that lacks a character which all finds hold doesn't leave the JVM. Null and empty texts have none; repeated rows are scanned each.
    """
    patterns = {k: re.compile(KINDS[k][0]) for k in kinds}
    needs = [F.contains(F.col(text), F.lit(KINDS[k][1])) if KINDS[k][1] else F.col(text).rlike("[:=]") for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i in range(batch.num_rows):
                t = batch.column(1)[i].as_py()
                for kind, pattern in patterns.items():
                    for m in pattern.finditer(t):
                        at.append(i)
                        found.append((kind, m.start(), m.end()))
            columns = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["key", "kind", "start", "end"])

    rows = df.filter(reduce(lambda a, b: a | b, needs)).select(key, F.col(text).cast("string").alias("t"))
    out = rows.mapInArrow(run, f"key {dict(df.dtypes)[key]}, kind string, start int, end int").withColumnRenamed("key", key)
    return out.withColumn("replacement", F.concat(F.lit("["), F.upper("kind"), F.lit("]")))


def midpoint_parts(text: Column) -> Column:
    """The two halves that a split without a position makes."""
    half = F.greatest(F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    return F.array(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)))


def chapters(chunks: DataFrame, document: str, order: str, content: str, most: int = 120) -> DataFrame:
    """document, chapters: the first lines of a document's chunks in their order."""
    title = F.substring(F.substring_index(F.col(content), "\n", 1), 1, most)
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("ordinal"), title.alias("title"))))
    return chunks.groupBy(document).agg(listed.alias("chapters"))


def grouped_tree(items: DataFrame, kind: str, child: str) -> DataFrame:
    """kind, n, children (value and count): counted per child before the lists are made, so a list has a row per distinct child."""
    counted = items.groupBy(kind, child).agg(F.count("*").alias("n"))
    children = F.sort_array(F.collect_list(F.struct(F.col(child).alias("value"), "n")))
    return counted.groupBy(kind).agg(F.sum("n").alias("n"), children.alias("children"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """total, vectorised, pending, disabled of chunks(embedding, excluded)."""
    ready = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return chunks.agg(
        F.count("*").alias("total"), F.count_if(ready & ~F.col("excluded")).alias("vectorised"),
        F.count_if(~F.coalesce(ready, F.lit(False)) & ~F.col("excluded")).alias("pending"), F.count_if("excluded").alias("disabled"),
    )


def choose_default(models: DataFrame, keys: list[str], status: str, *then: Column) -> DataFrame:
    """One row per key by priority of its status, then by the other columns."""
    order = F.coalesce(*[F.when(F.col(status) == s, i) for i, s in enumerate(PRIORITY)], F.lit(len(PRIORITY)))
    w = Window.partitionBy(*keys).orderBy(order, *then)
    return models.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def canonical_request(method: Column, route: Column, timestamp: Column, nonce: Column, origin: Column, body: Column) -> Column:
    digest = F.sha2(F.coalesce(body, F.lit("")), 256)
    return F.concat_ws("\n", F.upper(method), route, timestamp.cast("string"), nonce, origin, digest)


def hmac_sha256(secret: str | bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex by two nested digests; the padded keys are literals."""
    key = secret.encode() if isinstance(secret, str) else secret
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def open_citations(citations: DataFrame, documents: DataFrame, released: DataFrame) -> DataFrame:
    """citations(doc_id) with their document's columns and ``state``: open, or gone where the release lacks the document."""
    there = released.select("doc_id").distinct().withColumn("_there", F.lit(True))
    rows = citations.join(documents, "doc_id", "left").join(there, "doc_id", "left")
    return rows.withColumn("state", F.when(F.col("_there"), "open").otherwise("gone")).drop("_there")


def draft_versions(drafts: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Drafts numbered per key from 1, with ``current`` at the last."""
    w = Window.partitionBy(*keys)
    rows = drafts.withColumn("version", F.row_number().over(w.orderBy(*order)))
    return rows.withColumn("current", F.col("version") == F.count("*").over(w))


def judge_requests(requests: DataFrame, key: str, fingerprint: str, *order: Column) -> DataFrame:
    """Requests of one idempotency key in their order: created, then reused for the same fingerprint, else conflict."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.first(fingerprint).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outcome = F.when(F.row_number().over(w) == 1, "created").when(F.col(fingerprint).eqNullSafe(first), "reused").otherwise("conflict")
    return requests.withColumn("outcome", outcome)


def axis_scatter(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, x, y: cosines of each text's hash embedding with those of two fixed texts, a labelled linear projection.

    Only the non-zero slots of the axes are looked at, so the join is with a table of at most 256 rows.
    """
    spark = rows.sparkSession
    axes = V.embedding_slots(spark.createDataFrame([(i, t) for i, t in enumerate(AXES)], "axis int, t string"), "axis", "t").withColumnRenamed("weight", "_w")
    hits = V.embedding_slots(rows, key, text).join(F.broadcast(axes), "slot")
    sums = hits.groupBy(key).agg(*[F.sum(F.when(F.col("axis") == i, F.col("weight") * F.col("_w"))).alias(n) for i, n in enumerate("xy")])
    return rows.select(key).join(sums, key, "left").select(key, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in "xy"])


#: Bytes of texts whose differences are worked out at a time.
DIFF_BYTES = 1 << 20


def _diff(before: str | None, after: str | None) -> str:
    return "\n".join(difflib.unified_diff((before or "").splitlines(), (after or "").splitlines(), "before", "after", lineterm=""))


def _diffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, before, after) as batches of (id, diff), each of the rows that begin within DIFF_BYTES of texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // DIFF_BYTES, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            part = batch.slice(a, b - a)
            found = [_diff(x.as_py(), y.as_py()) for x, y in zip(part.column(1), part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], ["id", "diff"])


def unified_diffs(pairs: DataFrame) -> DataFrame:
    """id, diff of pairs(id, before, after): unified diff lines; nulls count as empty. A task holds the differences of DIFF_BYTES of texts, not those of a whole batch."""
    return pairs.select(F.col("id").cast("long").alias("id"), F.col("before").cast("string").alias("before"), F.col("after").cast("string").alias("after")).mapInArrow(_diffs, "id long, diff string")
