"""Revisions, releases, upserts, traces, audit chains, tasks and graphs as DataFrame operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelight.operators import hierarchy

# --- filters and lists -------------------------------------------------------------------------------------------------


def conjunction(clauses: list[Column | None]) -> Column:
    """AND of the clauses that are given; true without any."""
    return reduce(lambda a, b: a & b, [c for c in clauses if c is not None], F.lit(True))


def scoped(df: DataFrame, workspace: str | None = None) -> DataFrame:
    """Rows of a workspace that aren't deleted, by whichever of the columns the table has."""
    return df.filter(conjunction([
        F.col("workspace_id") == workspace if workspace is not None and "workspace_id" in df.columns else None,
        F.col("status") != "deleted" if "status" in df.columns else None,
        F.col("deleted_at").isNull() if "deleted_at" in df.columns else None,
    ]))


def like_any(columns: list[str], q: str) -> Column:
    """Case-insensitive %q% over several columns; % and _ in q keep their meaning."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{q}%") for c in columns])


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a list, with ``total`` rows; bounds 1..500 and 0..1000000."""
    limit, offset = max(1, min(500, limit)), max(0, min(1_000_000, offset))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


# --- revisions ---------------------------------------------------------------------------------------------------------


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key. Apply before other filters, else an excluded row's predecessor comes back."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def append_revision(revisions: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revisions with accepted edits appended, rejected edits).

    ``edits(logical_id, base_revision, content, excluded)``; an edit whose base isn't the latest revision is a conflict.
    """
    now = latest(revisions, ["logical_id"], F.desc("revision_number")).select("logical_id", F.col("revision_number").alias("_latest"))
    judged = edits.join(now, "logical_id", "left")
    good = judged.filter(F.col("_latest") == F.col("base_revision"))
    bad = judged.filter(~F.coalesce(F.col("_latest") == F.col("base_revision"), F.lit(False))).withColumn("error", F.lit("CHUNK_REVISION_CONFLICT")).drop("_latest")
    new = good.select("logical_id", (F.col("base_revision") + 1).alias("revision_number"), "content", "excluded")
    return revisions.unionByName(new), bad


def split_revision(revisions: DataFrame, splits: DataFrame) -> DataFrame:
    """``splits(logical_id, parts array<string> of 2..50)``: the parents as excluded new revisions, and children of new logical ids."""
    now = latest(revisions, ["logical_id"], F.desc("revision_number")).join(splits, "logical_id").filter(F.size("parts").between(2, 50))
    parent = now.select("logical_id", (F.col("revision_number") + 1).alias("revision_number"), "content", F.lit(True).alias("excluded"))
    child = now.select("logical_id", F.posexplode("parts").alias("i", "content"))
    child = child.select(F.concat_ws("_", F.lit("chk"), F.substring(F.sha2(F.concat_ws(":", "logical_id", F.col("i").cast("string"), "content"), 256), 1, 32)).alias("logical_id"), F.lit(1).cast("long").alias("revision_number"), "content", F.lit(False).alias("excluded"))
    return revisions.unionByName(parent.withColumn("revision_number", F.col("revision_number").cast("long"))).unionByName(child)


def merge_revisions(revisions: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups(group_id, logical_id, ordinal)`` of 2..50 chunks: the inputs excluded, and one chunk with their contents in order."""
    now = latest(revisions, ["logical_id"], F.desc("revision_number")).join(groups, "logical_id")
    sized = now.join(now.groupBy("group_id").agg(F.count("*").alias("_n")).filter(F.col("_n").between(2, 50)), "group_id")
    gone = sized.select("logical_id", (F.col("revision_number") + 1).alias("revision_number"), "content", F.lit(True).alias("excluded"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"])
    new = sized.groupBy("group_id").agg(F.array_join(parts, "\n\n").alias("content"))
    new = new.select(F.concat_ws("_", F.lit("chk"), F.substring(F.sha2(F.concat_ws(":", F.col("group_id").cast("string"), "content"), 256), 1, 32)).alias("logical_id"), F.lit(1).cast("long").alias("revision_number"), "content", F.lit(False).alias("excluded"))
    return revisions.unionByName(gone).unionByName(new)


# --- releases ----------------------------------------------------------------------------------------------------------

#: Document states that block a release.
UNPUBLISHABLE = ("review_required", "partial", "failed", "needs_password", "quarantined")


def quality_gate(documents: DataFrame) -> DataFrame:
    """Number of documents per state that block a release."""
    return documents.filter(F.col("status").isin(*UNPUBLISHABLE)).groupBy("status").agg(F.count("*").alias("n"))


def release_snapshot(chunks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest, not excluded chunks with their ordinal within ``key`` by the columns ``order``, numbered over ranges, so no task sees all chunks of a hot key."""
    numbered = hierarchy.running(chunks, key, order, F.lit(0), ("ordinal", "_none"))
    return numbered.withColumn("ordinal", F.col("ordinal").cast("int")).drop("_none")


def fingerprint(snapshot: DataFrame, keys: list[str], ident: str, content: str, config_hash: str = "") -> DataFrame:
    """SHA-256 over ``id:sha256(content)`` in the order of ids, joined by |, and the configuration's hash.

    The hash of a release is one digest over all of its rows in order, so the rows of a release stream through one digest; only ids and hashes travel, and no list is held.
    """
    rows = snapshot.select(*keys, F.col(ident).alias("_id"), F.concat(F.col(ident).cast("string"), F.lit(":"), F.sha2(F.col(content), 256)).alias("_line"))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, digest, names = None, 0, None, None
        done: list[tuple] = []
        for batch in batches:
            names = batch.schema
            for *key, line in zip(*[batch.column(i).to_pylist() for i in range(n)], batch.column(n + 1).to_pylist()):
                if digest is None or key != now:
                    if digest is not None:
                        done.append((*now, digest, count))
                    now, count, digest = key, 0, hashlib.sha256()
                digest.update((b"|" if count else b"") + line.encode())
                count += 1
        if digest is not None:
            done.append((*now, digest, count))
        for row in done:
            row[n].update(f"|{config_hash}".encode())
        if done:
            columns = list(zip(*done))
            yield pa.RecordBatch.from_arrays([*[pa.array(columns[i], names.field(i).type) for i in range(n)], pa.array([d.hexdigest() for d in columns[n]]), pa.array(columns[n + 1], pa.int64())], [*keys, "content_hash", "n_chunks"])

    schema = snapshot.select(*keys).schema.add("content_hash", "string").add("n_chunks", "long")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "_id").mapInArrow(run, schema)


def release_id(key: Column) -> Column:
    return F.concat(F.lit("rel_"), F.substring(F.sha2(key, 256), 1, 32))


def provenance_faults(snapshot: DataFrame, required: list[str]) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in required])
    return snapshot.agg(F.count_if(bad).alias("faults"), F.count("*").alias("total"))


def upsert_latest(base: DataFrame, changes: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Insert or replace: the row of the highest sequence wins."""
    return latest(base.unionByName(changes), keys, F.desc(sequence))


def insert_or_ignore(base: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(seeds.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti").select(*base.columns))


def next_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


# --- traces ------------------------------------------------------------------------------------------------------------


def waterfall(stages: DataFrame, trace: str, order: str, duration: str) -> DataFrame:
    """start_ms and end_ms of each stage by running sums; a missing duration leaves all that follows unknown."""
    w = Window.partitionBy(trace).orderBy(order)
    before = F.sum(duration).over(w.rowsBetween(Window.unboundedPreceding, -1))
    unknown = F.coalesce(F.count_if(F.col(duration).isNull()).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    start = F.when(~unknown, F.coalesce(before, F.lit(0)))
    return stages.withColumn("start_ms", start).withColumn("end_ms", start + F.col(duration))


def compare_candidates(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """added, removed and common candidates of two result lists, by one full join."""
    both = left.select(*keys, F.lit(True).alias("_left")).join(right.select(*keys, F.lit(True).alias("_right")), keys, "full_outer")
    return both.select(*keys, F.when(F.col("_left").isNull(), "added").when(F.col("_right").isNull(), "removed").otherwise("common").alias("change"))


def compare_stages(left: DataFrame, right: DataFrame) -> DataFrame:
    """Stages (name, position, status, duration_ms) of two traces by name, in the order of first appearance."""
    a = left.select("name", F.col("position").alias("pa"), F.col("status").alias("left_status"), F.col("duration_ms").alias("left_ms"))
    b = right.select("name", (F.col("position") + 1000).alias("pb"), F.col("status").alias("right_status"), F.col("duration_ms").alias("right_ms"))
    both = a.join(b, "name", "full_outer")
    return both.select("name", F.coalesce("pa", "pb").alias("position"), "left_status", "right_status", (F.coalesce("right_ms", F.lit(0)) - F.coalesce("left_ms", F.lit(0))).alias("delta_ms"))


def filter_candidates(candidates: DataFrame, text: str | None = None, channel: str | None = None, min_score: float | None = None) -> DataFrame:
    """Candidates whose content or title holds ``text``, that came by ``channel``, at ``min_score`` or more."""
    return candidates.filter(conjunction([
        (F.instr(F.lower("content"), text.lower()) > 0) | (F.instr(F.lower(F.coalesce("title", F.lit(""))), text.lower()) > 0) if text else None,
        F.array_contains("channels", channel) if channel else None,
        F.col("fusion_score") >= min_score if min_score is not None else None,
    ]))


def channels(vector_rank: Column, full_text_rank: Column) -> Column:
    return F.array_compact(F.array(F.when(vector_rank.isNotNull(), "vector"), F.when(full_text_rank.isNotNull(), "fullText")))


def inspect_stages(stages: DataFrame) -> DataFrame:
    """Provenance of each stage: recorded with an output, reconstructed only if it succeeded or degraded, else unavailable."""
    kind = F.when(F.col("output").isNotNull(), "recorded").when(F.col("status").isin("succeeded", "degraded"), "reconstructed").otherwise("unavailable")
    return stages.withColumn("provenance", kind)


# --- audit -------------------------------------------------------------------------------------------------------------


#: Fields of an audit event in the order in which they are hashed; ``details`` is JSON already.
AUDIT_JSON = ("eventId", "workspaceId", "action", "details")


def audit_payload(fields: tuple[str, ...], previous: Column) -> Column:
    """Compact JSON of the fields in their order and the previous hash; null fields are null, ``details`` is taken as JSON."""

    def one(name: str) -> Column:
        value = F.col(name) if name == "details" else F.regexp_replace(F.to_json(F.struct(F.col(name).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', "")
        return F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null")))

    return F.concat(F.lit("{"), F.concat_ws(",", *[one(f) for f in fields], F.concat(F.lit('"previous":"'), previous, F.lit('"'))), F.lit("}"))


def audit_hash(previous: Column, fields: tuple[str, ...]) -> Column:
    return F.sha2(audit_payload(fields, previous), 256)


def append_events(chain: DataFrame, events: DataFrame, workspace: str, order: str, fields: tuple[str, ...]) -> DataFrame:
    """``chain`` with ``events`` appended per workspace, each with previous_hash and event_hash.

    A hash needs the one before it, so a workspace's new events are one ordered run; they are hashed as they stream by, with nothing held but the last hash, and workspaces side by side.
    """
    heads = chain.groupBy(workspace).agg(F.max_by("event_hash", order).alias("head"))
    names = [c for c in chain.columns if c not in ("previous_hash", "event_hash")]
    # The payload is built with a mark in place of the hash that is not yet known.
    mark = "\x00"
    rows = events.join(heads, workspace, "left").select(*names, F.coalesce("head", F.lit("GENESIS")).alias("_head"), audit_payload(fields, F.lit(mark)).alias("_payload"))
    rows = rows.repartition(workspace).sortWithinPartitions(workspace, order)
    at = names.index(workspace)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), ""
        for batch in batches:
            before, hashes = [], []
            for key, head, payload in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                last = last if key == now else head
                now = key
                before.append(last)
                last = hashlib.sha256(payload.replace(mark, last).encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(before, pa.string()), pa.array(hashes, pa.string())], [*names, "previous_hash", "event_hash"])

    new = rows.mapInArrow(run, events.select(*names).schema.add("previous_hash", "string").add("event_hash", "string"))
    return chain.select(*names, "previous_hash", "event_hash").unionByName(new)


def verify_chain(events: DataFrame, workspace: str, order: str, fields: tuple[str, ...]) -> DataFrame:
    """Per workspace: events, broken ones, and the first break with its reason. Each row stores the previous hash, so rows verify side by side."""
    before = F.lag("event_hash", 1, "GENESIS").over(Window.partitionBy(workspace).orderBy(order))
    reason = F.when(F.col("previous_hash") != before, "previous_hash mismatch").when(F.col("event_hash") != audit_hash(F.col("previous_hash"), fields), "event_hash mismatch")
    judged = events.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct(F.col(order).alias("at"), "reason")))
    return judged.groupBy(workspace).agg(F.count("*").alias("n_events"), F.count("reason").alias("n_broken"), first.alias("f")).select(workspace, "n_events", "n_broken", F.col("f.at").alias("first_broken"), F.col("f.reason").alias("reason"))


# --- tasks and counts --------------------------------------------------------------------------------------------------

#: States of a task.
TERMINAL = ("succeeded", "partial", "failed", "cancelled")


def fold_tasks(events: DataFrame, key: str, order: list[Column], state: str) -> DataFrame:
    """Latest state of each task, its number of events, and whether it has ended."""
    n = F.count("*").over(Window.partitionBy(key))
    return latest(events.withColumn("n_events", n), [key], *order).withColumn("ended", F.col(state).isin(*TERMINAL))


def recover(tasks: DataFrame) -> DataFrame:
    """After a restart, running tasks are queued again."""
    return tasks.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def idempotent_create(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(idempotency_key, fingerprint) judged: created, reused, requeued (the same input failed before) or conflict."""
    known = tasks.select("idempotency_key", F.col("fingerprint").alias("_f"), F.col("status").alias("_s"))
    first = latest(requests, ["idempotency_key", "fingerprint"], F.col("fingerprint"))
    outcome = F.when(F.col("_f").isNull(), "created").when(F.col("_f") != F.col("fingerprint"), "conflict").when(F.col("_s") == "failed", "requeued").otherwise("reused")
    return first.join(known, "idempotency_key", "left").withColumn("outcome", outcome).drop("_f", "_s")


def create_in_order(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(idempotency_key, fingerprint, sequence) with ``outcome``, as if they came one after another in the order of their sequences.

    The first request of a key that ``tasks(idempotency_key, fingerprint, status)`` doesn't know is ``created`` and gives the key its fingerprint; the first one that
    repeats the input of a failed task is ``requeued``; further ones with the key's fingerprint are ``reused`` and others a ``conflict``. Null keys are ``created``
    each, a null fingerprint equals itself; of requests with one sequence the smallest fingerprint comes first, and repeated rows share an outcome.
    Firsts are minima that are combined before the shuffle, so a key may hold any share of the rows.
    """
    fp = F.struct("fingerprint")
    keyed, loose = requests.filter("idempotency_key is not null"), requests.filter("idempotency_key is null")
    firsts = keyed.groupBy("idempotency_key", fp.alias("_fp")).agg(F.min("sequence").alias("_first"))
    opening = firsts.groupBy("idempotency_key").agg(F.min(F.struct("_first", "_fp")).alias("_open"))
    known = tasks.filter("idempotency_key is not null").groupBy("idempotency_key").agg(F.max(F.struct(F.struct("fingerprint").alias("_fp"), "status")).alias("_task"))
    rule = firsts.join(opening, "idempotency_key").join(known, "idempotency_key", "left")
    owner = F.coalesce(F.col("_task._fp"), F.col("_open._fp"))
    once = F.when(F.col("_task").isNull(), "created").when(F.col("_task.status") == "failed", "requeued").otherwise("reused")
    rule = rule.select("idempotency_key", "_fp", "_first", F.when(F.col("_fp").eqNullSafe(owner), once).otherwise("conflict").alias("_once"))
    outcome = F.when((F.col("_once") == "conflict") | (F.col("sequence") == F.col("_first")), F.col("_once")).otherwise("reused")
    judged = keyed.withColumn("_fp", fp).join(rule, ["idempotency_key", "_fp"]).withColumn("outcome", outcome)
    return judged.select(*requests.columns, "outcome").unionByName(loose.withColumn("outcome", F.lit("created")))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def child_counts(parent: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Rows of each child table per parent: aggregated first, then joined, 0 where none."""
    for name, child in children.items():
        parent = parent.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").fillna(0, [name])
    return parent


# --- graph -------------------------------------------------------------------------------------------------------------


def neighbours(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id, direction, relation_type, other_id for outgoing and incoming relations of the given entities."""
    ids = entities.select("entity_id")
    out = relations.join(ids.withColumnRenamed("entity_id", "src"), "src").select(F.col("src").alias("entity_id"), F.lit("out").alias("direction"), "relation_type", F.col("dst").alias("other_id"))
    into = relations.join(ids.withColumnRenamed("entity_id", "dst"), "dst").select(F.col("dst").alias("entity_id"), F.lit("in").alias("direction"), "relation_type", F.col("src").alias("other_id"))
    return out.unionByName(into)


def valid_relations(relations: DataFrame, entities: DataFrame, types: list[str]) -> DataFrame:
    """Relations of a known type whose two ends exist in the same dataset."""
    ends = entities.select("entity_id", "dataset_id")
    out = relations.filter(F.col("relation_type").isin(*types))
    out = out.join(ends.select(F.col("entity_id").alias("src"), "dataset_id"), ["src", "dataset_id"], "left_semi")
    return out.join(ends.select(F.col("entity_id").alias("dst"), "dataset_id"), ["dst", "dataset_id"], "left_semi")
