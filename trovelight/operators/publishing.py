"""Releases, sources, traces and versions as a user publishes them: builds, switches, deletions, records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelight.operators import lifecycle as L

#: The stages of a trace in their order, and what a state of a release allows.
STAGES = ("parse", "embed", "route", "recall", "fusion", "rerank", "prompt", "generation")
ACTIVATABLE = ("ready", "active", "superseded", "retained")
RESTORABLE = ("ready", "superseded", "retained")


def build_releases(chunks: DataFrame, documents: DataFrame, requests: DataFrame, config_hash: str = "") -> DataFrame:
    """Judge and build a release for each of requests(dataset, version, allow_review, expected_hash).

    ``chunks(dataset, chunk_id, document, content, excluded)`` are the latest revisions, ``documents(dataset, document, status)``. A build is refused where the content changed since it was
    asked for (expected_hash), a document blocks the quality gate (unless allow_review), or nothing is left to publish; else it is ready, with its content hash and number of chunks.
    Chunks of deleted documents and excluded ones are left out.
    """
    live = documents.filter(F.col("status") != "deleted").select("dataset", "document")
    published = chunks.filter(~F.col("excluded")).join(live, ["dataset", "document"], "left_semi")
    hashed = L.fingerprint(published, ["dataset"], "chunk_id", "content", config_hash)
    gate = documents.filter(F.col("status").isin(*L.UNPUBLISHABLE)).groupBy("dataset").agg(F.count("*").alias("n_blocking"))
    rows = requests.join(hashed, "dataset", "left").join(gate, "dataset", "left").fillna(0, ["n_chunks", "n_blocking"])
    error = (
        F.when(F.col("expected_hash").isNotNull() & ~F.col("expected_hash").eqNullSafe(F.col("content_hash")), "RELEASE_CONTENT_CHANGED")
        .when((F.col("n_blocking") > 0) & ~F.col("allow_review"), "RELEASE_QUALITY_BLOCKED").when(F.col("n_chunks") == 0, "NO_PUBLISHABLE_CHUNKS")
    )
    out = rows.withColumn("error", error).withColumn("status", F.when(error.isNull(), "ready").otherwise("failed"))
    return out.select("dataset", "version", "status", "error", "n_chunks", "n_blocking", F.when(F.col("error").isNull(), F.col("content_hash")).alias("content_hash"))


def switch_releases(releases: DataFrame, switches: DataFrame) -> DataFrame:
    """States of releases(dataset, release, status) after switches(dataset, release, sequence) in their order.

    A switch to a release that may be activated makes it active and supersedes the one that was, so the last one of a dataset decides; a rollback is a switch to an older release.
    Switches to other releases change nothing.
    """
    able = switches.join(releases.filter(F.col("status").isin(*ACTIVATABLE)).select("dataset", "release"), ["dataset", "release"], "left_semi")
    last = L.latest(able, ["dataset"], F.desc("sequence")).select("dataset", F.col("release").alias("_active"))
    once = able.select("dataset", "release").distinct().withColumn("_once", F.lit(True))
    rows = releases.join(last, "dataset", "left").join(once, ["dataset", "release"], "left")
    was = F.col("_once").isNotNull() | (F.col("status") == "active")
    state = F.when(F.col("_active").isNull(), F.col("status")).when(F.col("release") == F.col("_active"), "active").when(was, "superseded").otherwise(F.col("status"))
    return rows.select("dataset", "release", state.alias("status"))


def delete_documents(documents: DataFrame, deletions: DataFrame, released: DataFrame) -> DataFrame:
    """documents(document, status) after deletions(document), with the number of release chunks (document) that still refer to each deleted one; releases keep them."""
    gone = deletions.select("document").distinct().withColumn("_gone", F.lit(True))
    refs = released.join(gone, "document", "left_semi").groupBy("document").agg(F.count("*").alias("n_references"))
    rows = documents.join(gone, "document", "left").join(refs, "document", "left")
    return rows.select("document", F.when(F.col("_gone"), "deleted").otherwise(F.col("status")).alias("status"), F.when(F.col("_gone"), F.coalesce("n_references", F.lit(0))).alias("n_references"))


def visible_chunks(released: DataFrame, documents: DataFrame) -> DataFrame:
    """release chunks with ``in_next``: a release keeps the chunks of documents deleted since, the next one won't have them."""
    live = documents.filter(F.col("status") != "deleted").select("document").distinct().withColumn("_live", F.lit(True))
    return released.join(live, "document", "left").withColumn("in_next", F.col("_live").isNotNull()).drop("_live")


def all_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """sources(id, name, type, dataset, status, n_documents) and files that belong to none yet (id, name, status) as uploads of one document."""
    loose = files.filter("status = 'unassigned'").select("id", "name", F.lit("upload").alias("type"), F.lit(None).cast(dict(sources.dtypes)["dataset"]).alias("dataset"), "status", F.lit(1).cast("long").alias("n_documents"))
    return sources.select("id", "name", "type", "dataset", "status", "n_documents").unionByName(loose)


def widened(overrides: DataFrame, scope: dict[str, str]) -> Column:
    """Whether an override names another value than the scope's in any of its fields; a null keeps the scope."""
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() & (F.col(c) != F.col(own)) for c, own in scope.items()])


def in_folder(folder: str, wanted: Column) -> Column:
    """Rows of a folder; the null folder holds those without one."""
    return F.col(folder).eqNullSafe(wanted)


def starts_with_any(column: str, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(F.col(column), F.lit(p)) for p in prefixes])


def trace_records(stages: DataFrame) -> DataFrame:
    """trace, stages: the eight stages of each trace in their order from stages(trace, stage, status, duration_ms, recorded); those that weren't recorded have that status.

    A trace has eight entries, whatever was recorded; the last record of a stage counts.
    """
    last = L.latest(stages, ["trace", "stage"], F.desc("recorded"))
    found = last.groupBy("trace").agg(F.map_from_entries(F.collect_list(F.struct("stage", F.struct("status", "duration_ms")))).alias("m"))
    missing = F.struct(F.lit("not_recorded").alias("status"), F.lit(None).cast(dict(stages.dtypes)["duration_ms"]).alias("duration_ms"))
    each = [F.struct(F.lit(i + 1).alias("position"), F.lit(s).alias("stage"), F.coalesce(F.try_element_at("m", F.lit(s)), missing).alias("r")) for i, s in enumerate(STAGES)]
    return found.select("trace", F.transform(F.array(*each), lambda x: F.struct(x["position"].alias("position"), x["stage"].alias("stage"), x["r"]["status"].alias("status"), x["r"]["duration_ms"].alias("duration_ms"))).alias("stages"))


def stage_logs(stages: DataFrame, drafts: DataFrame) -> DataFrame:
    """Log lines per trace and stage: one of the recorded stage, one of each saved draft (trace, stage, version, at)."""
    text = F.when(F.col("status").isNull(), "stage_not_recorded").otherwise("stage_recorded")
    a = stages.select("trace", "stage", F.col("recorded").alias("at"), text.alias("message"), F.lit(None).cast("long").alias("version"))
    return a.unionByName(drafts.select("trace", "stage", "at", F.lit("draft_saved").alias("message"), F.col("version").cast("long").alias("version")))


def lineage(traces: DataFrame) -> DataFrame:
    """traces(trace, parent, root) with the state of parent and root: known, gone or none; roots are stored, so nothing recurses."""
    ids = traces.select("trace").distinct()
    rows = traces.join(ids.select(F.col("trace").alias("parent"), F.lit(True).alias("_p")), "parent", "left").join(ids.select(F.col("trace").alias("root"), F.lit(True).alias("_r")), "root", "left")
    state = lambda c, there: F.when(F.col(c).isNull(), "none").when(there, "known").otherwise("gone")
    return rows.select("trace", "parent", "root", state("parent", F.col("_p")).alias("parent_state"), state("root", F.col("_r")).alias("root_state"))


def versions(created: DataFrame, key: str, order: str, published: str) -> DataFrame:
    """Versions of each key from 1; the last published one is active, earlier published ones are superseded, others are drafts."""
    w = Window.partitionBy(key)
    rows = created.withColumn("version", F.row_number().over(w.orderBy(order)))
    last = F.max(F.when(F.col(published), F.col("version"))).over(w)
    return rows.withColumn("status", F.when(~F.col(published), "draft").when(F.col("version") == last, "active").otherwise("superseded"))


def publish_assistants(assistants: DataFrame, active: DataFrame) -> DataFrame:
    """assistants(id, dataset, version) judged: published at version + 1 where the dataset has an active release (dataset, release), else refused."""
    rows = assistants.join(active.select("dataset", "release"), "dataset", "left")
    ok = F.col("release").isNotNull()
    return rows.select("id", "dataset", "release", F.when(ok, F.coalesce("version", F.lit(0)) + 1).alias("version"), F.when(ok, "published").otherwise("ACTIVE_RELEASE_REQUIRED").alias("outcome"))


def vectorise_pending(revisions: DataFrame, key: str, number: str, content: str, embedding: str) -> DataFrame:
    """``revisions`` with a further revision, embedded, of each latest one that has no embedding yet."""
    from trovelight.functions import vectors as V

    pending = L.latest(revisions, [key], F.desc(number)).filter(F.col(embedding).isNull())
    new = V.with_embedding(pending.drop(embedding).withColumn(number, F.col(number) + 1), content, embedding)
    return revisions.unionByName(new.select(*revisions.columns))


def gated(rows: DataFrame, flag: str, flags: dict[str, bool]) -> DataFrame:
    """Rows whose feature is on; features that aren't named are off. A row per feature is looked up."""
    on = [k for k, v in flags.items() if v]
    return rows.filter(F.col(flag).isin(*on)) if on else rows.filter("false")


def conflicts(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """key, n_dependents, outcome: a parent with children can't be deleted."""
    n = children.groupBy(key).agg(F.count("*").alias("n_dependents"))
    return parents.select(key).join(n, key, "left").fillna(0, ["n_dependents"]).withColumn("outcome", F.when(F.col("n_dependents") > 0, "DEPENDENCY_CONFLICT").otherwise("deleted"))


def after_watermark(rows: DataFrame, column: str, watermark: object | None) -> DataFrame:
    """Rows of a source past its stored watermark; all without one."""
    return rows if watermark is None else rows.filter(F.col(column) > F.lit(watermark))
