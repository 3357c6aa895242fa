"""Builds and switches of releases on shared storage."""

import pytest
from pyspark.sql import functions as F

from trovelight.functions import vectors as V
from trovelight.sources.releases import ReleaseError, ReleaseLog

SCHEMA = "chunk_id long, document string, revision long, artifact string, content string, excluded boolean"


def chunks(spark, *rows):
    return spark.createDataFrame([(i, d, 1, f"file-{d}", t, x) for i, d, t, x in rows], SCHEMA)


def documents(spark, **status):
    return spark.createDataFrame(list(status.items()), "document string, status string")


def refused(code, call, *args, **kw):
    with pytest.raises(ReleaseError) as caught:
        call(*args, **kw)
    assert caught.value.code == code


@pytest.fixture
def log(spark, tmp_path):
    return ReleaseLog(spark, f"file://{tmp_path}/published")


def test_build_switch_reuse_and_rollback(spark, log):
    one = chunks(spark, (2, "a", "blue sky", False), (1, "a", "red sea", False), (3, "b", "gone", False), (4, "a", "hidden", True), (5, "a", "red sea", False))
    docs = documents(spark, a="ready", b="deleted")
    assert log.active("d") is None and log.states("d") == {}
    refused("NOT_FOUND", log.chunks, "d")
    first = log.build("d", one, docs)
    assert (first.version, first.n_chunks, first.n_reused) == (1, 3, 0) and log.active("d") == first.release
    rows = log.chunks("d").orderBy("ordinal").collect()
    assert [(r.ordinal, r.chunk_id, r.content) for r in rows] == [(1, 1, "red sea"), (2, 2, "blue sky"), (3, 5, "red sea")]
    assert [list(r.embedding) for r in rows] == V.hash_vectors([r.content for r in rows]).tolist()
    # Asked for again it isn't built again, and the log stays.
    assert log.build("d", one, docs) == first and log.position("d") == 1
    second = log.build("d", chunks(spark, (1, "a", "red sea", False), (9, "a", "new text", False), (10, "a", "red sea", False)), docs)
    assert (second.version, second.n_chunks, second.n_reused) == (2, 3, 2)
    again = log.chunks("d").orderBy("ordinal").collect()
    assert [(r.content, r.reused) for r in again] == [("red sea", True), ("new text", False), ("red sea", True)]
    assert [list(r.embedding) for r in again] == V.hash_vectors([r.content for r in again]).tolist()
    assert log.states("d") == {first.release: "superseded", second.release: "active"}
    log.rollback("d", first.release)
    assert log.chunks("d").count() == 3 and log.active("d") == first.release
    refused("INVALID_STATE", log.rollback, "d", first.release)
    refused("INVALID_STATE", log.rollback, "d", "rel_none")
    assert [(e["action"], e["previous"]) for e in log.history("d")] == [("activate", None), ("activate", first.release), ("rollback", second.release)]
    third = log.build("d", chunks(spark, (1, "a", "third", False)), docs, activate=False)
    assert log.states("d")[third.release] == "ready" and log.active("d") == first.release
    assert log.active("other") is None


def test_failed_builds_leave_the_active_release(spark, log):
    docs = documents(spark, a="ready")
    first = log.build("d", chunks(spark, (1, "a", "text", False)), docs)
    other = chunks(spark, (1, "a", "other", False))
    refused("RELEASE_QUALITY_BLOCKED", log.build, "d", other, documents(spark, a="ready", b="partial"))
    refused("NO_PUBLISHABLE_CHUNKS", log.build, "d", chunks(spark, (1, "a", "text", True)), docs)
    refused("NO_PUBLISHABLE_CHUNKS", log.build, "d", other.limit(0), docs.limit(0))
    refused("RELEASE_CONTENT_CHANGED", log.build, "d", other, docs, expected=log.fingerprint(chunks(spark, (1, "a", "text", False)), docs))
    for column in ("revision", "artifact", "content"):
        bad = other.unionByName(other.withColumn(column, F.lit(None).cast(dict(other.dtypes)[column])))
        refused("RELEASE_VALIDATION_FAILED", log.build, "d", bad, docs)
    shifting = other.withColumn("content", F.expr("reflect('java.util.UUID', 'randomUUID')"))
    refused("RELEASE_CONTENT_CHANGED", log.build, "d", shifting, docs)
    assert log.active("d") == first.release and log.position("d") == 1 and list(log.states("d")) == [first.release]
    assert log.folder.names(log._place("d")) == ["log", first.release]
    reviewed = log.build("d", other, documents(spark, a="ready", b="partial"), expected=log.fingerprint(other, docs), allow_review=True)
    assert reviewed.n_blocking == 1 and log.active("d") == reviewed.release


def test_of_two_switches_one_wins(spark, log):
    docs = documents(spark, a="ready")
    made = [log.build("d", chunks(spark, (1, "a", f"text {i}", False)), docs, activate=False) for i in range(2)]
    seen = log.position("d")
    log.switch("d", made[0].release, after=seen)
    refused("RELEASE_CONFLICT", log.switch, "d", made[1].release, after=seen)
    assert log.active("d") == made[0].release
    # A session that ended between making an entry and writing it: readers see the switch before it, and the next one goes on after it.
    log.folder.create(f"{log._place('d')}/log/{seen + 2:012d}").close()
    assert log.active("d") == made[0].release
    log.switch("d", made[1].release)
    assert log.active("d") == made[1].release and len(log.history("d")) == 2


def test_texts_are_never_sorted_and_travel_once(spark, log, monkeypatch):
    plans = []
    vectors = V.with_embedding
    monkeypatch.setattr(V, "with_embedding", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or vectors(df, *a))
    docs = documents(spark, a="ready", b="deleted")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        log.build("d", chunks(spark, (1, "a", "one", False), (2, "b", "gone", False)), docs)
        second = log.build("d", chunks(spark, (1, "a", "one", False), (2, "a", None, False), (3, "a", "three", False), (4, "b", "gone", False)), docs, activate=False, allow_review=True)
    except ReleaseError as error:
        assert error.code == "RELEASE_VALIDATION_FAILED"  # the chunk without content
        second = log.build("d", chunks(spark, (1, "a", "one", False), (3, "a", "three", False), (4, "b", "gone", False)), docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert (second.n_chunks, second.n_reused) == (2, 1) and len(plans) == 3
    for plan in plans:
        content = [line for line in plan.split("\n") if "content#" in line]
        assert "ShuffledHashJoin" in plan and sum("Exchange" in line for line in plan.split("\n") if "REPARTITION_BY_NUM" in line) == 2
        assert not [line for line in content if "Sort [" in line]
