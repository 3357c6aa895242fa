"""Keyed machines: batches against a plain fold, streams (stopped and started again) against batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trovelight.plans import machine_queries as Q
from trovelight.streaming import machines as M

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, M.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def states(spark, events, lease=100):
    rows = [("t", at(s), i, e, p) for i, (s, e, p) in enumerate(events)]
    r = M.task_table(spark.createDataFrame(rows, "task_id string, at timestamp, sequence long, event string, progress double"), lease).first()
    return r.status, r.progress, r.attempt, r.rejected


@pytest.mark.parametrize("events,want", [
    ([(0, "enqueue", None), (1, "start", None), (2, "checkpoint", 140.0), (3, "succeed", None), (4, "start", None)], ("succeeded", 100, 1, 1)),
    ([(0, "start", None), (0, "enqueue", None), (1, "start", None), (2, "pause", None), (3, "checkpoint", 50.0)], ("paused", 0, 1, 1)),
    ([(0, "enqueue", None), (1, "start", None), (2, "checkpoint", 41.5), (3, "cancel", None), (4, "succeed", None), (5, "retry", None), (6, "start", None), (7, "partial", None)], ("partial", 100, 2, 0)),
    ([(0, "enqueue", None), (1, "start", None), (2, "checkpoint", 60.0), (150, "succeed", None), (151, "start", None), (152, "checkpoint", -3.0)], ("running", 0, 2, 1)),
    ([(0, "enqueue", None), (1, "pause", None), (2, "resume", None), (3, "start", None), (4, "pause", None), (5, "fail", None), (6, "odd", None)], ("failed", 0, 1, 1)),
])
def test_a_task(spark, events, want):
    assert states(spark, events) == want


def test_no_rows(spark):
    none = spark.createDataFrame([(None, at(0), 1, "enqueue", None)], "task_id string, at timestamp, sequence long, event string, progress double")
    assert M.task_table(none, 5).count() == 0
    assert M.expiring(none.limit(0), ["task_id"], "at", "sequence", 5).count() == 0 and M.delivered(none.limit(0), "task_id", "sequence", "event").count() == 0


def test_lifetimes_are_not_stretched_by_use(spark):
    rows = [("a", at(s), i) for i, s in enumerate([0, 5, 9, 10, 11, 12, 22, 40])] + [(None, at(1), 50), (None, at(2), 51), ("", at(2), 52)]
    got = M.expiring(spark.createDataFrame(rows, "nonce string, ts timestamp, i long"), ["nonce"], "ts", "i", 10).collect()
    assert sorted((r.sequence, r.round) for r in got if r.nonce == "a") == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 4)]
    assert {(r.nonce, r.sequence) for r in got if r["first"] and r.nonce != "a"} == {(None, 50), ("", 52)}


def run(spark, make, path, name, batches, mode):
    """Write the rows of a stream over ``batches``, stopped after each and started again from its checkpoint."""
    # Timers by the clock always ask for another batch, so one is run at a time.
    trigger = {"once": True} if name == "messages" else {"availableNow": True}
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(f"{path}/{name}-in")
        stream = make(spark.readStream.schema(batch.schema).parquet(f"{path}/{name}-in"))
        stream.writeStream.foreachBatch(M.once(f"{path}/{name}-out")).outputMode(mode).option("checkpointLocation", f"{path}/{name}-state").trigger(**trigger).start().awaitTermination(120)


def test_a_stream_of_tasks_started_again(rocks, tmp_path):
    spark, path = rocks, f"file://{tmp_path}"
    rnd = random.Random(3)
    rows = [(t, at(60 * i + t), i, rnd.choice(Q.KINDS), rnd.random() * 120) for t in range(6) for i in range(40) if rnd.random() < 0.8]
    rows.sort(key=lambda r: r[1])
    schema = "task_id int, at timestamp, sequence long, event string, progress double"
    batches = [spark.createDataFrame(rows[a : a + 70], schema) for a in range(0, len(rows), 70)]
    run(spark, lambda s: M.task_table(s.withWatermark("at", "0 seconds"), 100), path, "tasks", batches, "update")
    seen = spark.read.parquet(f"{path}/tasks-out").collect()
    last = {}
    for r in seen:
        if r.task_id not in last or (r.n_events, r.status == "queued") > (last[r.task_id].n_events, last[r.task_id].status == "queued"):
            last[r.task_id] = r
    want = {r.task_id: r for r in M.task_table(spark.createDataFrame(rows, schema), 100).collect()}
    assert last.keys() == want.keys()
    for t, r in want.items():
        assert (last[t].n_events, last[t].rejected, last[t].attempt) == (r.n_events, r.rejected, r.attempt)
        assert last[t].status == r.status or (r.status, last[t].status) == ("running", "queued")  # its lease ended with the watermark


def test_a_stream_of_lifetimes(rocks, tmp_path):
    spark, path = rocks, f"file://{tmp_path}"
    rnd = random.Random(4)
    rows = sorted([(f"n{rnd.randrange(5)}", at(rnd.randrange(4000)), i) for i in range(200)], key=lambda r: (r[1], r[2]))
    batches = [spark.createDataFrame(rows[a : a + 100], "nonce string, ts timestamp, i long") for a in range(0, 200, 100)]
    run(spark, lambda s: M.expiring(s.withWatermark("ts", "0 seconds"), ["nonce"], "ts", "i", 600), path, "nonces", batches, "append")
    got = spark.read.parquet(f"{path}/nonces-out").select("nonce", "sequence", "round", "first").collect()
    want = M.expiring(spark.createDataFrame(rows, "nonce string, ts timestamp, i long"), ["nonce"], "ts", "i", 600).select("nonce", "sequence", "round", "first").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_stream_of_messages_out_of_order(rocks, tmp_path):
    spark, path = rocks, f"file://{tmp_path}"
    rnd = random.Random(5)
    rows = [(t, i, "stage" if i < 2 else "done" if i == 20 else "token") for t in "abc" for i in range(24)] + [("gap", i, "token") for i in (0, 1, 3, 4)]
    rows += rnd.choices(rows, k=20)
    rnd.shuffle(rows)
    batches = [spark.createDataFrame(rows[a : a + 50], "trace string, sequence long, kind string") for a in range(0, len(rows), 50)]
    run(spark, lambda s: M.delivered(s, "trace", "sequence", "kind", 3600), path, "messages", batches, "append")
    got = spark.read.parquet(f"{path}/messages-out").filter("kind != 'keepalive'").select("trace", "sequence", "kind").collect()
    want = M.delivered(spark.createDataFrame(rows, "trace string, sequence long, kind string"), "trace", "sequence", "kind").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 3 * 21 + 2
    # In order within and between micro-batches.
    number = F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("int")
    late = spark.read.parquet(f"{path}/messages-out").withColumn("b", number).groupBy("trace", "b").agg(F.min("sequence").alias("low"), F.max("sequence").alias("high")).orderBy("trace", "b").collect()
    assert all(x.trace != y.trace or x.high < y.low for x, y in zip(late, late[1:]))


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    sink = M.once(f"file://{tmp_path}/o")
    for n in (3, 5):
        sink(spark.range(n), 0)
    sink(spark.range(2), 1)
    assert spark.read.parquet(f"file://{tmp_path}/o").count() == 7
