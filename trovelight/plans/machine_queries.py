"""Queries of keyed state machines over events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.plans.tables import read
from trovelight.streaming import machines as M

KINDS = ["enqueue", "start", "checkpoint", "checkpoint", "pause", "checkpoint", "resume", "start", "succeed", "retry", "cancel", "partial", "fail"]
#: A running task without an event for so long is queued again.
LEASE_SECONDS = 8 * 3600
NONCE_SECONDS, SESSION_SECONDS = 600, 12 * 3600


def task_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the events of a task, followed to its last state."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % len(KINDS) + 1).cast("int"))
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("sequence"), kind.alias("event"), F.col("value").alias("progress"))
    return M.task_table(e, LEASE_SECONDS)


def nonce_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which uses of a nonce are accepted: those after ten minutes from the last accepted one."""
    e = read(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("nonce"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return M.expiring(e, ["nonce"], "ts", "event_id", NONCE_SECONDS).select("nonce", F.col("sequence").alias("event_id"), "round", F.col("first").alias("accepted"))


def session_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end twelve hours after their start: user_id, session, n_uses."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return M.expiring(e, ["user_id"], "ts", "event_id", SESSION_SECONDS).groupBy("user_id", F.col("round").alias("session")).agg(F.count("*").alias("n_uses"), F.min("sequence").alias("first_event"))


def ordered_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a day and type as a stream of numbered messages: what arrives without a gap, up to the end."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_id") % 97 == 0, "error").when(F.col("event_id") % 13 == 0, "done").when(k < 3, "stage").otherwise("token")
    e = read(spark, sf_dir, "events").select(F.concat_ws("/", (F.col("user_id") % 40).cast("string"), "event_type").alias("trace"), k.alias("sequence"), kind.alias("kind"))
    return M.delivered(e, "trace", "sequence", "kind")


QUERIES = {f.__name__: f for f in (task_machine, nonce_lifetimes, session_lifetimes, ordered_delivery)}


def _lives(key: str, seconds: int) -> str:
    return f"""RECURSIVE e AS (SELECT {key} AS k, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT k, event_id, n, t AS began, 1::BIGINT AS round, true AS first FROM e WHERE n = 1
  UNION ALL SELECT e.k, e.event_id, e.n, CASE WHEN e.t > s.began + {seconds}000000 THEN e.t ELSE s.began END, s.round + (e.t > s.began + {seconds}000000)::BIGINT, e.t > s.began + {seconds}000000
  FROM s JOIN e ON e.k IS NOT DISTINCT FROM s.k AND e.n = s.n + 1)"""


ORACLES = {
    "task_machine": f"""WITH RECURSIVE e AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, [{", ".join(f"'{k}'" for k in KINDS)}][event_id % {len(KINDS)} + 1] AS ev, value, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL),
s AS (SELECT DISTINCT task_id, 0::BIGINT AS n, NULL::VARCHAR AS st, 0 AS pr, 0 AS att, false AS c, false AS p, 0::BIGINT AS rej, 0::BIGINT AS last FROM e
 UNION ALL SELECT task_id, n,
  CASE WHEN ev = 'enqueue' AND st IS NULL THEN 'queued' WHEN ev = 'start' AND st = 'queued' THEN 'running'
   WHEN ev IN ('checkpoint', 'succeed', 'partial') AND st = 'running' THEN CASE WHEN c THEN 'cancelled' WHEN p THEN 'paused' WHEN ev = 'checkpoint' THEN st WHEN ev = 'succeed' THEN 'succeeded' ELSE 'partial' END
   WHEN ev = 'fail' AND st = 'running' THEN 'failed' WHEN ev = 'pause' AND st = 'queued' THEN 'paused' WHEN ev = 'cancel' AND st IN ('queued', 'paused') THEN 'cancelled'
   WHEN ev = 'resume' AND st = 'paused' THEN 'queued' WHEN ev = 'retry' AND st IN ('failed', 'cancelled', 'partial') THEN 'queued' ELSE st END,
  CASE WHEN ev IN ('checkpoint', 'succeed', 'partial') AND st = 'running' AND NOT c AND NOT p THEN CASE WHEN ev = 'checkpoint' THEN greatest(0, least(99, floor(coalesce(value, 0) + 0.5)::INT)) ELSE 100 END
   WHEN ev = 'retry' AND st IN ('failed', 'cancelled', 'partial') THEN 0 ELSE pr END,
  CASE WHEN ev = 'start' AND st = 'queued' THEN att + 1 ELSE att END,
  CASE WHEN ev = 'cancel' AND st IN ('queued', 'paused', 'running') THEN true WHEN ev = 'pause' AND st = 'running' OR ev = 'resume' AND st = 'paused' OR ev = 'retry' AND st IN ('failed', 'cancelled', 'partial') THEN false ELSE c END,
  CASE WHEN ev = 'pause' AND st = 'running' THEN true WHEN ev IN ('checkpoint', 'succeed', 'partial') AND st = 'running' AND (c OR p) OR ev = 'fail' AND st = 'running' OR ev = 'pause' AND st = 'queued'
   OR ev = 'cancel' AND st IN ('queued', 'paused', 'running') OR ev = 'resume' AND st = 'paused' OR ev = 'retry' AND st IN ('failed', 'cancelled', 'partial') THEN false ELSE p END,
  rej + (NOT coalesce((ev = 'enqueue' AND st IS NULL) OR (ev = 'start' AND st = 'queued') OR (ev IN ('checkpoint', 'succeed', 'partial', 'fail') AND st = 'running') OR (ev = 'pause' AND st IN ('queued', 'running'))
   OR (ev = 'cancel' AND st IN ('queued', 'paused', 'running')) OR (ev = 'resume' AND st = 'paused') OR (ev = 'retry' AND st IN ('failed', 'cancelled', 'partial')), false))::BIGINT,
  t FROM (SELECT e.task_id, e.n, ev, value, t, x, CASE WHEN x THEN 'queued' ELSE st END AS st, CASE WHEN x THEN 0 ELSE pr END AS pr, att, c AND NOT x AS c, p AND NOT x AS p, rej
   FROM (SELECT s.*, e.n AS m, coalesce(s.st = 'running' AND e.t - s.last > {LEASE_SECONDS}000000, false) AS x FROM s JOIN e ON e.task_id = s.task_id AND e.n = s.n + 1) s JOIN e ON e.task_id = s.task_id AND e.n = s.m))
SELECT task_id, st AS status, pr::INT AS progress, att::INT AS attempt, n AS n_events, rej AS rejected FROM s WHERE n > 0 QUALIFY n = max(n) OVER (PARTITION BY task_id)""",
    "nonce_lifetimes": f"WITH {_lives(chr(39).join(['json_extract_string(props, ', '$.k', ')']), NONCE_SECONDS)} SELECT k AS nonce, event_id, round, first AS accepted FROM s",
    "session_lifetimes": f"WITH {_lives('user_id', SESSION_SECONDS)} SELECT k AS user_id, round AS session, count(*) AS n_uses, min(event_id) AS first_event FROM s GROUP BY 1, 2",
    "ordered_delivery": """WITH e AS (SELECT (user_id % 40)::VARCHAR || '/' || event_type AS trace, json_extract_string(props, '$.k')::BIGINT AS sequence, event_id FROM events),
l AS (SELECT trace, sequence, min(CASE WHEN event_id % 97 = 0 THEN 'error' WHEN event_id % 13 = 0 THEN 'done' WHEN sequence < 3 THEN 'stage' ELSE 'token' END) AS kind FROM e GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY sequence) AS n FROM l), c AS (SELECT * FROM g WHERE n = sequence + 1),
d AS (SELECT *, coalesce(max((kind IN ('done', 'error'))::INT) OVER (PARTITION BY trace ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM c)
SELECT trace, sequence, kind FROM d WHERE over = 0""",
}
