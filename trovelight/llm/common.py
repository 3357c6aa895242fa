"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when its measured rows are at most this many.
BROADCAST_ROWS = 500_000
#: Rows and bytes of an Arrow batch that carries whole texts.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 1_000, 8 << 20

_OWN: dict[str, str | None] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent on a single machine (tests) a temporary folder is made; on a cluster that is an error,
    since each executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _OWN.setdefault("dir", None) or f"file://{tempfile.mkdtemp(prefix='trovelight-')}"
        _OWN["dir"] = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (materialised) table has at most ``rows`` rows."""
    return df.count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting; a larger table joins by shuffle."""
    return F.broadcast(df) if small(df, rows) else df


def lean_batches(query):
    """For queries whose session is their own: Arrow batches of at most TEXT_BATCH_ROWS rows and TEXT_BATCH_BYTES, as rows of whole texts are large."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        for setting, most in (("maxRecordsPerBatch", TEXT_BATCH_ROWS), ("maxBytesPerBatch", TEXT_BATCH_BYTES)):
            now = spark.conf.get(f"spark.sql.execution.arrow.{setting}", None)
            if now is None or not now.isdigit() or not 0 < int(now) <= most:
                spark.conf.set(f"spark.sql.execution.arrow.{setting}", most)
        return query(spark, *args)

    return run


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_text(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """The columns ``keep`` and the name of the one that holds ``text`` as a string; a kept text does not travel twice."""
    if "text" in keep and docs.schema["text"].dataType.simpleString() == "string":
        return docs.select(*keep), "text"
    (name,) = free(docs, "__text")
    return docs.select(*keep, F.col("text").cast("string").alias(name)), name


def doc_remainder(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n, the fold rule of the queries."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread: Column, rows: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Join a large table with a (materialised) lookup table unique in ``keys``, where a key may hold a third of ``left``.

    A counted, small ``right`` is broadcast. A larger one is repeated under ``salts`` salts and
    ``left`` spread over them by ``spread``, so that no key's rows meet in one task.
    """
    if small(right, rows):
        return left.join(F.broadcast(right), keys, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], counts: str, share: int = 10_000) -> DataFrame:
    """Inner join with a lookup table unique in ``keys`` whose column ``counts`` says how many rows of ``left`` each key has.

    Keys with over 1/``share`` of all rows number at most ``share``, so they are broadcast; what remains is even enough to shuffle.
    """
    total = right.agg(F.sum(counts)).first()[0] or 0
    heavy = F.col(counts) > total / share
    marked = left.join(F.broadcast(right.filter(heavy).withColumn("_heavy", F.lit(True))), keys, "left")
    rest = marked.filter("_heavy is null").select(*left.columns).join(right.filter(~heavy), keys)
    done = marked.filter("_heavy is not null").drop("_heavy")
    return done.unionByName(rest.select(*done.columns))
