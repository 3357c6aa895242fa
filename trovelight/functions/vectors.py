"""Hash embeddings and vector expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from trovelight.functions import text as T

DIMENSIONS = 128
CONTRIBUTIONS = 8
#: Bytes of text that are embedded at a time.
PART_BYTES = 1 << 20


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about PART_BYTES of text each."""
    if not batch.num_rows:
        return
    group = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def hash_vectors(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """L2-normalised hash embeddings, rounded to 8 places; the zero vector without tokens.

    A token adds 1 or -1 to eight slots, from three neighbouring bytes each of its SHA-256; each distinct token is hashed once.
    """
    found = [re.findall(T.HASH_TOKEN, t.lower().replace("\u3000", " ")) if t else [] for t in texts]
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(t, len(known)) for each in found for t in each], np.int64)
    sums = np.zeros((len(texts), dimensions))
    if len(ids):
        digest = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest()[: CONTRIBUTIONS + 2] for t in known), np.uint8).reshape(-1, CONTRIBUTIONS + 2).astype(np.int64)
        slots = (digest[:, :-2] * 256 + digest[:, 1:-1]) % dimensions
        signs = np.where(digest[:, 2:] & 1, 1.0, -1.0)
        row = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        sums = np.bincount((row[:, None] * dimensions + slots[ids]).ravel(), signs[ids].ravel(), len(texts) * dimensions).reshape(-1, dimensions)
    norm = np.sqrt((sums * sums).sum(1, keepdims=True))
    return np.round(sums / np.where(norm > 0, norm, 1.0), 8)


def with_embedding(df: DataFrame, text: str, name: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """``df`` with the hash embedding (array<double>) of a string column; rows stay where they are, in one vectorised pass. Where ``df`` has that column, its nulls are filled."""
    there = name in df.columns
    names, at = df.columns if there else [*df.columns, name], df.columns.index(text)
    own = names.index(name)

    def vectors(texts: list[str | None]) -> pa.ListArray:
        v = hash_vectors(texts, dimensions)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dimensions), pa.int32()), pa.array(v.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, at):
                columns = list(part.columns)
                if there:
                    missing = columns[own].is_null().to_numpy(zero_copy_only=False)
                    place = np.where(missing, len(part) + np.cumsum(missing) - 1, np.arange(len(part)))
                    new = vectors(columns[at].filter(pa.array(missing)).to_pylist()).cast(columns[own].type)
                    columns[own] = pa.concat_arrays([columns[own], new]).take(pa.array(place))
                else:
                    columns.append(vectors(columns[at].to_pylist()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = df.select("*").schema
    return df.mapInArrow(run, schema if there else schema.add(name, ArrayType(DoubleType())))


def embed(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, embedding array<double>) for every row; a text without tokens has the zero vector."""
    return with_embedding(df.select(key, F.col(text).cast("string").alias("_text")), "_text", "embedding", dimensions).drop("_text")


def embedding_slots(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, slot, weight): the non-zero slots of the hash embedding."""
    return embed(df, key, text, dimensions).select(key, F.posexplode("embedding").alias("slot", "weight")).filter("weight != 0")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of normalised vectors; 0 where one is null or lengths differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(0.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def project(v: Column, first: list[float], second: list[float]) -> Column:
    """Point in the plane of two fixed seed vectors."""
    return F.struct(dot(v, F.array(*map(F.lit, first))).alias("x"), dot(v, F.array(*map(F.lit, second))).alias("y"))
