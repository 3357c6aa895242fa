"""Product quantisation in exact integers: codebooks by rounds over all vectors, nearest entries by partial-distance search.

A component x becomes the integer floor(scale * x), and a vector is cut into equal consecutive parts with a codebook each. A pass over the vectors
finds the nearest entry of each part: dimensions are added in descending variance over the codebook, and an entry is dropped as soon as its
sum so far strictly exceeds the best complete distance. A round sums the parts of each entry where they lie, one partial sum a task meets per entry, and only
the codebooks (entries times dimensions, whatever the number of vectors) pass through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import common

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Dimensions between two tests, and vectors that are searched at a time.
DIMS_AT_ONCE, ROWS_AT_ONCE = 4, 512
#: Integers up to this bound times the root of the dimensions of a part have squared distances below 2**62; larger ones are computed as Python integers.
SAFE = 1 << 30


def finite(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null and holds neither null nor non-finite components."""
    return vectors.filter(F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def integers(vectors: list, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, shorter vectors filled with zeros: 64-bit where that is safe, else Python integers."""
    x = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() * dims**0.5 < SAFE:
        return y.astype(np.int64)
    return np.array([[math.floor(Fraction(c) * scale) for c in row] for row in x.tolist()], object)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of ``book`` for each row of ``x``; ties to the lower index."""
    if x.dtype != book.dtype:
        x, book = x.astype(object), book.astype(object)
    dims = x.shape[1]
    order = np.argsort(-book.astype(float).var(0), kind="stable")
    x, book = x[:, order], book[:, order]
    index, best = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    for top in range(0, len(x), ROWS_AT_ONCE):
        rows = x[top : top + ROWS_AT_ONCE]
        at = np.arange(len(rows))
        width = min(DIMS_AT_ONCE, dims)
        part = np.zeros((len(rows), len(book)), x.dtype)
        for d in range(width):
            part += (rows[:, d, None] - book[:, d]) ** 2
        # The entry that is nearest so far is completed first and gives the bound.
        first = part.argmin(1)
        bound = ((rows - book[first]) ** 2).sum(1)
        alive_x, alive_e = np.nonzero(part <= bound[:, None])
        sums = part[alive_x, alive_e]
        for a in range(width, dims, DIMS_AT_ONCE):
            b = min(dims, a + DIMS_AT_ONCE)
            sums = sums + ((rows[alive_x, a:b] - book[alive_e, a:b]) ** 2).sum(1)
            stays = (sums <= bound[alive_x]).astype(bool)
            alive_x, alive_e, sums = alive_x[stays], alive_e[stays], sums[stays]
        # What is left is complete; rows stand in order of their entries, so the stable sort leaves the lower index first.
        keep = np.lexsort((alive_e, sums, alive_x)) if x.dtype != object else np.array(sorted(range(len(sums)), key=lambda i: (alive_x[i], sums[i], alive_e[i])))
        leads = keep[np.searchsorted(alive_x[keep], at)]
        index[top : top + len(rows)], best[top : top + len(rows)] = alive_e[leads], sums[leads]
    return index, best


def assigner(books: list[np.ndarray], dims: int, scale: int) -> Callable[[list], tuple[np.ndarray, list, list]]:
    """For a batch of vectors: (their integers, indexes by part, distances by part)."""

    def assign(vectors: list) -> tuple[np.ndarray, list, list]:
        x = integers(vectors, dims, scale)
        found = [nearest(part, book) for part, book in zip(np.split(x, len(books), 1), books)]
        return x, [i for i, _ in found], [e for _, e in found]

    return assign


def _refined(vectors: DataFrame, books: list[np.ndarray], dims: int, scale: int) -> list[np.ndarray]:
    """Codebooks after one round over all vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        assign = assigner(books, dims, scale)
        total, count = [np.zeros(b.shape, object) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            x, index, _ = assign(batch.column(0).to_pylist())
            for p, part in enumerate(np.split(x, len(books), 1)):
                here = np.zeros(books[p].shape, part.dtype)
                np.add.at(here, index[p], part)
                total[p] += here.astype(object)
                count[p] += np.bincount(index[p], minlength=len(here))
        at = [(p, e) for p in range(len(books)) for e in np.flatnonzero(count[p])]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([p for p, _ in at], pa.int32()), "entry": pa.array([int(e) for _, e in at], pa.int32()), "n": pa.array([int(count[p][e]) for p, e in at], pa.int64()),
            "sums": pa.array([list(map(str, total[p][e])) for p, e in at], pa.list_(pa.string())),
        })

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"][:1], "entry": rows["entry"][:1], "n": [rows["n"].sum()], "sums": [[str(sum(map(int, column))) for column in zip(*rows["sums"])]]})

    # A key has a row a task at most, and what comes back is a codebook.
    schema = "part int, entry int, n long, sums array<string>"
    keyed = vectors.select("v").mapInArrow(sums, schema).groupBy("part", "entry")
    if books[0].dtype == object:
        summed = keyed.applyInPandas(merge, schema)
    else:
        summed = keyed.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[q].cast("decimal(38,0)")).cast("string") for q in range(dims // len(books)))).alias("sums"))
    after = [b.astype(object) for b in books]
    for r in summed.collect():
        after[r.part][r.entry] = [int(y) // r.n for y in r.sums]
    safe = all(abs(int(y)) * dims**0.5 < SAFE for b in after for y in b.ravel())
    return [b.astype(np.int64) if safe else b for b in after]


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, code, error, label_error, codebooks_sha256) of each kept row, the codebooks).

    Rows whose vector is null or holds null or non-finite components are dropped. Vectors shorter than the longest one, an empty one too, count as filled with zeros, and so does
    a length that ``parts`` doesn't divide. The codebooks start from the ``entries`` smallest ids, null ids last, ties to the smaller
    vector; fewer rows give fewer entries. Repeated rows each count and are each returned. Rows with a null label share one label_error. An
    error of 2**63 or more is null. An empty table gives an empty result. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part")
    spark = vectors.sparkSession
    rows = finite(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v")), "v")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if longest is None:
        return spark.createDataFrame([], schema), []
    dims = max(1, -(-longest // parts)) * parts
    start = integers([r.v for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()], dims, scale)
    books = np.split(start, parts, 1)
    for _ in range(rounds):
        books = _refined(rows, books, dims, scale)
    digest = hashlib.sha256(",".join(str(int(y)) for b in books for y in b.ravel()).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = assigner(shared.value, dims, scale)
        for batch in batches:
            _, index, errors = assign(batch.column(2).to_pylist())
            digits = ["".join(f"{i:02x}" for i in one) for one in zip(*(i.tolist() for i in index))]
            total = [str(sum(map(int, one))) for one in zip(*errors)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digits, pa.string()), pa.array(total, pa.string())], ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    coded = rows.mapInArrow(code, f"vec_id long, label {label}, code string, error string")
    coded = common.materialize(coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    exact = F.col("error").try_cast("decimal(38,0)")
    by_label = coded.groupBy("key").agg(F.when(F.count_if(exact.isNull()) == 0, F.try_sum(exact)).alias("label_error"))
    out = common.join_hot(coded, common.materialize(by_label, "label-errors"), ["key"], "left", F.col("vec_id"))
    return out.select("vec_id", "code", F.col("error").try_cast("long").alias("error"), F.col("label_error").try_cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256")), books


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL of the registered query, for vectors of one length that ``parts`` divides."""
    steps = [
        f"""WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, vec_id, label, embedding AS e, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
x AS MATERIALIZED (SELECT i, p, list_transform(e[p * w + 1 : (p + 1) * w], lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x FROM k, range({parts}) r(p)),
c0 AS MATERIALIZED (SELECT p, i - 1 AS j, x AS y FROM x WHERE i <= {entries})"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT i, p, any_value(x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, j := j)) AS m FROM x JOIN c{n} USING (p) GROUP BY i, p)""")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT p, m.j AS j, unnest(x) AS v, unnest(range(len(x))) AS q FROM a{n}),
t{n} AS (SELECT p, j, q, sum(v)::BIGINT AS s, count(*) AS n FROM s{n} GROUP BY p, j, q),
u{n} AS (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY q) AS y FROM t{n} GROUP BY p, j),
c{n + 1} AS MATERIALIZED (SELECT c.p, c.j, coalesce(u.y, c.y) AS y FROM c{n} c LEFT JOIN u{n} u ON u.p = c.p AND u.j = c.j)""")
    last = rounds
    steps.append(f"""b AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, j)) AS h FROM c{last}),
f AS (SELECT i, string_agg(lpad(to_hex(m.j), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{last} GROUP BY i)""")
    return ",\n".join(steps) + "\nSELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN f USING (i), b"


ORACLE = oracle()
