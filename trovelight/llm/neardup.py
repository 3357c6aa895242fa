"""Near duplicates among vectors by Euclidean p-stable hashing.

Vectors are normalised, so that a cosine is a distance. A table concatenates quantised random projections, floor((a v + b) / width); vectors that share
a bucket of any table are compared by their cosine in double precision. The number of projections follows from the number of vectors, so that unrelated
ones share a bucket of a steady size, and the number of tables from the chance with which a pair at the threshold is still found. A pair counts in the
first table where its vectors share a bucket, so no list of pairs is made. Equal vectors are combined before; a bucket that stays large is compared in
pairs of blocks of a bounded size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import common
from trovelight.llm.jaccard import _groups, components

SIMILARITY = 0.93
#: Chance that a pair at the threshold is not found; closer pairs are lost far more rarely.
MISS = 0.0001
#: Width of a quantisation step, in distances of a pair at the threshold.
STEP = 6.0
#: Unrelated vectors (at right angles) that share a bucket of one table, at about.
BUCKET_ROWS = 500
#: Vectors of a large bucket that one task holds at about from either side of a pair of blocks.
BLOCK = 4_000


def collision(distance: float, width: float) -> float:
    """Chance that one projection puts two points at that distance into the same step."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-(r**2) / 2))


def plan(vectors: int, similarity: float, miss: float) -> tuple[float, int, int]:
    """(width, projections of a table, tables) for that many vectors."""
    near = math.sqrt(2 - 2 * similarity)
    width = STEP * near
    projections = max(1, math.ceil(math.log(max(1.0, vectors / BUCKET_ROWS)) / -math.log(collision(math.sqrt(2), width))))
    return width, projections, max(1, math.ceil(math.log(miss) / math.log(1 - collision(near, width) ** projections)))


@functools.lru_cache(4)
def _projections(dims: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([11, dims])
    return rng.normal(size=(n, dims)).T, rng.random(n)


def normalised(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v**2).sum(1, keepdims=True))


def buckets(x: np.ndarray, width: float, projections: int, tables: int) -> np.ndarray:
    """The bucket of each normalised vector in each table, as a 64-bit hash of its steps."""
    a, b = _projections(x.shape[1], projections * tables)
    steps = np.floor(x @ a / width + b).astype(np.int64).astype(np.uint64).reshape(len(x), tables, projections)
    h = np.zeros((len(x), tables), np.uint64)
    for k in range(projections):
        h = (h ^ steps[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def linked(x: np.ndarray, copies: np.ndarray, side: np.ndarray | None, own: np.ndarray, table: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, least) of each vector of a bucket: copies of the others that are similar and share no bucket of an earlier table, and the least row of its linked part.

    ``own`` holds the buckets of each row in all tables; with ``side`` only pairs of different sides count.
    """
    close = x @ x.T >= similarity
    np.fill_diagonal(close, False)
    if side is not None:
        close &= side[:, None] != side
    some = np.flatnonzero(close.any(1))
    close, own = close[np.ix_(some, some)], own[some]
    for t in range(table):
        close &= own[:, t, None] != own[:, t]
    links, least = np.zeros(len(x), np.int64), np.arange(len(x))
    links[some] = close @ copies[some]
    root = np.arange(len(some))
    while len(some):
        lower = np.minimum(root, np.where(close, root, len(some)).min(1))
        np.minimum.at(lower, root, lower)
        lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    least[some] = some[root]
    return links, least


def link(vectors: DataFrame, similarity: float = SIMILARITY, miss: float = MISS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Row-wise result: vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable by links), kept (vec_id = component_id).

    Only vectors of the same label and length are compared. Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label or id, link with nothing and stay; a null id is its own component, null, and kept. Repeated rows are vectors of their own and
    link with each other. An empty table gives an empty result. Other columns are ignored.
    """
    v = F.col(vec_col)
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.size(v).alias("dims"), F.xxhash64(v).alias("h1"), F.xxhash64(v, F.lit(1)).alias("h2"),
        F.coalesce(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull(), F.lit(False)).alias("usable"), v.alias("v"),
    )
    key = ["label", "dims", "h1", "h2"]
    # Equal vectors are combined before the shuffle, so a common one is a row a task.
    sets = rows.filter("usable").groupBy(*key).agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.any_value("v").alias("v"))
    sets = common.materialize(sets.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    largest = sets.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 1
    width, projections, tables = plan(largest, similarity, miss)

    def hashed(with_vectors: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label, dims, rep, copies, v = (batch.column(i) for i in range(5))
                for n in np.unique(dims.to_numpy()):
                    at = np.flatnonzero(dims.to_numpy() == n)
                    found = buckets(normalised(v.take(pa.array(at)).flatten().to_numpy().astype(float).reshape(len(at), n)), width, projections, tables)
                    for t in range(tables):
                        out = [label.take(pa.array(at)), dims.take(pa.array(at)), pa.array(np.full(len(at), t, np.int32)), pa.array(found[:, t]), rep.take(pa.array(at))]
                        out += [copies.take(pa.array(at)), v.take(pa.array(at))] if with_vectors else []
                        yield pa.RecordBatch.from_arrays(out, ["label", "dims", "tab", "bucket", "rep", "copies", "v"][: len(out)])

        return run

    element = sets.schema["v"].dataType.simpleString()
    fields = "label string, dims int, tab int, bucket long, rep long"
    plain = sets.select("label", "dims", "rep", "copies", "v")
    sizes = plain.mapInArrow(hashed(False), fields).groupBy("label", "dims", "tab", "bucket").count()
    # Buckets with one vector have no pairs. Those of more than a block are few, at most one per BLOCK rows.
    large = common.materialize(sizes.filter(F.col("count") > BLOCK).select("label", "dims", "tab", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large-buckets")
    dealt = common.join_hot(plain.mapInArrow(hashed(True), f"{fields}, copies long, v {element}"), large, ["label", "dims", "tab", "bucket"], "left", F.col("rep"))
    dealt = dealt.withColumn("block", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("blocks")), F.lit(0)).cast("int"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = dealt.withColumn("other", other).select(
        F.xxhash64("label", "dims", "tab", "bucket").alias("path"), F.least("block", "other").cast("long").alias("a"), F.greatest("block", "other").cast("long").alias("b"), F.col("block").cast("long").alias("block"),
        "rep", "copies", "label", "dims", "tab", "bucket", "v",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            if group.num_rows < 2:
                continue
            dims, tab, bucket = (group.column(i).to_numpy() for i in (7, 8, 9))
            # Two buckets may share a path; they are told apart here.
            names = group.column(6).dictionary_encode()
            _, which = np.unique(np.column_stack([names.indices.to_numpy().astype(np.int64), dims, tab, bucket]), axis=0, return_inverse=True)
            for one in np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1]):
                rep = group.column(4).to_numpy()[one]
                one = one[np.argsort(rep)]
                rep = np.sort(rep)
                x = normalised(group.column(10).take(pa.array(one)).flatten().to_numpy().astype(float).reshape(len(one), dims[one[0]]))
                side = None if group.column(1)[0] == group.column(2)[0] else group.column(3).to_numpy()[one] == group.column(2)[0].as_py()
                links, least = linked(x, group.column(5).to_numpy()[one], side, buckets(x, width, projections, tables), int(tab[one[0]]), similarity)
                some = np.flatnonzero(links)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[least[some]])], ["rep", "links", "least"])

    found = paired.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b").mapInArrow(run, "rep long, links long, least long")
    links = common.materialize(found, "vector-links")
    roots = components(links.select(F.col("rep").alias("u"), F.col("least").alias("v")))
    counted = links.groupBy("rep").agg(F.sum("links").alias("links")).join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    ends = sets.select("rep", "first").join(counted, "rep")
    named = common.materialize(ends.groupBy("root").agg(F.min("first").alias("component")), "component-names")
    ends = common.join_hot(ends, named, ["root"], "inner", F.col("rep")).select("rep", "links", "component")
    classes = sets.select(*key, "copies", "rep", "first").join(ends, "rep", "left")
    classes = classes.select(*key, "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    out = common.join_heavy(rows.filter("usable").select("vec_id", *key), common.materialize(classes, "vector-classes"), key, "copies").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
