"""Approximate nearest neighbours by largest inner product: inverted lists with adaptive dimension scans.

Vectors get one more coordinate that makes all norms equal, so that the largest inner product is the smallest distance.
k-means on a bounded sample gives the lists; every vector is in one. A list is dealt over chunks of a bounded size. Each query
first meets a part of the sample: its k-th best there bounds the distance of what can be among its k best, and is an answer itself. In a
chunk the rotated vectors are read in column blocks, and after each block a hypothesis test on the partial distance abandons
candidates that are unlikely to beat that bound or the k-th best so far in that chunk. While most pairs stay, a block is one product over all
of them, which costs far less a pair than reading it singly. What survives is scored exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import common

#: Bounded sample for the centroids and for the choice of the number of probed lists.
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 200
ROWS_PER_LIST, MOST_LISTS = 800, 4096
#: Vectors of the sample that every query meets for its first bound.
SEED_ROWS = 4_096
#: Vectors of a list that one task holds at a time.
CHUNK_ROWS = 4_000
#: Share of the sampled queries' neighbours whose lists are probed.
COVERED = 0.985
#: Queries that meet a chunk in one product.
QUERIES_AT_ONCE = 256
#: Candidates between two updates of the bound, and columns between two tests.
ROWS_AT_ONCE, COLUMN_BLOCK = 1_000, 16
#: Width of the hypothesis test: an estimate this many deviations too far abandons a candidate.
EPSILON = 2.1
#: Share of pairs from which a column block is read for all of them at once.
DENSE = 0.05


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): vectors that are neither null, empty nor zero and hold no null or non-finite component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))


def rotation(dims: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(dims, dims)))
    return q


def augmented(x: np.ndarray, norm: float | None) -> np.ndarray:
    """Rotated vectors with the coordinate that fills their norm up to ``norm``; queries (None) get 0 there."""
    last = np.zeros(len(x)) if norm is None else np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))
    return np.column_stack([x, last]) @ rotation(x.shape[1] + 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, in one product."""
    return np.column_stack([a, (a**2).sum(1), np.ones(len(a))]) @ np.column_stack([-2 * b, np.ones(len(b)), (b**2).sum(1)]).T


def centroids(x: np.ndarray, lists: int) -> np.ndarray:
    rng = np.random.default_rng(9)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(8):
        near = distances(x, c).argmin(1)
        n = np.bincount(near, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def probes_needed(x: np.ndarray, q: np.ndarray, c: np.ndarray, k: int) -> int:
    """Lists to probe so that COVERED of the sampled queries' k nearest lie in them."""
    home = distances(x, c).argmin(1)
    best = np.argpartition(distances(q, x), min(k, len(x) - 1), axis=1)[:, : k + 1]
    place = np.argsort(np.argsort(distances(q, c), 1), 1)
    ranks = np.sort(np.take_along_axis(place, home[best], 1).ravel())
    return int(ranks[int(COVERED * (len(ranks) - 1))]) + 1


def seeds(ids: np.ndarray, x: np.ndarray, xr: np.ndarray, qids: np.ndarray, q: np.ndarray, qr: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """What some vectors with different ids tell of some queries: (bounds, ids, scores).

    The bound of a query is a squared distance that its k best don't exceed, infinite where there are too few vectors; ids and scores are its k best of these vectors.
    """
    near = distances(qr, xr)
    if len(ids) > k:
        at = np.argpartition(near, k, 1)[:, : k + 1]
        # Both forms of a distance are off by some roundings of the squares that it is made of.
        most = np.take_along_axis(near, at, 1).max(1) + 1e-11 * ((qr**2).sum(1) + (xr**2).sum(1).max())
    else:
        at, most = np.tile(np.arange(len(ids)), (len(q), 1)), np.full(len(q), np.inf)
    got, scores = [], []
    for i, one in enumerate(at):
        one = one[ids[one] != qids[i]]
        score = (x[one] * q[i]).sum(1)
        order = np.lexsort((ids[one], -score))[:k]
        got.append(ids[one[order]])
        scores.append(score[order])
    return most, got, scores


def scan(ids: np.ndarray, x: np.ndarray, xr: np.ndarray, qids: np.ndarray, q: np.ndarray, qr: np.ndarray, k: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of one chunk for each of some queries that are no farther than ``most``: (query index, ids, scores), score descending, ties to the smaller id.

    The first rows are read whole and give a bound; each block of rows after them is read by column blocks, and what survives tightens the bound for the next block.
    """
    dims, n = xr.shape[1], len(ids)
    first = min(n, max(8 * k, ROWS_AT_ONCE // 4))
    seen = distances(qr, xr[:first])
    best = np.full((len(q), k + 1), np.inf)  # the k + 1 smallest distances so far, the query's own perhaps among them
    rounding = 1e-12 * ((qr**2).sum(1) + ((xr**2).sum(1).max() if n else 0))

    def keep(near: np.ndarray) -> None:
        both = np.concatenate([best, near], 1)
        best[:] = np.partition(both, k, 1)[:, : k + 1]

    keep(seen)
    bound = np.minimum(best.max(1), most)
    slack = lambda: 1e-9 * (1 + np.where(np.isfinite(bound), np.abs(bound), 0.0)) + rounding
    near_q, near_x = np.nonzero(seen <= (bound + slack())[:, None])
    at_q, at_x = [near_q], [near_x]
    for top in range(first, n, ROWS_AT_ONCE):
        rows = xr[top : top + ROWS_AT_ONCE]
        limit = lambda b: (bound * (b / dims) * (1 + EPSILON / np.sqrt(b)) ** 2 if b < dims else bound) + slack()
        part, alive_q, alive_x, b, width = 0.0, None, None, 0, COLUMN_BLOCK
        while b < dims:
            a, b = b, min(dims, b + width)
            if alive_q is None:
                # All pairs as one product; once a test leaves few of them, these go on to the next blocks by themselves.
                part = part + distances(qr[:, a:b], rows[:, a:b])
                stays = part <= limit(b)[:, None]
                share = np.count_nonzero(stays) / stays.size
                if share < DENSE or b == dims:
                    alive_q, alive_x = np.nonzero(stays)
                    part, width = part[alive_q, alive_x], COLUMN_BLOCK
                elif share > 0.5:
                    width *= 2  # a test that abandons little isn't repeated soon
            else:
                part = part + ((qr[alive_q, a:b] - rows[alive_x, a:b]) ** 2).sum(1)
                stays = part <= limit(b)[alive_q]
                alive_q, alive_x, part = alive_q[stays], alive_x[stays], part[stays]
        at_q.append(alive_q)
        at_x.append(top + alive_x)
        if len(part):
            near = np.full((len(q), int(np.bincount(alive_q).max())), np.inf)
            near[alive_q, np.arange(len(alive_q)) - np.searchsorted(alive_q, alive_q)] = part
            keep(near)
            bound = np.minimum(best.max(1), most)
    at_q, at_x = np.concatenate(at_q), np.concatenate(at_x)
    other = ids[at_x] != qids[at_q]
    at_q, at_x = at_q[other], at_x[other]
    scores = (x[at_x] * q[at_q]).sum(1)
    order = np.lexsort((ids[at_x], -scores, at_q))
    at_q, at_x, scores = at_q[order], at_x[order], scores[order]
    place = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
    found = place < k
    return at_q[found], ids[at_x[found]], scores[found]


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of ``vectors`` for each row of ``queries`` (same columns): query_id, rank, vec_id, score.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do those that differ in length from the
    most common one, nor rows with a null id. A query never finds its own id. Ties go to the smaller vec_id. Rows that share an id are one candidate and one query: the best score
    between any two of their vectors counts, so an id is found once. Fewer than k candidates are all
    returned; without vectors the result is empty. Other columns are ignored.
    """
    spark = vectors.sparkSession
    base, asked = valid(vectors, id_col, vec_col), valid(queries, id_col, vec_col)
    # One row per vector length.
    shapes = base.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))).alias("norm2")).collect()
    if not shapes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total, norm = max(((r.dims, r.n, r.norm2**0.5) for r in shapes), key=lambda r: (r[1], -r[0]))
    base, asked = base.filter(F.size("v") == dims), asked.filter(F.size("v") == dims)
    u = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    sample = base.filter(u < 1.2 * SAMPLE_ROWS / total).limit(SAMPLE_ROWS).toArrow()
    sampled = np.array(sample["v"].to_pylist(), np.float64).reshape(-1, dims)
    x = augmented(sampled, norm)
    lists = max(1, min(MOST_LISTS, len(x) // 4, total // ROWS_PER_LIST))
    c = centroids(x, lists) if len(x) else np.zeros((1, dims + 1))
    # The queries with the least hashes: a sample that doesn't depend on the order of the table.
    drawn = asked.orderBy(F.xxhash64("vec_id", F.lit(4)), "vec_id").limit(SAMPLE_QUERIES)
    some = np.array(drawn.toArrow()["v"].to_pylist(), np.float64).reshape(-1, dims)
    probes = probes_needed(x, augmented(some, None), c, k) if lists > 1 and len(some) else lists
    shared = spark.sparkContext.broadcast(c)
    _, lone_rows = np.unique(sample["vec_id"].to_numpy(), return_index=True)
    lone_rows = lone_rows[:: -(-len(lone_rows) // SEED_ROWS) or 1]
    seed = spark.sparkContext.broadcast((sample["vec_id"].to_numpy()[lone_rows], sampled[lone_rows]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, dims)
            home = distances(augmented(v, norm), shared.value).argmin(1) if len(v) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home, pa.int32())], ["vec_id", "v", "list"])

    element = base.schema["v"].dataType.simpleString()
    homed = common.materialize(base.mapInArrow(assign, f"vec_id long, v {element}, list int"), "ann-lists")
    sizes = {r[0]: r[1] for r in homed.groupBy("list").count().collect()}  # one row per list
    count = np.array([sizes.get(i, 0) for i in range(lists)])
    chunks = np.maximum(1, -(-count // CHUNK_ROWS))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = seed.value
        xr = augmented(x, norm)
        for batch in batches:
            for a in range(0, batch.num_rows, QUERIES_AT_ONCE):
                some = batch.slice(a, QUERIES_AT_ONCE)
                q = np.array(some.column(1).to_pylist(), np.float64).reshape(-1, dims)
                most, got, scores = seeds(ids, x, xr, some.column(0).to_numpy(), q, augmented(q, None), k)
                columns = [some.column(0), some.column(1), pa.array(most), pa.array(got, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "v", "most", "ids", "scores"])

    begun = common.materialize(asked.mapInArrow(begin, f"query_id long, v {element}, most double, ids array<long>, scores array<double>"), "ann-seeds")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, dims)
            rows, where, part = [], [], []
            for i, order in enumerate(np.argsort(distances(augmented(v, None), shared.value), 1) if len(v) else []):
                enough = int(np.searchsorted(np.cumsum(count[order]), k + 1)) + 1
                for one in order[: max(probes, enough)]:
                    if count[one]:
                        rows += [i] * int(chunks[one])
                        where += [one] * int(chunks[one])
                        part += range(int(chunks[one]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(where, pa.int32()), pa.array(part, pa.int32())], ["query_id", "v", "most", "list", "chunk"])

    dealt = F.create_map(*[F.lit(int(y)) for p in enumerate(chunks) for y in p if chunks[p[0]] > 1]) if (chunks > 1).any() else None
    n_chunks = F.coalesce(F.element_at(dealt, F.col("list")), F.lit(1)) if dealt is not None else F.lit(1)
    left = homed.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "list"), n_chunks).cast("int"))
    right = begun.select("query_id", "v", "most").mapInArrow(probe, f"query_id long, v {element}, most double, list int, chunk int")

    def run(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        rows = {"query_id": [], "ids": [], "scores": []}
        if len(vs) and len(qs):
            x, ids = np.array(vs["v"].tolist(), np.float64), vs["vec_id"].to_numpy()
            # Rows that repeat are one candidate, so equal ones go; several vectors of one id make room for each other below.
            _, once = np.unique(np.column_stack([ids.astype(np.int64).view(np.float64), x]).view(np.uint64), axis=0, return_index=True)
            x, ids = x[np.sort(once)], ids[np.sort(once)]
            room = k * int(np.unique(ids, return_counts=True)[1].max())
            xr = augmented(x, norm)
            for a in range(0, len(qs), QUERIES_AT_ONCE):
                some = qs.iloc[a : a + QUERIES_AT_ONCE]
                q, qids = np.array(some["v"].tolist(), np.float64), some["query_id"].to_numpy()
                at, got, scores = scan(ids, x, xr, qids, q, augmented(q, None), room, some["most"].to_numpy())
                cuts = np.searchsorted(at, np.arange(len(q) + 1))
                for i, qid in enumerate(qids):
                    if cuts[i] < cuts[i + 1]:
                        rows["query_id"].append(qid)
                        rows["ids"].append(got[cuts[i] : cuts[i + 1]])
                        rows["scores"].append(scores[cuts[i] : cuts[i + 1]])
        return pd.DataFrame(rows)

    # A row per query and chunk, k candidates at most, and one of the seeds.
    found = left.groupBy("list", "chunk").cogroup(right.groupBy("list", "chunk")).applyInPandas(run, "query_id long, ids array<long>, scores array<double>")
    pairs = found.unionByName(begun.select("query_id", "ids", "scores")).select("query_id", F.zip_with("ids", "scores", lambda i, s: F.struct(i.alias("i"), (-s).alias("s"))).alias("p"))
    best = pairs.groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("p"))
    # The best of each id, then the best of all.
    lone = F.filter("p", lambda x, at: (at == 0) | (F.try_element_at("p", at)["i"] != x["i"]))
    best = best.select("query_id", F.slice(F.sort_array(F.transform(lone, lambda x: F.struct(x["s"].alias("s"), x["i"].alias("i")))), 1, k).alias("p"))
    ranked = best.select("query_id", F.posexplode("p").alias("rank", "p"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("p.i").alias("vec_id"), (-F.col("p.s")).alias("score"))
