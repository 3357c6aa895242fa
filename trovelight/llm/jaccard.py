"""Self-join of documents on the Jaccard similarity of their word n-grams, by chosen paths.

Copies (equal sets of n-grams) form classes first. The sets of the class representatives are sampled by min-wise hashing into
a fixed number of coordinates. A run begins with all sets in one bucket; a bucket is split along two
coordinates that a hash of its path chooses, so that sets sharing a sampled n-gram meet in a child bucket. Splitting ends when a bucket is
small or no longer shrinks; then all pairs of the bucket are compared, each pair only in the first bucket that its two sets share. As many runs
are made as the target recall needs. Pairs whose samples agree too rarely for the threshold are dismissed; the sets of the others are verified as a whole.
A bucket that stays large is compared in pairs of blocks of a bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.llm import common
from trovelight.llm.linefreq import words

SHINGLE = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.9999
COORDINATES = 32
#: Coordinates along which a bucket is split.
BRANCH = 2
#: Buckets of at most this many sets are verified; larger ones are split up to DEPTH levels.
SMALL_BUCKET = 48
DEPTH = 4
#: Sets of a large bucket, and n-grams in all of them, that one task holds at about from either side of a pair of blocks.
BLOCK, BLOCK_NGRAMS = 4_096, 2_000_000
#: Bytes of an n-gram's hash that travel to the verification; 8 are all of it.
HASH_BYTES = 8
#: Share of the pairs at the threshold that the comparison of samples may dismiss.
SAMPLE_MISS = 1e-5

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-grams of a text given the hashes of its words, sorted."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        h = _mix(h * _MIX + hashes[k : len(hashes) - n + 1 + k])
    return np.unique(h)


def _agreeing(similarity: float) -> np.ndarray:
    """Chance that 0 to COORDINATES samples of two sets of that similarity agree."""
    return np.array([math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in range(COORDINATES + 1)])


def runs_for(recall: float, similarity: float) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``; all runs draw on the same samples."""
    share, miss = np.arange(COORDINATES + 1) / COORDINATES, np.zeros(COORDINATES + 1)
    for _ in range(DEPTH):  # a path is lost if no chosen coordinate agrees, or all that agree are lost later
        miss = (1 - share + share * miss) ** BRANCH
    chance, runs = _agreeing(similarity), 1
    while (chance * miss**runs).sum() > 1 - recall and runs < 64:
        runs += 1
    return runs


def least_agreeing(similarity: float) -> int:
    """Samples that agree in all but SAMPLE_MISS of the pairs at the threshold."""
    return int(np.searchsorted(np.cumsum(_agreeing(similarity)), SAMPLE_MISS))


def _texts(batch: pa.RecordBatch, column: str = "w") -> Iterator[np.ndarray]:
    """The word hashes of each row from a list column."""
    hashes = batch.column(batch.schema.get_field_index(column))
    flat = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.concatenate([[0], np.cumsum(np.asarray(hashes.value_lengths().fill_null(0)))])
    for a, b in zip(ends[:-1], ends[1:]):
        yield flat[a:b]


def _fingerprints(s: np.ndarray, w: np.ndarray) -> tuple[int, int]:
    """Two hashes of the set of n-grams; where there is none, of the words in their order."""
    basis = s if len(s) else _mix(w * np.arange(1, 2 * len(w), 2, dtype=np.uint64) + np.uint64(len(w)))
    return (int(_mix(basis).sum().view(np.int64)), int(_mix(basis * _MIX + np.uint64(1)).sum().view(np.int64))) if len(basis) else (0, 0)


def signatures(rows: DataFrame, n: int) -> DataFrame:
    """row, t, n_shingles, f1, f2 (fingerprints of the set) and sig (its COORDINATES min-wise samples) for rows (row, t, w word hashes)."""
    salts = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _MIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, prints, sig = [], [], []
            for w in _texts(batch):
                s = shingles(w, n)
                size.append(len(s))
                prints.append(_fingerprints(s, w))
                # A sample at a time, so that a very long text takes no more than a few times its own length.
                sig.append(np.array([((s ^ salt) * _MIX >> np.uint64(32)).min() for salt in salts]).astype(np.uint32).view(np.int32) if len(s) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(size, pa.int32()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(sig, pa.list_(pa.int32()))],
                ["row", "t", "n_shingles", "f1", "f2", "sig"],
            )

    return rows.mapInArrow(run, "row long, t long, n_shingles int, f1 long, f2 long, sig array<int>")


def whole(rows: DataFrame, n: int, hash_bytes: int) -> DataFrame:
    """(rep, s): packed n-gram hashes of rows (rep, w word hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(shingles(w, n), hash_bytes) for w in _texts(batch)], pa.binary())], ["rep", "s"])

    return rows.mapInArrow(run, "rep long, s binary")


def _packed(s: np.ndarray, hash_bytes: int) -> bytes:
    """The upper ``hash_bytes`` of each hash; six tell the n-grams of two texts apart but for some 1 in 10**9 pairs of a thousand words."""
    short = np.unique(s >> np.uint64(8 * (8 - hash_bytes)))
    return short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :hash_bytes].tobytes()


def _unpacked(data: bytes, hash_bytes: int) -> np.ndarray:
    short = np.frombuffer(data, np.uint8).reshape(-1, hash_bytes)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :hash_bytes] = short
    return wide.view("<u8").ravel()


def _word_hashes(text: Column) -> Column:
    return F.transform(words(F.coalesce(text.cast("string"), F.lit(""))), lambda w: F.xxhash64(w))


def _split(paths: DataFrame, sigs: DataFrame) -> DataFrame:
    """Children of (path, rep, size): BRANCH coordinates, chosen by a hash of the path, and the set's values there."""
    joined = paths.join(sigs, "rep")
    picks = [F.pmod(F.xxhash64("path", F.lit(i)), F.lit(COORDINATES)) for i in range(BRANCH)]
    picks[1] = F.pmod(picks[0] + 1 + F.pmod(F.xxhash64("path", F.lit(1)), F.lit(COORDINATES - 1)), F.lit(COORDINATES))
    child = F.explode(F.array(*[F.xxhash64("path", p, F.get("sig", p.cast("int"))) for p in picks]))
    return joined.select(child.alias("path"), "rep", F.col("size").alias("parent_size"), "n_shingles")


def leaf_buckets(sigs: DataFrame, runs: int) -> DataFrame:
    """(path, rep, size, ngrams): the buckets of two or more sets in which splitting ended, with the n-grams in all of their sets."""
    total = sigs.count()
    roots = sigs.select("rep").withColumn("path", F.explode(F.array(*[F.xxhash64(F.lit("run"), F.lit(i)) for i in range(runs)]))).withColumn("size", F.lit(total).cast("long"))
    level, leaves = roots, None
    for depth in range(DEPTH):
        children = common.materialize(_split(level, sigs), "paths")
        sizes = common.materialize(children.groupBy("path").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("ngrams")).filter("size > 1"), "path-sizes")
        sized = common.materialize(common.join_heavy(children, sizes, ["path"], "size"), "sized-paths")
        done = (F.col("size") <= SMALL_BUCKET) | (F.col("size") * 2 > F.col("parent_size")) if depth < DEPTH - 1 else F.lit(True)
        here = sized.filter(done).select("path", "rep", "size", "ngrams")
        leaves = here if leaves is None else leaves.unionByName(here)
        level = sized.filter(~done).select("path", "rep", "size")
        if depth < DEPTH - 1 and level.isEmpty():
            break
    return distinct_buckets(common.materialize(leaves, "leaves"))


def distinct_buckets(leaves: DataFrame) -> DataFrame:
    """Small buckets that hold the very same sets, as those of sets that differ little often do, become one; large ones all stay."""
    few = leaves.filter(F.col("size") <= SMALL_BUCKET)
    members = [F.bit_xor(F.xxhash64("rep", F.lit(i))) for i in (1, 2)]
    buckets = few.groupBy("path").agg(F.count("*").alias("n"), members[0].alias("m1"), members[1].alias("m2"))
    kept = buckets.groupBy("n", "m1", "m2").agg(F.min("path").alias("path")).select("path")
    return common.materialize(few.join(kept, "path").unionByName(leaves.filter(F.col("size") > SMALL_BUCKET)), "kept-leaves")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each key (the first ``n_keys`` long columns) of a stream that is sorted by them."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, bool)
        for i in range(n_keys):
            new |= np.diff(batch.column(i).to_numpy()) != 0
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
        rest = batch.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


class _Bucket:
    """The sets of a bucket, or of two of its blocks, and which pairs of them are its own: those whose first common bucket it is."""

    def __init__(self, rows: pa.RecordBatch, similarity: float):
        column = lambda name: rows.column(rows.schema.get_field_index(name))
        a, b, here = column("a")[0].as_py(), column("b")[0].as_py(), column("path")[0].as_py()
        order = np.argsort(column("rep").to_numpy())
        self.order, self.reps = order, column("rep").to_numpy()[order]
        self.lens = column("n_shingles").to_numpy()[order].astype(np.int64)
        self.side = None if a == b else column("block").to_numpy()[order] == b
        self.n, self.similarity = len(order), similarity
        # A bucket that both sets have and that sorts before this one has seen the pair.
        lists = column("paths")
        ends, flat = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), lists.flatten().to_numpy()
        owner, earlier = np.repeat(np.arange(self.n), np.diff(ends)), flat < here
        names, coded = np.unique(flat[earlier], return_inverse=True)
        shared = np.bincount(coded, minlength=len(names)) > 1
        place = np.cumsum(shared) - 1
        kept = shared[coded] if len(names) else np.zeros(0, bool)
        has = np.zeros((self.n, int(shared.sum())), np.float32)
        has[owner[earlier][kept], place[coded[kept]]] = 1
        self.has = has[order]

    def own(self, i: int) -> np.ndarray:
        """Which later sets make a pair of this bucket with set ``i``, by earlier buckets, blocks and sizes."""
        later = np.arange(self.n) > i
        if self.has.shape[1]:
            later &= (self.has @ self.has[i]) == 0
        if self.side is not None:
            later &= self.side != self.side[i]
        return later & (np.minimum(self.lens, self.lens[i]) >= self.similarity * np.maximum(self.lens, self.lens[i]))


def _plausible(bucket: _Bucket, sig: np.ndarray, least: int) -> np.ndarray:
    """Which sets have a pair in the bucket whose samples agree in ``least`` places."""
    found = np.zeros(bucket.n, bool)
    for i in range(bucket.n - 1):
        js = np.flatnonzero(bucket.own(i))
        if len(js):
            js = js[(sig[js] == sig[i]).sum(1) >= least]
            found[js] = True
            found[i] |= bool(len(js))
    return found


def _verify(bucket: _Bucket, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(new links of each set, the least set of its linked part of the bucket)."""
    n, lens = bucket.n, np.array([len(s) for s in sets])
    ends = np.concatenate([[0], np.cumsum(lens)])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(flat.max() + 1 if len(flat) else 1, np.int32)
    links, least = np.zeros(n, np.int64), list(range(n))

    def root(i: int) -> int:
        while least[i] != i:
            least[i] = least[least[i]]
            i = least[i]
        return i

    for i in range(n - 1):
        js = np.flatnonzero(bucket.own(i))
        if not len(js):
            continue
        mine = flat[ends[i] : ends[i + 1]]
        mark[mine] = 1
        if len(js) * 4 > n:
            shared = np.add.reduceat(mark[flat], ends[:-1])[js]
        else:
            shared = np.array([mark[flat[ends[j] : ends[j + 1]]].sum() for j in js])
        mark[mine] = 0
        js = js[shared >= bucket.similarity * (lens[i] + lens[js] - shared) - 1e-9]
        links[js] += 1
        links[i] += len(js)
        for j in js.tolist():
            x, y = root(i), root(j)
            least[max(x, y)] = min(x, y)
    return links, np.array([root(i) for i in range(n)], np.int64)


def candidate_sets(leaves: DataFrame, sigs: DataFrame, similarity: float) -> DataFrame:
    """(path, a, b, block, rep, n_shingles, paths): the sets of a bucket, or of two of its blocks, that may be similar to another one there.

    ``leaves(path, rep, size, ngrams)``; ``sigs(rep, n_shingles, sig)``.
    """
    paths = leaves.groupBy("rep").agg(F.sort_array(F.collect_set("path")).alias("paths"))  # a set has a bounded number of paths
    # Blocks: block a meets block b for a <= b.
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("ngrams") / BLOCK_NGRAMS)).cast("int")
    rows = leaves.withColumn("n_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(17)), F.col("n_blocks")))
    rows = rows.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda b: F.struct(F.least(b.cast("long"), F.col("block")).alias("a"), F.greatest(b.cast("long"), F.col("block")).alias("b")))))
    rows = rows.join(sigs.join(paths, "rep"), "rep").select("path", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "block", "rep", "n_shingles", "paths", "sig")
    least = least_agreeing(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            if rows.num_rows > 1:
                bucket = _Bucket(rows, similarity)
                sig = rows.column(7).flatten().to_numpy().reshape(-1, COORDINATES)[bucket.order]
                found = bucket.order[_plausible(bucket, sig, least)]
                if len(found):
                    yield rows.select(range(7)).take(pa.array(np.sort(found)))

    dealt = rows.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b")
    return dealt.mapInArrow(run, "path long, a long, b long, block long, rep long, n_shingles int, paths array<long>")


def similar_links(candidates: DataFrame, sets: DataFrame, similarity: float, hash_bytes: int) -> DataFrame:
    """(rep, links, least): per candidate and bucket, its new similar sets and the least set of its linked part of the bucket.

    ``candidates`` as of ``candidate_sets``; ``sets(rep, s)`` packed n-gram hashes. The rows grow with the sets, not with the pairs.
    """
    rows = candidates.join(sets, "rep").select("path", "a", "b", "block", "rep", "n_shingles", "paths", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            bucket = _Bucket(rows, similarity)
            packed = rows.column(7)
            links, least = _verify(bucket, [_unpacked(packed[int(i)].as_py(), hash_bytes) for i in bucket.order])
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(bucket.reps[some]), pa.array(links[some]), pa.array(bucket.reps[least[some]])], ["rep", "links", "least"])

    return rows.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b").mapInArrow(run, "rep long, links long, least long")


def components(edges: DataFrame, nodes: str = "rep") -> DataFrame:
    """(rep, root): the least member of each connected part of ``edges(u, v)``, by alternating large and small stars."""
    edges = common.materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # Large star: neighbours above a node move to its least neighbour; small star: those below do.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = common.materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        nxt = common.materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        same = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first() == edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        edges = nxt
        if same:
            return edges.select(F.col("u").alias(nodes), F.col("v").alias("root"))


def _text_hash(text: Column) -> Column:
    """Tells the rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _classes(docs: DataFrame, n: int, similarity: float, recall: float, hash_bytes: int) -> DataFrame:
    """row, t (hash of the text), class_key, class_id, copy_id, n_links of each row; class_key is unique to a class."""
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), _text_hash(F.col("text")).alias("t"), _word_hashes(F.col("text")).alias("w"))
    signed = common.materialize(signatures(rows, n), "signatures")
    # Copies are combined before the shuffle. Two fingerprints and a size tell sets apart; rep is the number of a set, so that none are mixed up from here on.
    first = F.min(F.when(F.col("row").isNotNull(), F.struct("row", "t"))).alias("first")
    sets = signed.groupBy("f1", "f2", "n_shingles").agg(F.count("*").alias("n_rows"), first, F.min_by("sig", "row").alias("sig"))
    sets = common.materialize(sets.select("f1", "f2", "n_shingles", "n_rows", F.col("first.row").alias("copy_id"), F.col("first.t").alias("copy_t"), "sig", F.monotonically_increasing_id().alias("rep")), "sets")
    sigs = sets.filter((F.col("n_shingles") > 0) & F.col("copy_id").isNotNull()).select("rep", "n_shingles", "sig")
    leaves = leaf_buckets(sigs, runs_for(recall, similarity))
    candidates = common.materialize(candidate_sets(leaves, sigs, similarity), "candidates")
    needed = sets.join(candidates.select("rep").distinct(), "rep", "left_semi").select(F.col("copy_id").alias("row"), F.col("copy_t").alias("t"), "rep")
    needed = common.materialize(needed, "needed")
    wanted = docs.select(F.col("doc_id").cast("long").alias("row"), _text_hash(F.col("text")).alias("t"), "text")
    wanted = wanted.join(common.maybe_broadcast(needed), ["row", "t"]).select("rep", _word_hashes(F.col("text")).alias("w"))
    whole_sets = whole(wanted, n, hash_bytes)
    if signed.select("row", "t").join(common.maybe_broadcast(needed), ["row", "t"]).count() > needed.count():  # the same row more than once
        whole_sets = common.materialize(whole_sets, "whole-sets").dropDuplicates(["rep"])
    links = common.materialize(similar_links(candidates, whole_sets, similarity, hash_bytes), "links")
    roots = components(links.select(F.col("rep").alias("u"), F.col("least").alias("v")))
    counted = links.groupBy("rep").agg(F.sum("links").alias("n_links")).join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    linked = sets.select("rep", "copy_id").join(counted, "rep")
    named = common.materialize(linked.groupBy("root").agg(F.min("copy_id").alias("class_id")), "class-names")
    linked = common.join_hot(linked, named, ["root"], "inner", F.col("rep")).select("rep", "root", "class_id", "n_links")
    classes = sets.drop("sig", "copy_t").join(linked, "rep", "left").select(
        "f1", "f2", "n_shingles", "n_rows", "copy_id", F.coalesce("root", "rep").alias("class_key"), F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    classes = common.materialize(classes, "classes")
    return common.join_heavy(signed.drop("sig"), classes, ["f1", "f2", "n_shingles"], "n_rows").select("row", "t", "class_key", "class_id", "copy_id", "n_links")


def similarity_classes(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY, recall: float = TARGET_RECALL, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """Row-wise result for ``docs(doc_id, text)``: doc_id, class_id, copy_id, n_links.

    Documents with the same set of n-grams are copies: copy_id is their least doc_id. n_links counts the other sets (different texts) at
    ``similarity`` or more; class_id is the least doc_id of all that links and copies connect. Texts shorter than n words are copies only of
    texts with the same words; a null text counts as empty, and all texts without a word are copies. Repeated rows are kept; a null doc_id keeps its row
    with its own class null. Long texts take part whole. Other columns are ignored; an empty table gives an empty result.
    """
    return _classes(docs, n, similarity, recall, hash_bytes).select(F.col("row").alias("doc_id"), "class_id", "copy_id", "n_links")


def first_of_classes(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY, recall: float = TARGET_RECALL, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """One row of ``docs(doc_id, text, ...)`` of each class of near duplicates, with all its columns: the one with the least doc_id.

    Where several texts of a class bear that id, one of them stays, and so does one of rows that repeat. Rows without a doc_id take no part and stay.
    """
    found = common.materialize(_classes(docs, n, similarity, recall, hash_bytes).filter("row is not null").select("row", "t", "class_key"), "class-rows")
    kept = found.groupBy("class_key").agg(F.min(F.struct("row", "t")).alias("r")).select("r.*").distinct()
    row, t = common.free(docs, "row", "t")
    kept = common.materialize(kept.select(F.col("row").alias(row), F.col("t").alias(t)), "kept-rows")
    keyed = docs.filter(F.col("doc_id").isNotNull()).withColumns({row: F.col("doc_id").cast("long"), t: _text_hash(F.col("text"))})
    out = keyed.join(common.maybe_broadcast(kept), [row, t])
    if found.select(F.col("row").alias(row), F.col("t").alias(t)).join(common.maybe_broadcast(kept), [row, t], "left_semi").count() > kept.count():
        out = out.dropDuplicates([row, t])
    return out.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
