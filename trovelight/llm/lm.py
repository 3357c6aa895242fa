"""Stupid-backoff language-model scores of every document, from the counts of the whole corpus.

All words that occur twice or more are told apart, at every size of input; words that occur once are equally likely members of one
unknown word. Words are coded per batch of documents; a batch asks the buckets of words for the counts of its distinct words, and then the
buckets of bigrams for the counts of its distinct bigrams, so no count table is collected or broadcast. A document's own bigrams don't count
for itself: what no other text holds backs off to the word's own share.

Words are known by hashes of 64 bits, and bigrams by a hash of both: at a billion different ones, about a 3 % chance that any two meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import common, tokens

BACKOFF = 0.4
#: Words that occur less often are unknown.
LEAST_COUNT = 2
#: Text of a batch, at about.
BATCH_BYTES = 4 << 20
#: Entries of a bucket, at about, and the least number of buckets.
BUCKET_ENTRIES, LEAST_BUCKETS = 2_000_000, 64
#: Bucket of the row that holds a batch itself.
_SELF = -1
_BATCH = "batch long, bucket long, keys binary, times binary, doc_ids array<long>, n_words array<long>"
_REPLY = "batch long, bucket long, times binary, entries long, rare_kinds long, rare_words long"


def _word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct lower-case word, index of each word, n+1 offsets)."""
    from xxhash import xxh64_intdigest

    words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = words.offsets.to_numpy()
    coded = words.values.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    hashes = np.fromiter((xxh64_intdigest(w.lower()) if w else 0 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    # An empty text yields one empty word, which is none.
    real = (hashes != 0)[index]
    before = np.concatenate([[0], np.cumsum(real)])
    return hashes, index[real], before[offsets - offsets[0]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, lowest first, as many as the largest one needs."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of hashes begins in the rising ``keys``."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def _asked(batch: int, keys: np.ndarray, times: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row per bucket with the rising ``keys`` in it, as differences, and how often each occurs in the batch."""
    cuts = _cuts(keys, buckets)
    some = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_pydict(
        {
            "batch": [batch] * len(some),
            "bucket": some.tolist(),
            "keys": [_planes(np.diff(keys[cuts[b] : cuts[b + 1]], prepend=np.uint64(0))) for b in some],
            "times": [_planes(times[cuts[b] : cuts[b + 1]]) for b in some],
        },
        schema=pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())]),
    )


def _answer(table: pa.Table) -> pa.Table:
    """The counts of one bucket over all batches, returned to each batch in the order in which it asked."""
    keys = [np.cumsum(_unplanes(k), dtype=np.uint64) for k in table["keys"].to_pylist()]
    times = np.concatenate([_unplanes(t) for t in table["times"].to_pylist()]).astype(np.int64)
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.zeros(len(distinct), np.int64)
    np.add.at(count, place, times)
    rare = count < LEAST_COUNT
    ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    first = [1] + [0] * (len(keys) - 1)  # the sums of the bucket stand in its first row
    return pa.table({
        "batch": table["batch"],
        "bucket": table["bucket"],
        "times": pa.array([_planes(count[place[a:b]]) for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
        "entries": pa.array([int(len(distinct)) * f for f in first], pa.int64()),
        "rare_kinds": pa.array([int(rare.sum()) * f for f in first], pa.int64()),
        "rare_words": pa.array([int(count[rare].sum()) * f for f in first], pa.int64()),
    })


def _coded(docs: DataFrame) -> DataFrame:
    """A row per batch of documents: its distinct words from the most frequent, the index of each word, its doc_ids and their numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part_id, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in tokens.slices(batch, "text", BATCH_BYTES):
                hashes, index, offsets = _word_codes(part.column(1))
                used, place = np.unique(hashes, return_inverse=True)
                n = np.bincount(place[index], minlength=len(used))
                order = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
                rank = np.zeros(len(used), np.int64)
                rank[order] = np.arange(len(order))
                row = {
                    "batch": [(part_id << 32) + made],
                    "bucket": [_SELF],
                    "keys": [used[order].astype("<u8").tobytes()],
                    "times": [_planes(rank[place][index])],
                    "doc_ids": [part.column(0).to_pylist()],
                    "n_words": [np.diff(offsets)],
                }
                made += 1
                yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("times", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64()))]))

    return docs.mapInArrow(run, _BATCH)


class _Batch:
    """A coded batch with the counts of its words."""

    def __init__(self, row: dict, counts: np.ndarray, rare_words: int, rare_kinds: int, total: int):
        hashes = np.frombuffer(row["keys"], "<u8")
        count = np.zeros(len(hashes), np.int64)
        count[np.argsort(hashes)] = counts
        known = count >= LEAST_COUNT
        self.doc_ids, self.lens = row["doc_ids"], np.array(row["n_words"], np.int64)
        self.word = _unplanes(row["times"]).astype(np.int64)
        self.ids = np.where(known, hashes, np.uint64(0))
        self.context = np.log(np.where(known, count, max(rare_words, 1)).astype(float))
        self.share = np.log(np.where(known, count, max(rare_words, 1) / max(1, rare_kinds)) / max(total, 1))
        doc = np.repeat(np.arange(len(self.lens)), self.lens)
        at = np.flatnonzero(doc[1:] == doc[:-1])
        key = _mix(_mix(self.ids[self.word[at]]) * np.uint64(0x9E3779B97F4A7C15) + self.ids[self.word[at + 1]])
        order = np.argsort(key, kind="stable")  # documents stay in order within a bigram
        #: Sorted bigrams, their documents, and the places of their first words.
        self.key, self.at = key[order], at[order]
        self.doc = doc[self.at]
        self.new = np.concatenate([[True], self.key[1:] != self.key[:-1]])[: len(self.key)]


def backoff_scores(docs: DataFrame, backoff: float = BACKOFF) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_words, log_score (natural log, summed) and mean_log_score (per word).

    A null or blank text has no words, log_score 0 and a null mean. Repeated rows are rows of their own, so each is evidence for the
    other. Words differ by case only as they are lowered. Long texts are scored whole. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = common.materialize(_coded(docs), "word-codes")
    total, entries = coded.select(F.coalesce(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)), F.coalesce(F.sum(F.length("keys") / 8), F.lit(0)).cast("long")).first()
    word_buckets = max(LEAST_BUCKETS, -(-entries // BUCKET_ENTRIES))
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_ENTRIES))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                hashes = np.frombuffer(row["keys"], "<u8")
                n = np.bincount(_unplanes(row["times"]).astype(np.int64), minlength=len(hashes))
                order = np.argsort(hashes)
                yield _asked(row["batch"], hashes[order], n[order], word_buckets)

    asked = "batch long, bucket long, keys binary, times binary"
    words = coded.select("batch", "keys", "times").mapInArrow(ask_words, asked).groupBy("bucket").applyInArrow(_answer, _REPLY)
    words = common.materialize(words, "word-counts")
    rare_words, rare_kinds = words.select(F.coalesce(F.sum("rare_words"), F.lit(0)), F.coalesce(F.sum("rare_kinds"), F.lit(0))).first()

    def replies(df: DataFrame, kind: int) -> DataFrame:
        return df.select("batch", (F.col("bucket") + F.lit(kind << 40)).alias("bucket"), "times")

    def read(table: pa.Table) -> tuple[_Batch, np.ndarray]:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        counts = [np.concatenate([np.zeros(0, np.int64), *(_unplanes(r["times"]).astype(np.int64) for r in rows if r["bucket"] >> 40 == kind)]) for kind in (1, 2)]
        return _Batch(rows[0], counts[0], rare_words, rare_kinds, total), counts[1]

    def ask_bigrams(table: pa.Table) -> pa.Table:
        batch, _ = read(table)
        starts = np.flatnonzero(batch.new)
        return pa.Table.from_batches([_asked(table["batch"][0].as_py(), batch.key[starts], np.diff(starts, append=len(batch.key)), buckets)])

    def score(table: pa.Table) -> pa.Table:
        batch, counts = read(table)
        # A part is the occurrences of a bigram in a document.
        starts = np.flatnonzero(batch.new | np.concatenate([[True], batch.doc[1:] != batch.doc[:-1]])[: len(batch.key)])
        own = np.diff(starts, append=len(batch.key))
        at = batch.at[starts]
        others = counts[np.cumsum(batch.new)[starts] - 1] - own
        seen = np.log(np.maximum(others, 1)) - batch.context[batch.word[at]]
        s = np.where(others > 0, seen, np.log(backoff) + batch.share[batch.word[at + 1]])
        sums = np.bincount(batch.doc[starts], own * s, len(batch.lens))
        some = batch.lens > 0
        sums[some] += batch.share[batch.word[(np.cumsum(batch.lens) - batch.lens)[some]]]
        mean = pa.array(sums / np.maximum(batch.lens, 1), pa.float64(), mask=~some)
        return pa.Table.from_arrays([pa.array(batch.doc_ids, pa.int64()), pa.array(batch.lens, pa.int64()), pa.array(sums, pa.float64()), mean], ["doc_id", "n_words", "log_score", "mean_log_score"])

    with_words = coded.unionByName(replies(words, 1), allowMissingColumns=True)
    bigrams = common.materialize(with_words.groupBy("batch").applyInArrow(ask_bigrams, asked).groupBy("bucket").applyInArrow(_answer, _REPLY).select("batch", "bucket", "times"), "bigram-counts")
    both = with_words.unionByName(replies(bigrams, 2), allowMissingColumns=True)
    return both.groupBy("batch").applyInArrow(score, "doc_id long, n_words long, log_score double, mean_log_score double")


#: Scores to six places, as the registered query gives them.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
o AS (SELECT r, unnest(generate_series(1, len(w))) AS i, lower(unnest(w)) AS w FROM d),
total AS (SELECT count(*) AS n FROM o),
c AS (SELECT w, count(*) AS n FROM o GROUP BY w),
rare AS (SELECT coalesce(sum(n), 0) AS words, count(*) AS kinds FROM c WHERE n < {LEAST_COUNT}),
v AS (SELECT w, CASE WHEN c.n >= {LEAST_COUNT} THEN w ELSE '' END AS known,
             ln(CASE WHEN c.n >= {LEAST_COUNT} THEN c.n ELSE greatest(rare.words, 1) END::DOUBLE) AS context,
             ln(CASE WHEN c.n >= {LEAST_COUNT} THEN c.n::DOUBLE ELSE greatest(rare.words, 1)::DOUBLE / greatest(rare.kinds, 1) END / total.n) AS share
      FROM c, rare, total),
t AS (SELECT r, i, known, context, share, lag(known) OVER x AS before, lag(context) OVER x AS before_context FROM o JOIN v USING (w) WINDOW x AS (PARTITION BY r ORDER BY i)),
own AS (SELECT r, before, known, before_context, share, count(*) AS n FROM t WHERE i > 1 GROUP BY ALL),
held AS (SELECT before, known, sum(n) AS n FROM own GROUP BY before, known),
s AS (SELECT r, own.n * CASE WHEN held.n > own_n THEN ln((held.n - own_n)::DOUBLE) - before_context ELSE ln({BACKOFF}::DOUBLE) + share END AS x
      FROM (SELECT *, sum(n) OVER (PARTITION BY r, before, known) AS own_n FROM own) own JOIN held USING (before, known)
      UNION ALL SELECT r, share FROM t WHERE i = 1),
sums AS (SELECT r, sum(x) AS x FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(x, 0), 6) AS log_score,
       CASE WHEN len(w) > 0 THEN round(x / len(w), 6) END AS mean_log_score
FROM d LEFT JOIN sums USING (r)
"""
