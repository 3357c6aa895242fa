"""Phrase collocations by pivot partitioning.

Every occurrence of an n-gram is owned by its pivot, its rarest word (the first one, where it occurs twice in the n-gram). Texts are rewritten into
fragments: around each word, the words before it that are more frequent and those after it that aren't rarer, at most ``longest - 1`` on either side, so a fragment of a pivot holds
exactly the n-grams that this occurrence owns. Fragments are routed by their pivot, equal ones of a batch once with their number: a pivot with many by itself, the
others together with those of the same bucket of hashes, whose number follows the words of the corpus. N-grams of a pivot are counted where its fragments meet; since all of them meet there, only frequent n-grams leave the task. How rare a word is comes from a
table of hashed counts of a fixed size: an upper bound of its count, so that no frequent word is taken for a rare one, and the
same for all its occurrences, so that the pivot of an n-gram is the same everywhere. Counts of n-grams and words are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelight.llm import common

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
#: Hashed counters of words, as powers of two; each is a byte in the table that goes to all tasks.
COUNTER_BITS = 21
#: Steps of a counter's level for each doubling of its count.
LEVEL_STEPS = 8
#: Bytes of text that are cut into fragments at a time, and of fragments that are mined at a time.
TEXT_BYTES, MINE_BYTES = 4 << 20, 4 << 20
#: Buckets of pivots of each language, at least, and bytes that a fragment is taken to have when pivots are dealt to buckets.
BUCKETS, FRAGMENT_BYTES = 1024, 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Fixed values of the contract: bytes that end a piece, and those that end a word.
_HARD = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_SOFT = np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices of ``data`` (UTF-8) as an Arrow array of strings."""
    lens = ends - starts
    before = np.concatenate([[0], np.cumsum(lens)])
    at = np.arange(before[-1]) + np.repeat(starts - before[:-1], lens)
    return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(before.astype(np.int64)), pa.py_buffer(data[at]))


class Words:
    """The words of some texts: ``words`` (distinct), ``code`` (which word), ``row`` (of which text), ``piece`` (of which piece), byte ``starts`` and ``ends`` in ``data``."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.data = _LOWER[raw]
        hard, apart = _HARD[self.data], _HARD[self.data] | _SOFT[self.data]
        inside = ~apart
        # A word begins inside at the start of a text or after a separator.
        first = np.zeros(len(raw) + 1, bool)
        first[offsets[:-1]] = True
        begins = inside & (first[:-1] | np.concatenate([[True], apart[:-1]]))
        last = np.zeros(len(raw) + 1, bool)
        last[offsets[1:]] = True
        stops = inside & (last[1:] | np.concatenate([apart[1:], [True]]))
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.piece = np.cumsum(hard)[self.starts] + self.row if len(raw) else np.zeros(0, np.int64)
        coded = _strings(self.data, self.starts, self.ends).dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy()


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """(lang, texts) of columns lang and text, gathered over batches until a language has TEXT_BYTES or all have four times as many (a batch may exceed them)."""
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}

    def flush(lang: str) -> tuple[str, pa.Array]:
        size.pop(lang)
        return lang, pa.concat_arrays(held.pop(lang))

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code = langs.indices.to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).take(pa.array(np.flatnonzero(code == i)))
            held.setdefault(lang, []).append(texts)
            size[lang] = size.get(lang, 0) + texts.nbytes
            if size[lang] >= TEXT_BYTES:
                yield flush(lang)
        while sum(size.values()) >= 4 * TEXT_BYTES:
            yield flush(max(size, key=size.get))
    for lang in list(held):
        yield flush(lang)


def _hashes(lang: str, words: list[str]) -> np.ndarray:
    """crc32 of lang and word, one after the other."""
    seed = zlib.crc32(lang.encode())
    return np.fromiter((zlib.crc32(w.encode(), seed) for w in words), np.int64, len(words))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, a): occurrences of each word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_lang(batches):
            w = Words(texts)
            n = np.bincount(w.code, minlength=len(w.words))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), w.words.cast(pa.string()), pa.array(n)], ["lang", "word", "a"])

    return docs.mapInArrow(count, "lang string, word string, a long").groupBy("lang", "word").agg(F.sum("a").alias("a"))


def _levels(words: DataFrame, min_count: int, bits: int) -> np.ndarray:
    """A byte for each counter: 0 where all its words together are too rare, else more the more they are."""
    level = F.least(F.lit(255), F.floor(LEVEL_STEPS * F.log2(F.col("a") / min_count)) + 1)
    slot = F.crc32(F.concat("lang", "word")).bitwiseAND(F.lit((1 << bits) - 1)).alias("slot")
    sums = words.groupBy(slot).agg(F.sum("a").alias("a")).filter(F.col("a") >= min_count).select("slot", level.cast("int").alias("level")).toArrow()
    table = np.zeros(1 << bits, np.uint8)
    table[sums["slot"].to_numpy()] = sums["level"].to_numpy()
    return table


def fragments(w: Words, key: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivot, left, right): positions that own n-grams, and how many words before and after belong to their fragments.

    ``key`` orders the words of each position by how frequent they are; 0 is a word that is in no frequent n-gram.
    """
    n = len(key)
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    for reach, rises, step in ((left, True, -1), (right, False, 1)):
        alive = np.flatnonzero(key > 0)
        for d in range(1, longest):
            other = alive + step * d
            alive, other = alive[(other >= 0) & (other < n)], other[(other >= 0) & (other < n)]
            goes = (w.piece[other] == w.piece[alive]) & (key[other] > key[alive] if rises else key[other] >= key[alive])
            alive = alive[goes]
            reach[alive] = d
    pivot = np.flatnonzero((left > 0) | (right > 0))
    return pivot, left[pivot], right[pivot]


def _routed(docs: DataFrame, levels, total: int, min_count: int, longest: int, partitions: int) -> DataFrame:
    """(lang, key, salt, whole, word, frags, n): of each batch, the fragments of each bucket of pivots, or of one large pivot.

    A fragment is the words before its pivot, a tab, and those after it. ``word`` lists the pivots, ``frags`` those of each joined by line feeds, ``n`` how often
    each occurs. A pivot that may fill a quarter of what is mined at a time is a key of its own. One that may hold more than half a task's share of all words is
    spread over salts, and ``whole`` is false: its n-grams are summed up again.
    """
    buckets = max(BUCKETS, -(-total * FRAGMENT_BYTES * 4 // MINE_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, salt = levels.value, TaskContext.get().partitionId()
        for lang, texts in _by_lang(batches):
            salt += 1
            w = Words(texts)
            crc = _hashes(lang, w.words.to_pylist())
            level = table[crc & (len(table) - 1)].astype(np.int64)
            of_word = np.where(level > 0, level << 32 | crc, 0)
            at, left, right = fragments(w, of_word[w.code], longest)
            if not len(at):
                continue
            data, starts, ends = _joined(w)
            coded = _strings(data, starts[at - left], ends[at + right]).dictionary_encode().indices.to_numpy()
            # The same words have the same pivot. Fragments with the same neighbours stand together, which makes them smaller on disk.
            _, first, n = np.unique(coded, return_index=True, return_counts=True)
            at, left, right = at[first], left[first], right[first]
            pivot = of_word[w.code[at]]
            most = min_count * 2.0 ** ((pivot >> 32) / LEVEL_STEPS)
            # Levels are 1 or more, so keys of single pivots are past those of buckets.
            key = np.where(most * FRAGMENT_BYTES * 4 > MINE_BYTES, pivot, (pivot & 0xFFFFFFFF) % buckets)
            beside = np.where(left > 0, w.code[at - 1], -1), np.where(right > 0, w.code[np.minimum(at + 1, len(w.code) - 1)], -1)
            order = np.lexsort((*beside, w.code[at], key))
            at, left, right, n, key, most = at[order], left[order], right[order], n[order], key[order], most[order]
            before = _strings(data, starts[at - left], np.where(left > 0, starts[at] - 1, starts[at]))
            after = _strings(data, np.where(right > 0, ends[at] + 1, ends[at]), ends[at + right])
            frags = pc.binary_join_element_wise(before, after, pa.scalar("\t", pa.large_string())).cast(pa.string())
            word = w.code[at]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1, [len(word)]])
            word, key, most = word[cuts[:-1]], key[cuts[:-1]], most[cuts[:-1]]
            rows = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            key, most, of_row = key[rows[:-1]], most[rows[:-1]], pa.array(rows, pa.int32())
            salts = np.where(key >> 32 > 0, np.maximum(1, np.ceil(most * 2 * partitions / total)), 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array((salt % salts).astype(np.int32)), pa.array(salts == 1),
                pa.ListArray.from_arrays(of_row, w.words.take(pa.array(word)).cast(pa.string())),
                pa.ListArray.from_arrays(of_row, pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), frags), "\n")),
                pa.ListArray.from_arrays(pa.array(cuts[rows], pa.int32()), pa.array(n, pa.int32())),
            ], ["lang", "key", "salt", "whole", "word", "frags", "n"])

    return docs.mapInArrow(cut, "lang string, key long, salt int, whole boolean, word array<string>, frags array<string>, n array<int>")


def _joined(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends) of all words joined by single spaces."""
    lens = w.ends - w.starts
    starts = np.cumsum(lens + 1) - lens - 1
    data = np.full(int((lens + 1).sum()), 32, np.uint8)
    at = np.repeat(w.starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
    data[np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())] = w.data[at]
    return data, starts, starts + lens


def mined(frags: pa.Array, n: np.ndarray, group: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, int]]:
    """(group, phrases, counts, words) for each length: all n-grams that hold the pivot of their fragment, the word after its tab; ``group`` is of each fragment."""
    w = Words(frags)
    data, starts, ends = _joined(w)
    pivot = np.flatnonzero((w.starts > 0) & (w.data[np.maximum(w.starts, 1) - 1] == 9))
    lefts = pivot - np.searchsorted(w.row, np.arange(len(frags)))
    rights = np.bincount(w.row, minlength=len(frags)) - lefts - 1
    for length in range(2, longest + 1):
        at, of = [], []
        for before in range(length):
            fits = np.flatnonzero((lefts >= before) & (rights >= length - before - 1))
            at.append(pivot[fits] - before)
            of.append(fits)
        at, of = np.concatenate(at), np.concatenate(of)
        if not len(at):
            continue
        # Words are numbered, and so are pairs, triples, ... one word further each time, so no two n-grams are taken for one.
        same = group[of].astype(np.int64)
        for k in range(length):
            _, same = np.unique(same * (len(w.words) + 1) + w.code[at + k], return_inverse=True)
        _, first = np.unique(same, return_index=True)
        yield group[of[first]], _strings(data, starts[at[first]], ends[at[first] + length - 1]), np.bincount(same, weights=n[of]).astype(np.int64), length


def _counted(routed: DataFrame, min_count: int, longest: int) -> DataFrame:
    """(lang, phrase, n_words, a) of the frequent n-grams."""

    def mine(rows: list[pa.RecordBatch], closed: bool) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        # An n-gram has one pivot, whose fragments have one key, so n-grams are told apart by their words within a key.
        texts = [f.replace("\t", f"\t{word} ") for word, f in zip(t.column(4).flatten().to_pylist(), t.column(5).flatten().to_pylist())]
        lists = pc.split_pattern(pa.array(texts, pa.string()), "\n")
        row = np.repeat(np.repeat(np.arange(t.num_rows), t.column(5).value_lengths().to_numpy()), lists.value_lengths().to_numpy())
        langs = t.column(0).dictionary_encode()
        _, of_key, key = np.unique(np.column_stack([langs.indices.to_numpy(), t.column(1).to_numpy()]), axis=0, return_index=True, return_inverse=True)
        lang, whole = langs.indices.to_numpy()[of_key], t.column(3).to_numpy(zero_copy_only=False)[of_key] & closed
        for group, phrases, counts, length in mined(lists.flatten(), t.column(6).flatten().to_numpy().astype(np.int64), key.ravel()[row], longest):
            columns = [langs.dictionary.take(pa.array(lang[group])), phrases.cast(pa.string()), pa.array(np.full(len(counts), length, np.int32)), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n_words", "a"]).filter(pa.array((counts >= min_count) | ~whole[group]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ``done`` holds keys that are complete, ``last`` the one that may go on; one with more than MINE_BYTES is mined in parts, which are summed up again.
        done, last, key, parted = [], [], None, False
        size = lambda rows: sum(r.column(5).nbytes for r in rows)
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, of = (batch.column(i).dictionary_encode().indices.to_numpy() for i in (0, 1))
            cuts = np.flatnonzero((np.diff(lang) != 0) | (np.diff(of) != 0)) + 1
            ends = [0, batch.num_rows] if not len(cuts) else [0, int(cuts[0]), int(cuts[-1]), batch.num_rows]
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                now = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
                if now != key:
                    if parted and last:
                        yield from mine(last, False)
                    else:
                        done += last
                    last, key, parted = [], now, False
                if i == 1 and len(ends) == 4:
                    done.append(part)
                else:
                    last.append(part)
            if size(last) >= MINE_BYTES:
                yield from mine(last, False)
                last, parted = [], True
            if size(done) >= MINE_BYTES:
                yield from mine(done, True)
                done = []
        if done:
            yield from mine(done, True)
        if last:
            yield from mine(last, not parted)

    order = ["lang", "key", "salt"]
    found = routed.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "lang string, phrase string, n_words int, a long")
    return found.groupBy("lang", "phrase", "n_words").agg(F.sum("a").alias("a")).filter(F.col("a") >= min_count)


def score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) of columns of longs, exact up to 38 digits."""
    return F.expr(f"(1000BD * cast({a} as decimal(16,0)) * cast({n} as decimal(17,0))) div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))")


def collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP, inside: int = 100, bits: int = COUNTER_BITS) -> DataFrame:
    """The collocations of each language of ``docs(text, lang)``: lang, rank, phrase, a, l, r, n, score.

    Texts lose the case of A-Z and are split into pieces at ``. , ; : ! ?`` and line ends, pieces at spaces and tabs into words. n are the words of a language, a the
    occurrences of a phrase of 2 to ``longest`` words within pieces, at least ``min_count``; the lowest floor(1000 a n / (l r)) over its cuts into two parts with l
    and r occurrences is its score, ties to the earlier cut. Phrases inside a longer one with ``inside`` percent of their occurrences are dropped. The first
    ``top`` of a language are returned, by score and a descending, phrase ascending. A null text is empty, a null lang ``und``. Long texts count whole, repeated rows
    as often as they occur. A language without phrases has no rows, nor has an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = common.materialize(_word_counts(rows), "words")
    sizes = common.materialize(words.groupBy("lang").agg(F.sum("a").alias("n")), "lang-words")
    total = sizes.agg(F.sum("n")).first()[0] or 1
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels = spark.sparkContext.broadcast(_levels(words, min_count, bits))
    grams = _counted(_routed(rows, levels, total, min_count, longest, partitions), min_count, longest)
    single = words.filter(F.col("a") >= min_count).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("n_words"), "a")
    grams = common.materialize(grams.unionByName(single), "phrases")
    found = grams.filter("n_words > 1").withColumn("w", F.split("phrase", " "))
    # Cuts: each part is as frequent as the whole, so it has a row of its own.
    words_of = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", words_of(F.lit(1), F.col("k")).alias("head"), words_of(F.col("k") + 1, F.col("n_words")).alias("tail"))
    counts = common.maybe_broadcast(grams.select("lang", "phrase", "a"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    cuts = cuts.join(common.maybe_broadcast(sizes), "lang")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score("a", "n", "l", "r").alias("score"), "k", "l", "r")).alias("best"))
    # Phrases of every longer one, with the most occurrences of such a one.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inner = found.filter("n_words > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


ORACLE = f"""WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda c: c <> '') AS w FROM d),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase FROM w, range(1, {LONGEST + 1}) t(m) WHERE len(w) >= m),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY lang, m, phrase HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.m, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM c JOIN n USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')),
b AS (SELECT lang, m, phrase, a, n, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
k AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.lang = b.lang AND o.m > b.m AND o.a >= b.a AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) WHERE rank <= {TOP}"""
