"""Exact BPE encoding of Arrow text columns, and the flat binary token store.

Token store: each shard is ``*.bin`` (unsigned integers, 16 bits where the
vocabulary fits, else 32, little-endian, documents one after the other) and
``*.idx`` (64-bit little-endian: n, n+1 offsets into the shard, n document
ids, n null flags). A shard holds a range of doc_id; the base of a shard is the
prefix sum of the tokens of the shards before it.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.llm import common

END_ID = 1
#: Bytes, at about, of the stems that a worker keeps with their ids as columns; when they are more, the half that was used last stays.
KEPT_BYTES = 16 << 20
#: Bytes, at about, of all other pieces that a worker keeps, in two halves: when the newer one is full, the older one is dropped, so what is in use stays.
MEMO_BYTES = 16 << 20
#: Bytes that an entry takes beside its characters and ids, and the longest stem or piece that is kept.
ENTRY_BYTES, COLUMN_BYTES, LONGEST_KEPT = 240, 24, 64
#: Stems that are given to the model at a time.
STEMS_AT_ONCE = 2_000
#: Letters that are taken for known if the library treats them as Python does, which each encoder checks.
LETTERS = range(0xC0, 0x180)
#: Words that the library encodes at a time.
WORDS_AT_ONCE = 2_000
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 2 << 20


class Encoder:
    """``tokenizers`` ids of whole texts.

    Where the tokenizer is lower-casing BPE whose pre-tokens never hold white
    space, each distinct word of ASCII and checked letters is cut into pre-tokens and each distinct
    pre-token is given to the library's BPE model once; each other distinct word goes through
    the library. Words of letters with one mark at their end at most are cut and lower-cased as columns. Every other tokenizer, and every text with a special token, goes through the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.vocab_size = self.whole.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.split = None
        if norm == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in pre] == ["Split", "ByteLevel"]:
            if pre[0].get("behavior") == "Removed" and pre[0].get("invert") and not pre[1].get("add_prefix_space"):
                self.split = regex.compile(pre[0]["pattern"]["Regex"])
        # Bytes stand as printable characters: their own where printable, else 256 onwards.
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in own]
        self.as_chars = {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}
        self.punct = frozenset(".,;:!?*$%&#|()[]{}<>-_+=/\\\"@^~`")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memo_bytes = 0
        self.plain = re.compile("[\\x00-\\x7f]*")
        if self.split is not None:
            letters = [c for c in map(chr, LETTERS) if c.isalpha() and all(self._alike(t.format(c)) for t in ("ab{0}Cd", "{0}b", "e{0}", "{0}", "x{0}{0}y", "{0}'s.", "2{0}-{0}"))]
            self.plain = re.compile(f"[\\x00-\\x7f{''.join(letters)}]*")
            one = [c for c, low in zip(letters, pc.utf8_lower(pa.array(letters)).to_pylist()) if low == c.lower() and low.isalpha()]
            self.stem = f"^[A-Za-z{''.join(one)}]+$"
            self.tails = {ord(c): np.frombuffer(self.piece(c), "<u4") for c in self.punct}
            self.tail_ids = np.array([len(self.tails.get(b, ())) for b in range(256)])
            # Stems with the first and the number of their ids in the pool, and the call that asked for them last.
            self.stems, self.first, self.count, self.used = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
            self.pool, self.calls = np.zeros(0, "<u4"), 0

    def _alike(self, word: str) -> bool:
        return self.word(word) == np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        found = self.memo.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                byte_chars = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.as_chars)
                found = struct.pack(f"<{len(t := self.model.tokenize(byte_chars))}I", *[x.id for x in t])
            self.keep(piece, found)
        return found

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= LONGEST_KEPT:
            self.memo_bytes += ENTRY_BYTES + 2 * len(piece) + len(ids)
            if self.memo_bytes > MEMO_BYTES // 2:
                self.memo, self.older = {}, self.memo
                self.memo_bytes = ENTRY_BYTES + 2 * len(piece) + len(ids)
            self.memo[piece] = ids
        return ids

    def word(self, word: str) -> bytes:
        word = word.lower()
        if word.isalpha():
            return self.piece(word)
        if word[-1] in self.punct and word[:-1].isalpha():
            return self.piece(word[:-1]) + self.piece(word[-1])
        return b"".join(map(self.piece, self.split.findall(word)))

    def learn(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids of some lower-cased words of letters: (how many each, all of them)."""
        counts, ids = [], []
        for a in range(0, len(stems), STEMS_AT_ONCE):
            each = [self.model.tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(self.as_chars)) for x in stems[a : a + STEMS_AT_ONCE]]
            counts.append(np.fromiter(map(len, each), np.int32, len(each)))
            ids.append(np.array([t.id for one in each for t in one], "<u4"))
        return np.concatenate(counts), np.concatenate(ids)

    def look_up(self, stems: pa.Array) -> np.ndarray:
        """Places of distinct stems among those that are kept, after the new ones were learnt."""
        if COLUMN_BYTES * len(self.stems) + self.stems.nbytes + self.pool.nbytes > KEPT_BYTES:
            stay = np.sort(np.argsort(-self.used, kind="stable")[: len(self.used) // 2])
            self.pool = self.pool[_runs(self.first[stay], self.count[stay])]
            self.stems, self.count, self.used = self.stems.take(pa.array(stay)), self.count[stay], self.used[stay]
            self.first = np.cumsum(self.count, dtype=np.int64) - self.count
        at = pc.fill_null(pc.index_in(stems, value_set=self.stems), -1).to_numpy().copy()
        new = at < 0
        if new.any():
            more = stems.filter(pa.array(new))
            count, ids = self.learn(_strings(more))
            at[new] = np.arange(len(self.stems), len(self.stems) + len(more))
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(count, dtype=np.int64) - count])
            self.count, self.pool = np.concatenate([self.count, count]), np.concatenate([self.pool, ids])
            self.stems, self.used = pa.concat_arrays([self.stems, more]), np.concatenate([self.used, np.zeros(len(more), np.int32)])
        self.calls += 1
        self.used[at] = self.calls
        return at

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each of some distinct words (large strings): (how many each, all of them)."""
        n = len(words)
        ends, data = (np.frombuffer(x or b"", t) for x, t in zip(words.buffers()[1:], ("<i8", np.uint8)))
        ends = ends[words.offset : words.offset + n + 1]
        last = np.zeros(n, np.uint8)
        some = np.diff(ends) > 0
        last[some] = data[ends[1:][some] - 1]
        tail = self.tail_ids[last]
        raw = words.cast(pa.large_binary())
        stems = pc.if_else(pa.array(tail > 0), pc.binary_slice(raw, 0, -1), raw).cast(pa.large_string())
        simple = pc.and_(pc.match_substring_regex(stems, self.stem), pc.less_equal(pc.binary_length(stems), LONGEST_KEPT))
        coded = pc.utf8_lower(stems.filter(simple)).dictionary_encode()
        simple = simple.to_numpy(zero_copy_only=False)
        tail[~simple] = 0
        at = self.look_up(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        rest = self.others(_strings(words.filter(pa.array(~simple))))
        counts = np.zeros(n, np.int64)
        counts[simple] = self.count[at]
        counts[~simple] = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        lens = counts + tail
        starts = np.cumsum(lens) - lens
        ids = np.empty(int(lens.sum()), "<u4")
        ids[_runs(starts[simple], counts[simple])] = self.pool[_runs(self.first[at], self.count[at])]
        ids[_runs(starts[~simple], counts[~simple])] = np.frombuffer(b"".join(rest), "<u4")
        for b in np.unique(last[tail > 0]):
            mine = (last == b) & (tail > 0)
            ids[((starts + counts)[mine, None] + np.arange(len(self.tails[b]))).ravel()] = np.tile(self.tails[b], np.count_nonzero(mine))
        return lens, ids

    def others(self, words: list[str]) -> list[bytes]:
        """The ids of each of some distinct words, one by one.

        Words with other characters than ASCII and the letters that were checked when the encoder was made are encoded by the library, which alone knows the Unicode tables it was built with.
        """
        # What is kept under a word of letters alone is that word's ids, whoever asked for it first.
        known, other = [b""] * len(words), []
        for i, w in enumerate(words):
            if w.isascii() or self.plain.fullmatch(w) is not None:
                known[i] = self.word(w) if w else b""
            elif (found := self.memo.get(w)) is not None:
                known[i] = found
            elif (found := self.older.get(w)) is not None:
                known[i] = self.keep(w, found)
            else:
                other.append(i)
        for a in range(0, len(other), WORDS_AT_ONCE):
            some = other[a : a + WORDS_AT_ONCE]
            for i, e in zip(some, self.whole.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
                known[i] = self.keep(words[i], np.array(e.ids, "<u4").tobytes())
        return known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n+1 offsets); a null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.split is None:
            each = [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return _flat(each)
        words = pc.ascii_split_whitespace(texts)
        ends, coded = words.offsets.to_numpy(), words.values.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        (lens, pool), index = self.distinct(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
        starts = np.cumsum(lens) - lens
        index = index[ends[0] : ends[-1]]
        n = lens[index]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = pool[_runs(starts[index], n)]
        offsets = before[ends - ends[0]]
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if odd.any():
            each = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            for i in np.flatnonzero(odd):
                each[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
            return _flat(each)
        return ids, offsets


def _runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, and so on ``lens[0]`` times, then the same of the next."""
    ends = np.cumsum(lens, dtype=np.int64)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _flat(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)]).astype(np.int64)
    return (np.concatenate(each).astype("<u4") if each else np.zeros(0, "<u4")), offsets


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, so that what it has learnt of pieces serves the next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, column: str, size_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size_bytes`` of text each (one long text may exceed it)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // size_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def encode_with_end(path: str, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with ``end_id`` appended to each document."""
    ids, offsets = encoder(path).encode(texts)
    if end_id is None:
        return ids, offsets
    return np.insert(ids, offsets[1:], end_id).astype("<u4"), offsets + np.arange(len(offsets))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _uri(path: str) -> str:
    """file:/x, as Hadoop writes it, becomes file:///x."""
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path


def write_token_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into shards under ``path`` in ascending doc_id order; return the manifest.

    Rows with equal ids stand in order of their texts, null ids first; a null or empty text is
    the end id alone. Other columns are ignored. Each task writes files under a name of its own attempt and the
    manifest names those of the attempts that counted, so a task that runs again does no harm.
    Manifest: shard, file, n_docs, n_tokens, base (tokens of all shards before), width (bytes per id).
    """
    spark = docs.sparkSession
    target = _uri(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, name = TaskContext.get().partitionId(), f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        width = 2 if max(encoder(tokenizer).vocab_size, (end_id or 0) + 1) <= 1 << 16 else 4
        out, lens, doc_ids, nulls = None, [], [], []
        for batch in batches:
            for part in slices(batch, "text"):
                if out is None:
                    store, root = _filesystem(target)
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}.bin")
                ids, offsets = encode_with_end(tokenizer, part.column(1), end_id)
                out.write(ids.astype(f"<u{width}").tobytes())
                lens.append(np.diff(offsets))
                doc_ids.append(pc.fill_null(part.column(0), 0).to_numpy(zero_copy_only=False))
                nulls.append(part.column(0).is_null().to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        lens = np.concatenate(lens)
        with store.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(np.array([len(lens)], "<i8").tobytes())
            f.write(np.concatenate([[0], np.cumsum(lens)]).astype("<i8").tobytes())
            f.write(np.concatenate(doc_ids).astype("<i8").tobytes())
            f.write(np.concatenate(nulls).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [len(lens)], "n_tokens": [int(lens.sum())], "width": [width]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    shards = order.mapInArrow(write, "shard long, file string, n_docs long, n_tokens long, width long")
    written = common.materialize(shards, "token-manifest")
    # One row a shard: the prefix sums are taken over file counts, never over documents.
    sums, base = [], 0
    for r in sorted(written.collect(), key=lambda r: r.shard):
        sums.append((r.shard, r.file, r.n_docs, r.n_tokens, r.width, base))
        base += r.n_tokens
    return spark.createDataFrame(sums, "shard long, file string, n_docs long, n_tokens long, width long, base long")


def open_shard(path: str, file: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, doc ids, null flags) of a shard, memory-mapped where the store is local."""
    from pyarrow import fs

    store, root = _filesystem(_uri(path))
    if isinstance(store, fs.LocalFileSystem):
        ids = np.memmap(f"{root}/{file}.bin", f"<u{width}", "r")
        index = np.memmap(f"{root}/{file}.idx", "<i8", "r")
    else:
        ids = np.frombuffer(store.open_input_file(f"{root}/{file}.bin").read_buffer(), f"<u{width}")
        index = np.frombuffer(store.open_input_file(f"{root}/{file}.idx").read_buffer(), "<i8")
    n = int(index[0])
    return ids, index[1 : n + 2], index[n + 2 : 2 * n + 2], index[2 * n + 2 :]


def read_token_store(manifest: DataFrame, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, offsets, doc_ids, nulls = open_shard(path, r["file"], r["width"])
                for a in range(0, r["n_docs"], 20_000):
                    b = min(r["n_docs"], a + 20_000)
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(offsets[a:b], offsets[a + 1 : b + 1])]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(np.asarray(doc_ids[a:b]), pa.int64(), mask=np.asarray(nulls[a:b]) != 0),
                        "start": pa.array(np.asarray(offsets[a:b]) + r["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[a : b + 1]), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    })

    n = max(1, manifest.count())
    spread = manifest.select("file", "width", "n_docs", "base", "shard").repartitionByRange(n, "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = END_ID) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: item_id, doc_id, piece, start, length, ids_crc32.

    item_id is unique; the ids themselves stay in the task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = encode_with_end(tokenizer, part.column(1), end_id)
                n = -(-np.diff(offsets) // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(offsets)[row] - start)
                at = offsets[:-1][row] + start
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array(np.arange(made, made + len(row)), pa.int64()),
                    "doc_id": part.column(0).take(pa.array(row)),
                    "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                })
                made += len(row)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "item_id long, doc_id long, piece int, start long, length long, ids_crc32 long")
