"""Language identification: averaged embeddings of hashed subwords and a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its hashed character n-grams (letters lower-cased, all else a word
boundary). The mean and the linear layer commute, so prediction sums one row of class scores per
n-gram of the whole text. Scores are calibrated by a temperature, and a prediction is rejected below a
threshold set on rows that training did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import common, tokens

#: Bound of the fitted sample: documents over all languages, which share them alike (by hash of the row), and n-grams of each, evenly spread over its whole text.
TRAIN_DOCS = 6_000
TRAIN_NGRAMS = 1_000
ORDERS = (2, 3, 4)
BUCKETS, DIM, EPOCHS, RATE = 1 << 16, 8, 6, 4.0
#: Share of the correct calibration rows that may be rejected.
REJECT_SHARE = 0.0005
UNKNOWN = "und"
#: Bytes of text that are scored at a time; the arrays of n-grams and class scores take some hundred times as much.
PREDICT_BYTES = 256 << 10


def _letters() -> np.ndarray:
    """Code point to its lower-case letter, or 32 for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: list[np.ndarray] = []


def ngram_buckets(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the buckets of all n-grams of the texts one after the other, the first position of each text, its letters.

    At a position, an n-gram that would leave its text or holds no letter falls into bucket 0.
    """
    if not _LETTERS:
        _LETTERS.append(_letters())
    joined = "".join(f" {t or ''} " for t in texts)
    sizes = np.array([len(t or "") + 2 for t in texts], np.int64)
    cps = _LETTERS[0][np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.cumsum(sizes) - sizes
    letter = cps != 32
    count = np.add.reduceat(letter, starts, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    out, h, some = [], cps.copy(), letter.copy()
    for order in range(2, max(ORDERS) + 1):
        nxt = np.zeros_like(cps)
        nxt[: -(order - 1)] = cps[order - 1 :]
        h = h * np.uint32(0x01000193) ^ nxt
        some[: -(order - 1)] |= letter[order - 1 :]
        if order in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * order)
            b = (mixed >> np.uint32(16)) % np.uint32(BUCKETS - 1) + np.uint32(1)
            b[~some] = 0
            for k in range(1, order):  # n-grams that would run into the next text
                b[starts + sizes - k] = 0
            out.append(b)
    return out, starts, count


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x languages: embedding times linear layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, letters) per text."""
        if not texts:
            return np.zeros((0, len(self.langs))), np.zeros(0, np.int64)
        each, starts, letters = ngram_buckets(texts)
        total, n = 0.0, 0.0
        for b in each:
            total = total + np.add.reduceat(self.scores[b], starts, axis=0, dtype=np.float64)
            n = n + np.add.reduceat(b > 0, starts, dtype=np.float64)
        return total / np.maximum(n, 1)[:, None] + self.bias, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, calibrated score, rejected) per text."""
        logits, letters = self.logits(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(1) if len(texts) else np.zeros(0, int)
        none = letters == 0
        score = np.where(none, 0.0, p.max(1) if len(texts) else 0.0)
        return [UNKNOWN if x else self.langs[b] for x, b in zip(none, best)], score, none | (score < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(features: list[np.ndarray], labels: list[str], seed: int = 7) -> Model:
    """SGD over the mean embeddings of the given buckets; classes weigh alike. A fifth of the rows calibrates."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 50 else (order, order)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    lin, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    weight = len(fit) / len(langs) / np.maximum(np.bincount(y[fit], minlength=len(langs)), 1)
    # An n-gram that a row holds often is looked up once.
    rows = {i: np.unique(features[i], return_counts=True) for i in fit.tolist()}
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(fit).tolist():
            f, times = rows[i]
            share = (times / len(features[i])).astype(np.float32)
            mean = share @ emb[f]
            g = softmax((mean @ lin + bias)[None])[0]
            g[y[i]] -= 1
            g *= weight[y[i]]
            emb[f] -= np.outer(share, (rate * (lin @ g)).astype(np.float32))
            lin -= 0.1 * rate * np.outer(mean, g)
            bias -= 0.02 * rate * g
    model = Model(langs, (emb @ lin).astype(np.float32), bias)
    logits = np.array([model.scores[features[i]].mean(0) for i in held]) + bias
    nll = [(-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean(), t) for t in np.geomspace(0.02, 20, 60)]
    model.temperature = float(min(nll)[1])
    p = softmax(logits / model.temperature)
    right = np.sort(p.max(1)[p.argmax(1) == y[held]])
    chance = 1 / len(langs)
    if len(right):
        # Just below the least certain correct rows, and never above an even bet between two languages.
        model.threshold = float(min(0.5, max(chance * 1.02, 0.9 * right[int(REJECT_SHARE * len(right))])))
    return model


def sample_by(docs: DataFrame, label: str, per_label: int, key: str) -> DataFrame:
    """Rows whose hash falls below the share that leaves about ``per_label`` rows of each value of ``label``."""
    counts = docs.groupBy(label).count().withColumn("_share", F.least(F.lit(1.0), per_label / F.col("count"))).drop("count")
    u = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return docs.join(F.broadcast(counts), label).filter(u < F.col("_share")).drop("_share")  # a row per label value


def fit(docs: DataFrame) -> Model | None:
    """Learn from ``docs(doc_id, text, lang)``; rows with a null lang or without a letter don't count. None if there are none.

    Of a repeated row, all or none are in the sample; of a doc_id with two languages, both rows may be. Long texts give n-grams from all of their length. The driver holds at most about
    TRAIN_DOCS rows of TRAIN_NGRAMS numbers, however many languages there are.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                each, _, letters = ngram_buckets([text])
                b = np.concatenate(each)
                b = b[b > 0]
                if letters[0] and len(b):
                    langs.append(lang)
                    out.append(b[np.linspace(0, len(b) - 1, min(len(b), TRAIN_NGRAMS)).astype(int)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.list_(pa.int32()))], ["lang", "features"])

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = rows.agg(F.count_distinct("lang")).first()[0]
    labelled = sample_by(rows.select("doc_id", "lang"), "lang", max(1, TRAIN_DOCS // max(1, langs)), "doc_id")
    ids = labelled.select("doc_id", "lang").distinct()  # at most about TRAIN_DOCS, or one for each language
    chosen = rows.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")
    got = chosen.mapInArrow(features, "lang string, features array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    lists = got["features"].combine_chunks() if isinstance(got["features"], pa.ChunkedArray) else got["features"]
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    table = sorted(zip(got["lang"].to_pylist(), (flat[a:b] for a, b in zip(ends[:-1], ends[1:]))), key=lambda x: (x[0], x[1][:32].tolist(), len(x[1])))
    return train([f for _, f in table], [lang for lang, _ in table])


def identify(docs: DataFrame, model: Model | None, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Add ``names`` (language, score, whether rejected) to the columns ``keep`` of ``docs`` from its ``text``.

    A text that is null, empty or without a letter is ``und`` at score 0 and rejected. Long texts are read whole. Ties between
    languages go to the first by name.
    """
    model = model or Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    rows, text = common.with_text(docs, keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            for part in tokens.slices(batch, text, PREDICT_BYTES):
                langs, score, rejected = shared.value.predict(part.column(at).to_pylist())
                columns = [c for i, c in enumerate(part.columns) if i != at or text in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*keep, *names])

    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    return rows.mapInArrow(predict, schema)
