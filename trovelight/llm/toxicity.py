"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration, in numpy."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import common, tokens
from trovelight.llm.langid import sample_by

#: Bound of the fitted sample: labelled rows of each class, by hash of their id.
TRAIN_ROWS_PER_CLASS = 6_000
#: A lexicon term is in this share of the toxic rows, so that there are at most a hundred times the terms of one text.
LEXICON_SHARE = 0.01
LEXICON_LEAST = 3
STRONG_ODDS, WEAK_ODDS = 200.0, 20.0
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS = 40, 3, 0.1, 32
#: Added to the sum of second derivatives of a node, so that small leaves stay modest and scores of different folds comparable.
SHRINK = 5.0
#: Folds of the labelled rows, by hash of the text, so that copies stay together.
FOLDS = 3
FEATURES = ("strong_density", "strong_count", "strong_distinct", "weak_density", "second_person_near", "second_person", "capitals", "punctuation", "obfuscated", "log_words")

#: Pronouns of the second person, and look-alikes of letters.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tú ti tus usted ustedes vosotros".split())
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
EDGES = ".,;:!?\"'()[]{}<>*#%&|~`/\\-_=+"
MASKED = re.compile(rb"[a-z][*@$!0-9]+[a-z]")
NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)


def terms_of(word: str) -> tuple[str, ...]:
    """The word and, for longer ones, its stems of five and four letters."""
    if len(word) > 5:
        return word, word[:5] + "~", word[:4] + "~"
    return (word, word[:4] + "~") if len(word) == 5 else (word,)


def words_of(text: str) -> list[str]:
    return [w if w[0].isalnum() and w[-1].isalnum() else w.strip(EDGES) for w in text.lower().split()]


@dataclass
class Lexicon:
    strong: frozenset[str] = frozenset()
    weak: frozenset[str] = frozenset()
    heads: frozenset[str] = field(init=False)

    def __post_init__(self):
        self.heads = frozenset(t[:4] for t in self.strong | self.weak)

    def features(self, text: str | None) -> list[float]:
        """The dense features of one whole text; a null is an empty text."""
        text = text or ""
        words = words_of(text)
        n, heads, strong, weak = len(words), self.heads, self.strong, self.weak
        at, faint, masked = [], 0, 0
        for i in [i for i, w in enumerate(words) if w[:4] in heads]:
            terms = terms_of(words[i])
            if any(t in strong for t in terms):
                at.append(i)
            elif any(t in weak for t in terms):
                faint += 1
        raw = text.lower().encode("utf-8", "surrogatepass")
        if MASKED.search(raw):
            for i, w in enumerate(words):
                if not w.isalpha() and (plain := w.translate(LOOKALIKES)) != w and plain.isalpha() and any(t in strong for t in terms_of(plain)):
                    masked += 1
                    at.append(i)
        you = {i for i, w in enumerate(words) if w in SECOND_PERSON} if at else set()
        near = sum(any(j in you for j in range(i - 5, i + 6)) for i in at)
        chars = max(1, len(text))
        return [
            100 * len(at) / max(1, n), min(len(at), 20), min(20, len({words[i] for i in at})), 100 * faint / max(1, n), near / max(1, len(at)), 100 * len(you) / max(1, n),
            len(text.encode("utf-8", "surrogatepass").translate(None, NOT_CAPITAL)) / chars, (text.count("!") + text.count("?")) / chars, masked, float(np.log1p(n)),
        ]


@dataclass
class Trees:
    """Boosted regression trees of a fixed depth on binned features, for the logistic loss."""

    edges: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature and bin of each inner node, value of each leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    edges = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    f, trees, inner = np.full(len(y), np.log(prior / (1 - prior))), [], 2**DEPTH - 1
    base = f[0] if len(f) else 0.0
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, node = np.zeros(inner, int), np.full(inner, BINS + 1), np.zeros(len(y), int)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 1e-9
            for j in range(x.shape[1]) if len(rows) >= 2 else ():
                sg = np.cumsum(np.bincount(binned[rows, j], g[rows], BINS + 2))
                sh = np.cumsum(np.bincount(binned[rows, j], h[rows], BINS + 2))
                gain = sg**2 / (sh + SHRINK) + (sg[-1] - sg) ** 2 / (sh[-1] - sh + SHRINK) - sg[-1] ** 2 / (sh[-1] + SHRINK)
                if gain.max() > best:
                    best, feature[k], cut[k] = gain.max(), j, int(gain.argmax())
            node[rows] = 2 * k + 1 + (binned[rows, feature[k]] > cut[k])
        at = node - inner
        leaf = RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + SHRINK)
        f = f + leaf[at]
        trees.append((feature, cut, leaf))
    return Trees(edges, float(base), trees)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (raw score, calibrated probability), rising; slightly smoothed so that no score is 0 or 1."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # toxic, rows, lowest raw, highest raw
    for r, t in zip(raw[order], y[order]):
        if blocks and blocks[-1][3] == r:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([float(t), 1.0, float(r), float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = [v for b in blocks for v in (b[2], b[3])]
    ps = [v for b in blocks for v in [(b[0] + 0.1) / (b[1] + 0.2)] * 2]
    return np.array(xs), np.maximum.accumulate(np.array(ps))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([self.lexicon.features(t) for t in texts])
        return np.interp(self.trees.raw(x), *self.knots)


def fit_scores(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[Trees, tuple[np.ndarray, np.ndarray]]:
    """Trees on all rows; calibration on the scores of rows whose fold their own trees did not see."""
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            raw[fold == k] = boost(x[fold != k], y[fold != k]).raw(x[fold == k])
    return boost(x, y), isotonic(raw, y)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; a document with several labels takes the highest.

    The lexicon of the model is made from all rows; the features that the trees learn from come from lexicons made without the row's own fold. Rows without a label, a doc_id or a document take
    no part; a null or empty text is an empty one; long texts are read whole; repeated documents count as often as they occur, copies in one fold;
    ties of odds or scores share a side. Without labelled rows of both kinds nothing is learnt and every score is 0.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = sample_by(known, "toxic", TRAIN_ROWS_PER_CLASS, "doc_id")  # bounded per class, so it may be broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    rows = common.materialize(rows, "toxic-sample")
    totals = np.zeros((2, FOLDS))
    for r in rows.filter("toxic in (0, 1)").groupBy("toxic", "fold").count().collect():
        totals[r[0], r[1]] = r[2]
    clean, toxic = totals.sum(1)
    empty = Model(Lexicon(), Trees([np.zeros(0)] * len(FEATURES), 0.0, []), (np.array([0.0]), np.array([0.0])))
    if not toxic or not clean:
        return empty

    def counts(label: int, least: float, only: frozenset[str] | None) -> dict[str, np.ndarray]:
        """Rows of each fold that hold a term, for the terms that ``least`` rows of this label hold."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n: Counter = Counter()
                for fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = {t for w in set(words_of(text)) if w for t in terms_of(w)}
                    n.update((fold, t) for t in (found if only is None else found & only))
                yield pa.RecordBatch.from_pydict({"fold": pa.array([f for f, _ in n], pa.int32()), "term": pa.array([t for _, t in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())})

        found = rows.filter(F.col("toxic") == label).select("fold", "text").mapInArrow(run, "fold int, term string, n long")
        folds = [F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(FOLDS)]
        return {r[0]: np.array(r[1:], float) for r in found.groupBy("term").agg(*folds).filter(sum(F.col(f"n{k}") for k in range(FOLDS)) >= least).collect()}

    in_toxic = counts(1, max(LEXICON_LEAST, LEXICON_SHARE * toxic * (FOLDS - 1) / FOLDS), None)
    in_clean = counts(0, 0, frozenset(in_toxic))

    def lexicon(use: np.ndarray) -> Lexicon:
        """The lexicon of the folds in ``use``."""
        clean, toxic = totals @ use
        odds = {t: (n @ use / max(toxic, 1)) / max(in_clean.get(t, np.zeros(FOLDS)) @ use / max(clean, 1), 1e-9) for t, n in in_toxic.items() if n @ use >= max(LEXICON_LEAST, LEXICON_SHARE * toxic)}
        return Lexicon(frozenset(t for t, o in odds.items() if o >= STRONG_ODDS), frozenset(t for t, o in odds.items() if WEAK_ODDS <= o < STRONG_ODDS))

    lexicons = [lexicon(np.arange(FOLDS) != k) for k in range(FOLDS + 1)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicons[k].features(t) for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["toxic", "fold", "x"])

    got = rows.filter("toxic in (0, 1)").mapInArrow(features, "toxic int, fold int, x array<double>").toArrow()
    ordered = sorted(zip(got["toxic"].to_pylist(), got["fold"].to_pylist(), got["x"].to_pylist()))
    trees, knots = fit_scores(np.array([x for _, _, x in ordered]), np.array([float(t) for t, _, _ in ordered]), np.array([k for _, k, _ in ordered]))
    return Model(lexicons[FOLDS], trees, knots)


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """Add ``name``, a score from 0 to 1, to the columns ``keep`` of ``docs`` from its whole ``text``; null and empty texts score as such."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    rows, text = common.with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            for part in tokens.slices(batch, text):
                columns = [c for i, c in enumerate(part.columns) if i != at or text in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shared.value.score(part.column(at).to_pylist()), pa.float64())], [*keep, name])

    schema = docs.select(*keep).schema.add(name, "double")
    return rows.mapInArrow(run, schema)
