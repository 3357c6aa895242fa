"""Near duplicates of vectors, vector codes and collocations against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from trovelight.llm import codes, neardup, phrases

SCHEMA = "vec_id long, embedding array<double>, label int, rep long, block string, code string, v int, copies int, key string, h1 int"
MORE = (5, "b", "c", 1, 2, "k", 3)
NAN, INF = float("nan"), float("inf")


def usable(r):
    return r[0] is not None and r[2] is not None and r[1] and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1])


def brute_links(rows, least=0.93):
    n = len(rows)
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]) / max(map(abs, a[1])), np.array(b[1]) / max(map(abs, b[1]))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo = [k for j in todo for k in near[j] if k not in seen and not seen.add(k)]
        root = min((rows[k][0] for k in seen), key=lambda v: (v is None, v or 0))
        out.append((rows[i][0], len(near[i]), root, rows[i][0] == root))
    return out


def by_text(rows):
    return sorted(map(str, map(tuple, rows)))


def planted():
    """Unrelated vectors, chains and clusters about the threshold, copies, and odd rows."""
    rng = np.random.default_rng(3)
    rows = [(100 + i, rng.normal(size=24).tolist(), i % 2) for i in range(60)]
    for k in range(25):  # pairs from just below to well above 0.93
        x = rng.normal(size=24)
        x /= np.linalg.norm(x)
        y = rng.normal(size=24)
        y -= x * (x @ y)
        y /= np.linalg.norm(y)
        cosine = 0.925 + 0.003 * k
        rows += [(300 + 2 * k, (3 * x).tolist(), 1), (301 + 2 * k, (cosine * x + math.sqrt(1 - cosine**2) * y).tolist(), 1)]
    centre = rng.normal(size=24)
    rows += [(500 + i, (centre + 0.15 * rng.normal(size=24)).tolist(), 0) for i in range(40)]
    rows += [(600 + i, centre.tolist(), 0) for i in range(5)] + [(600, centre.tolist(), 0), (601, (-centre).tolist(), 0), (610, (1e200 * centre).tolist(), 0)]
    rows += [(700, None, 0), (701, [], 0), (702, [0.0] * 24, 0), (703, [NAN] * 24, 0), (704, [INF] + [1.0] * 23, 0), (705, [None] + [1.0] * 23, 0), (706, centre.tolist(), None), (707, centre.tolist(), 3)]
    return rows + [(None, centre.tolist(), 0), (708, [1.0, 2.0], 0), (709, [2.0, 4.0], 0), (None, None, None)]


def test_links_against_brute_force(spark):
    rows = planted()
    got = neardup.link(spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA)).collect()
    assert by_text(got) == by_text(brute_links(rows))


def test_links_with_small_blocks(spark, monkeypatch):
    rows = [r for r in planted() if r[2] == 0]
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = neardup.link(spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA)).collect()
    assert by_text(got) == by_text(brute_links(rows))


def test_links_with_many_projections(spark, monkeypatch):
    """What a large table plans: more projections and tables."""
    monkeypatch.setattr(neardup, "BUCKET_ROWS", 1)
    rows = planted()
    got = neardup.link(spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA)).collect()
    assert by_text(got) == by_text(brute_links(rows))


def test_plan_of_tables():
    for n in (1, 10_000, 10**6, 10**9):
        width, k, tables = neardup.plan(n, 0.93, 1e-4)
        near, far = neardup.collision(math.sqrt(0.14), width), neardup.collision(math.sqrt(2), width)
        assert (1 - near**k) ** tables <= 1e-4 and n * far**k <= neardup.BUCKET_ROWS
    rng = np.random.default_rng(1)
    steps = rng.random(200_000)
    share = (np.floor(steps * 1) == np.floor(steps + rng.normal(size=200_000) * 0.4)).mean()
    assert abs(share - neardup.collision(0.4, 1.0)) < 0.01


def test_no_links(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.link(empty).collect() == [] and codes.compress(empty)[0].collect() == []


def brute_codes(rows, parts, entries, rounds):
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    dims = -(-max(len(r[1]) for r in kept) // parts)
    cut = lambda v: [[math.floor(Fraction(c) * 1024) for c in (list(v) + [0.0] * (parts * dims))[p * dims : (p + 1) * dims]] for p in range(parts)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    xs = [cut(r[1]) for r in kept]
    books = [[x[p] for x in xs[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = collections.defaultdict(list)
            for x in xs:
                mine[near(x[p], books[p])[1]].append(x[p])
            books[p] = [[sum(c) // len(mine[j]) for c in zip(*mine[j])] if mine[j] else y for j, y in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    found = [[near(x[p], books[p]) for p in range(parts)] for x in xs]
    errors = [sum(d for d, _ in f) for f in found]
    label = collections.Counter()
    for r, e in zip(kept, errors):
        label[r[2]] += e
    fits = lambda e: e if e < 1 << 63 else None
    return [(r[0], "".join(f"{j:02x}" for _, j in f), fits(e), fits(label[r[2]]), digest) for r, f, e in zip(kept, found, errors)]


def odd_vectors(scale=1.0):
    rng = np.random.default_rng(8)
    rows = [(int(i), (scale * np.round(rng.normal(size=8), 2)).tolist(), [0, 1, None][i % 3]) for i in rng.permutation(70)]
    rows += [(3, rows[0][1], 1), (3, rows[1][1], 1), (None, rows[2][1], None), (90, None, 1), (91, [NAN] * 8, 1), (92, [None] * 8, 1), (93, [-INF] + [0.0] * 7, 1), (94, [], 2), (95, [0.5], 2)]
    return rows + [(100 + i, [0.25 * scale] * 8, 7) for i in range(20)]


@pytest.mark.parametrize("scale,entries", [(1.0, 16), (1.0, 256), (1e9, 16), (1e30, 8)])
def test_codes_against_brute_force(spark, scale, entries):
    rows = odd_vectors(scale)
    got, books = codes.compress(spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA), entries=entries)
    assert by_text(got.collect()) == by_text(brute_codes(rows, 4, entries, 4))
    assert len(books) == 4


def test_nearest_entries():
    rng = np.random.default_rng(2)
    for dtype in (np.int64, object):
        x, book = rng.integers(-9, 9, (300, 7)).astype(dtype), rng.integers(-9, 9, (40, 7)).astype(dtype)
        book[17] = book[4]
        d = ((x[:, None, :] - book) ** 2).sum(2)
        index, best = codes.nearest(x, book)
        assert index.tolist() == [min(range(40), key=lambda j: (r[j], j)) for r in d.tolist()] and best.tolist() == d.min(1).tolist()


def brute_phrases(docs, longest, least, top):
    out = []
    counts = collections.defaultdict(collections.Counter)
    words = collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            score, _, l, r = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, words[lang], -s))
    return out


def odd_texts():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünder", "İ", "ÄB", "a\x00b", "日本", "x y", "'s", "A"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(150):
        words = rnd.choices(vocabulary, weights, k=rnd.randrange(40))
        if i % 3 == 0:
            words += ["New", "York", "City", "hall"] if i % 2 else ["new", "york", "city"]
        rows.append(("".join(w + rnd.choice([" ", " ", " ", "\t ", ", ", "\n", ".", "  ", "\r\n"]) for w in words), rnd.choice(["en", "en", None, "fr", ""])))
    rows += [(None, "en"), ("", None), (" \t\n.,", "fr"), ("the " * 3000, "en"), ("one two " * 500 + "one", "de")] + [("copy of a row that is repeated", "en")] * 30
    return rows + [(" ".join(rnd.choices(vocabulary, weights, k=20_000)), "en")]


@pytest.mark.parametrize("setting,value", [("MINE_BYTES", 4 << 20), ("MINE_BYTES", 300), ("TEXT_BYTES", 2_000), ("BUCKETS", 2), ("FRAGMENT_BYTES", 1 << 20)])
def test_phrases_against_brute_force(spark, monkeypatch, setting, value):
    monkeypatch.setattr(phrases, setting, value)
    rows = odd_texts()
    docs = spark.createDataFrame([(*r, 1, "x", 2, "p") for r in rows], "text string, lang string, a long, word string, n long, phrase string")
    for bits, least in ((21, 6), (3, 20)):
        got = phrases.collocations(docs, min_count=least, top=300, bits=bits).collect()
        want = brute_phrases(rows, 5, least, 300)
        assert len(want) > 20 and by_text([[r[c] for c in "lang rank phrase a l r n score".split()] for r in got]) == by_text(want)


def test_phrases_over_many_partitions(spark):
    """Tasks with one, two or a few pivots."""
    rows = odd_texts()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(5), min_count=6, top=300).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert by_text([[r[c] for c in "lang rank phrase a l r n score".split()] for r in got]) == by_text(brute_phrases(rows, 5, 6, 300))


def test_phrases_past_64_bits(spark):
    """1000 a n passes 2**63 where counts are large; here the plan's types are checked with counts as given."""
    big = spark.createDataFrame([(4_000_000_000_000, 90_000_000_000_000, 5_000_000_000_000, 4_000_000_000_001)], "a long, n long, l long, r long")
    got = big.select(phrases.score("a", "n", "l", "r").alias("s")).first().s
    assert got == 1000 * 4_000_000_000_000 * 90_000_000_000_000 // (5_000_000_000_000 * 4_000_000_000_001)


def test_no_phrases(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).collect() == []
