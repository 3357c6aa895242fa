"""Each operator against brute force, and on null, empty, long, tied and repeated rows, empty tables and clashing columns."""

import collections
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovelight.llm import ann, common, html, jaccard, langid, linefreq, lm, mixing, packing, queries, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
NEAR = BASE.replace("sigma", "SIGMA") + " phi"
ROWS = [
    (1, BASE + "\n" + BASE, "en", "s1"), (2, BASE + "\n" + BASE, "en", "s1"), (3, None, None, None), (4, "", "fr", "s2"), (5, " \n\t ", "fr", "s2"), (6, LONG, "en", "s2"),
    (7, "the the the the the the the the the the the the", "en", "s1"), (7, "the the the the the the the the the the the the", "en", "s1"), (None, "no id but words " + BASE, "en", "s1"),
    (8, "Ein kurzer Satz über Äpfel.", "de", "s3"), (9, "1234 5678 !!", None, "s3"), (10, BASE + "\nsecond line here", "en", "s1"), (11, "<|endoftext|> İstanbul ΣΑΣ é    x", "tr", "s3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or ""), 1.5, "x", 7, "y") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, host string, part int, row string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def whole(path=None):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def ids_of(t, text):
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_encoder_equals_the_library():
    import random

    import pyarrow as pa

    rnd, t = random.Random(4), whole()
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [None, "", "  ", *(r[1] for r in ROWS), *(f"ab{c}Cd e{c} {c}x" for c in letters)]
    pools = [letters[:most] for most in (0x250, 0x3000, len(letters))]
    texts += ["".join(rnd.choice(pool) if rnd.random() < 0.5 else rnd.choice("abc 'stTRE.<|>\n") for _ in range(30)) for pool in pools for _ in range(20_000)]
    for a in range(0, len(texts), 50_000):
        some = texts[a : a + 50_000]
        ids, offsets = tokens.encoder(queries.tokenizer_path()).encode(pa.array(some, pa.string()))
        want = t.encode_batch_fast([x or "" for x in some], add_special_tokens=False)
        assert all(ids[offsets[i] : offsets[i + 1]].tolist() == w.ids for i, w in enumerate(want))


def test_token_store_round_trip(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    got = [tuple(r) for r in tokens.read_token_store(tokens.write_token_store(docs, path, queries.tokenizer_path()), path).collect()]
    t, at, want = whole(), 0, []
    for i, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        x = ids_of(t, text)
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_store_of_nothing(spark, empty, tmp_path):
    path = f"file://{tmp_path}/none"
    assert tokens.read_token_store(tokens.write_token_store(empty, path, queries.tokenizer_path()), path).count() == 0


def test_encoder_learns_a_stem_once_while_it_is_in_use(monkeypatch):
    # Small memories: what is in every batch stays, what isn't goes.
    monkeypatch.setattr(tokens, "KEPT_BYTES", 64 << 10, raising=False)
    monkeypatch.setattr(tokens, "MEMO_BYTES", 64 << 10)
    enc = tokens.Encoder(queries.tokenizer_path())
    asked = collections.Counter()

    class Counting:
        def __init__(self, model):
            self.model = model

        def tokenize(self, piece):
            asked[piece] += 1
            return self.model.tokenize(piece)

    enc.model = Counting(enc.model)
    rng = np.random.default_rng(4)
    draw = lambda n: ["".join(rng.choice(list("abcdefghijklmnop"), 9)) for _ in range(n)]
    often = draw(200)
    for _ in range(12):
        texts = [" ".join([*often, *draw(500)]), " ".join(w.capitalize() + "." for w in often), " ".join(w.upper() + ",;" for w in often[:20]), "", None]
        ids, offsets = enc.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == enc.whole.encode(text or "", add_special_tokens=False).ids
    assert max(asked[w] for w in often[20:]) == 1
    assert len(enc.stems) < 2_500


ODD_LETTERS = [*"aZ.,'#9éÉßñİıſŉŸÿçÇ-", "'s", "\u0307", "\u0301", "\x1c", "\u2003", "ж", "中", "ﬁ", "\U0001f600", "<|endoftext|>", " ", "\n"]


def test_encoder_gives_the_librarys_ids_on_mixed_words():
    enc, rng = tokens.Encoder(queries.tokenizer_path()), np.random.default_rng(8)
    texts = ["".join(rng.choice(ODD_LETTERS, rng.integers(0, 40))) for _ in range(3_000)] + [c + "a" * 100 + d for c in ("", "É", "İ") for d in ("", ".", "..")]
    for _ in range(2):  # and again with what is kept
        ids, offsets = enc.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [e.ids for e in enc.whole.encode_batch(texts, add_special_tokens=False)]
    ids, offsets = enc.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and offsets.tolist() == [0]


def test_packing(spark, docs):
    pieces = tokens.tokenized_pieces(docs, queries.tokenizer_path(), 64).cache()
    placed = packing.pack(pieces, 64).join(pieces, "item_id").collect()
    assert len(placed) == pieces.count()
    seq = collections.defaultdict(list)
    for r in placed:
        seq[r.sequence_id].append((r.offset, r.length))
    for v in seq.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in placed)
    assert len(seq) <= 1.05 * total / 64 + 2
    assert sum(r.length for r in placed if r.doc_id == 6) == len(ids_of(whole(), LONG))


def test_packing_of_nothing_and_of_whole_items(spark):
    assert packing.pack(spark.createDataFrame([], "item_id long, length long"), 8).count() == 0
    rows = [(1, 8), (2, 8), (3, 0), (4, None)] + [(i, 2) for i in range(5, 13)]
    got = packing.pack(spark.createDataFrame(rows, "item_id long, length long"), 8).collect()
    assert len(got) == len(rows) and len({r.sequence_id for r in got}) == 6


@pytest.mark.parametrize("rows_per_sweep", [300, 60_000])
def test_packing_in_parts_opens_as_many_sequences_as_one_sweep(spark, monkeypatch, rows_per_sweep):
    monkeypatch.setattr(packing, "ROWS_PER_SWEEP", rows_per_sweep)
    lengths = np.random.default_rng(3).integers(1, 1000, 6000).tolist() + [340] * 1500
    length_of = dict(enumerate(lengths))
    rows = packing.pack(spark.createDataFrame(list(length_of.items()), "item_id long, length long"), 1000).collect()
    want, _ = packing.sweep(lengths, list(length_of), [], [], 1000)
    assert sorted(r.item_id for r in rows) == list(length_of)
    assert len({r.sequence_id for r in rows}) == len({s for _, s, _ in want})
    seq = collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, length_of[r.item_id], r.item_id))
    for s, v in seq.items():
        v.sort()
        assert v[0][2] == s and sum(x[1] for x in v) <= 1000 and all(a[0] + a[1] == b[0] for a, b in zip(v, v[1:]))


def test_sweep_is_best_fit():
    rng = np.random.default_rng(1)
    lengths, gaps = rng.integers(1, 50, 200).tolist(), rng.integers(1, 100, 60).tolist()
    placed, left = packing.sweep(lengths, list(range(200)), list(range(1000, 1060)), gaps, 100)
    open_at, want = dict(zip(range(1000, 1060), gaps)), []
    for length, item in sorted(zip(lengths, range(200)), key=lambda x: (-x[0], x[1])):
        fit = [(g, s) for s, g in open_at.items() if g >= length]
        gap, s = min(fit) if fit else (100, item)
        want.append((item, s, 100 - gap))
        open_at[s] = gap - length
    assert placed == want and dict(left) == {s: g for s, g in open_at.items() if g}


def test_line_frequency(spark, docs, empty):
    got = {(r.doc_id, r.n_words): r for r in linefreq.quality(docs).collect()}
    assert len(got) == len({(r[0], len(WORD.findall(r[1] or ""))) for r in ROWS})
    for i, text, *_ in ROWS:
        w = WORD.findall(text or "")
        win = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if win[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[i, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert linefreq.quality(empty).count() == 0


def test_line_frequency_rejects_depleted_documents(spark):
    common_line = "Subscribe to our newsletter for more news about everything we do every single day of the year"
    rows = [(i, f"{common_line} \n{common_line.upper()}", "h") for i in range(1)]
    rows += [(100 + i, f"{common_line}\n{' '.join('own' + 'abcdefghijklmnopqrstuvwxyzABCDE'[i] * 3 + 'z' * k for k in range(25))}", "h") for i in range(30)]
    rows += [(200, common_line, "other"), (300, None, "h")]
    got = {r.doc_id: r.kept for r in linefreq.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] is False and got[200] is True and got[300] is False and all(got[100 + i] for i in range(30))


@pytest.mark.parametrize("others", [0, 300, 3000])
def test_shared_lines_count_alike_on_hosts_of_any_size(spark, others):
    shared = "accept all the cookies of this site to read on\nsign up for our weekly letter with news"
    rows = [(i, f"{shared}\nonly {'abcdefghijklmnopqrstuvwxyz'[i % 26] * (1 + i // 26)}", "h") for i in range(50)]
    rows += [(1000 + i, " ".join(f"w{'abcdefghij'[(i * k) % 10]}{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for k in range(12)), "h") for i in range(others)]
    got = {r.doc_id: r.kept for r in linefreq.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(50)) and all(got[i] for i in got if i >= 1000)


def test_copies_count_once_per_host(spark):
    rows = [(i, BASE + "\nunique closing line of these copies", "h") for i in range(50)] + [(99, "another text that has nothing in common with the copies at all here", "h")]
    assert all(r.kept for r in linefreq.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def classes(rows):
    sets = {}
    for k, (_, text) in enumerate(rows):
        w = WORD.findall(text or "")
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or ("words", *w)
    return sets


def test_jaccard_against_brute_force(spark):
    rnd = np.random.default_rng(2)
    vocab = [f"v{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = rnd.choice(vocab, 80).tolist()
        for _ in range(rnd.integers(1, 12)):
            w = list(base)
            for _ in range(rnd.integers(0, 4)):
                w[rnd.integers(0, len(w))] = str(rnd.choice(vocab))
            rows.append((len(rows), " ".join(w)))
    rows += [(500, rows[0][1]), (501, None), (502, ""), (503, "too short"), (504, "too short")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = classes(rows)
    distinct = {}
    for k, s in sets.items():
        distinct.setdefault(s, rows[k][0])
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, names = collections.Counter(), list(distinct.items())
    for a, (s, i) in enumerate(names):
        for t, j in names[:a]:
            if isinstance(s, frozenset) and isinstance(t, frozenset) and len(s & t) >= 0.8 * len(s | t):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: (root(distinct[sets[k]]), links[distinct[sets[k]]]) for k, (i, _) in enumerate(rows)}
    assert sum(links.values()) > 20


def test_large_bucket_is_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = [(i, BASE + " " + BASE.upper() + f" tail{i}") for i in range(40)]
    got = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {39}


def test_jaccard_edge_rows(docs, empty):
    got = jaccard.similarity_classes(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r.class_id for r in got}
    assert by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[6] == 6 and by[None] is None
    assert jaccard.similarity_classes(empty).count() == 0


@pytest.mark.parametrize("hash_bytes", [6, 8])
def test_jaccard_links_do_not_depend_on_the_packing(spark, hash_bytes):
    rows = [(i, BASE + " " + BASE.upper() + f" tail{i // 2}") for i in range(20)]
    got = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), hash_bytes=hash_bytes).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {9} and {r.copy_id for r in got} == set(range(0, 20, 2))


def test_runs_reach_the_recall_though_they_share_samples():
    rng = np.random.default_rng(8)
    k, runs = rng.binomial(jaccard.COORDINATES, 0.8, 100_000) / jaccard.COORDINATES, jaccard.runs_for(0.999, 0.8)
    miss = np.zeros(len(k))
    for _ in range(jaccard.DEPTH):
        miss = (1 - k + k * miss) ** jaccard.BRANCH
    assert (miss**runs).mean() <= 0.0012 and (miss ** (runs - 1)).mean() > 0.0008
    agreeing = rng.binomial(jaccard.COORDINATES, 0.8, 1_000_000)
    assert (agreeing < jaccard.least_agreeing(0.8)).mean() <= 2e-5


def test_first_of_classes_tells_texts_of_one_id_apart(spark):
    a, b = BASE + " " + BASE[::-1], "another text with nothing in common " + " ".join(f"x{i}" for i in range(40))
    rows = [(3, a, 1, 2), (7, b, 1, 2), (7, a + " more", 1, 2), (9, b, 1, 2), (9, b, 1, 2), (None, a, 1, 2), (11, b + " y", 1, 2), (12, "short", 1, 2), (12, "short", 1, 2), (13, None, 1, 2), (14, "", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, t int")
    got = sorted((tuple(r) for r in jaccard.first_of_classes(docs).collect()), key=str)
    assert got == sorted([(3, a, 1, 2), (7, b, 1, 2), (None, a, 1, 2), (12, "short", 1, 2), (13, None, 1, 2)], key=str)
    assert jaccard.first_of_classes(docs.limit(0)).columns == docs.columns and jaccard.first_of_classes(docs.limit(0)).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(i, "a b c", f"s{i % 3}", *range(8)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _source int, _tokens int, _hash int, _block int, _n int, _edge int, _order int, _epoch int")
    out, _ = mixing.mix(docs, 0.9, 4.0)
    assert out.columns == [*docs.columns, "_epoch_", "_order_", "_tokens_"]
    assert {tuple(r)[:11] for r in out.collect()} == {tuple(r) for r in rows} and {r["_tokens_"] for r in out.collect()} == {3}


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_free_names(docs):
    assert common.free(docs, "score", "new", "ROW") == ["score_", "new", "ROW_"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.rep: r.root for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100}


def test_ann_is_exact_when_all_lists_are_probed(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[10] = x[11] = x[12]
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [1.0, None] + [0.0] * 6, 1), (1004, [1.0, 2.0], 1), (1005, [], 1), (None, [1.0] * 8, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in ann.search(vectors, vectors.filter("vec_id % 20 = 0"), 5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = x.astype(float)
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:5]
        assert [v for _, v, _ in sorted(got[q])] == want.tolist()
        assert np.allclose([z for _, _, z in sorted(got[q])], s[want], rtol=1e-14)
    assert set(got) == set(range(0, 300, 20))
    assert ann.search(vectors.limit(0), vectors.limit(0), 5).count() == 0


def test_ann_finds_an_id_once(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(2 + 30 * (i == 7))] + [(3, x[20].tolist()), (8, (2 * x[9]).tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in (0, 20):
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(np.array(v, float) @ x[q].astype(float)))
        want = sorted(best, key=lambda i: (-best[i], i))[:20]
        assert [(r, i) for r, i, _ in sorted(got[q])] == list(enumerate(want, 1)) and all(abs(s - best[i]) < 1e-12 for _, i, s in got[q])


def test_ann_recall_with_lists(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 6000)] + 0.3 * rng.normal(size=(6000, 16))).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").cache()
    got = collections.defaultdict(set)
    for r in ann.search(vectors, vectors.filter("vec_id % 100 = 0"), 20).collect():
        got[r.query_id].add(r.vec_id)
    x, hit = x.astype(float), 0
    for q in range(0, 6000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / (60 * 20) >= 0.9


def test_ann_scan_reads_pairs_that_stay_in_products_and_keeps_to_its_bound():
    # In 64 dimensions without structure hardly a pair is abandoned: reading each singly took 73 MB and twenty times the CPU time.
    rng = np.random.default_rng(3)
    x, ids = rng.normal(size=(4000, 64)), np.arange(4000)
    norm = float(np.sqrt((x**2).sum(1).max()))
    q, qids = x[:256], ids[:256]
    xr, qr = ann.augmented(x, norm), ann.augmented(q, None)
    most, seed_ids, seed_scores = ann.seeds(ids[::2], x[::2], xr[::2], qids, q, qr, 20)
    tracemalloc.start()
    at, got, scores = ann.scan(ids, x, xr, qids, q, qr, 20, most)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    hit = 0
    for i in range(256):
        s = x @ q[i]
        s[i] = -np.inf
        want = np.argsort(-s)[:20]
        hit += len(set(want) & set(got[at == i]))
        # What the seeds found is within the bound, and so is all else.
        assert list(seed_ids[i]) == [j for j in np.argsort(-s) if j % 2 == 0][:20] and np.allclose(seed_scores[i], s[seed_ids[i]])
        assert (norm**2 + q[i] @ q[i] - 2 * scores[at == i] <= most[i] + 1e-6).all()
    assert hit / (256 * 20) >= 0.98
    # Too few seeds bound nothing.
    assert np.isinf(ann.seeds(ids[:20], x[:20], xr[:20], qids, q, qr, 20)[0]).all()


def test_mixing_solves_for_entropy_and_repetition():
    tokens_ = np.array([1000.0, 100, 100, 50])
    e, w, spent = mixing.solve(tokens_, 0.9, 100.0, 1250.0)
    assert 0 < e < 1 and abs(mixing.entropy(w) - 0.9 * math.log(4)) < 1e-6 and spent == 1250
    e, w, spent = mixing.solve(tokens_, 1.0, 2.0, None)
    assert (spent * w / tokens_).max() <= 2.0001 and (spent * w / tokens_).min() >= 1 - 1e-9
    assert mixing.solve(np.array([5.0, 5.0]), 0.9, 1.0, 10.0)[0] == 1.0


def test_mixing_realises_its_budgets(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "big" if i % 10 else f"small{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = float(sum(5 + i % 7 for i in range(3000)))
    out, found = mixing.mix(docs, 0.95, 3.0, total)
    got = out.groupBy("source").agg(F.sum("_tokens").alias("t"), F.count("*").alias("n")).collect()
    budget = dict(zip(found.sources, found.budgets))
    for r in got:
        assert budget[r.source] - 12 <= r.t <= budget[r.source] + 1e-6
    per_doc = out.groupBy("doc_id", "source").count().collect()
    for s in budget:
        n = {r["count"] for r in per_doc if r.source == s}
        assert max(n) - min(n) <= 1
    order = out.agg(F.min("_order"), F.max("_order")).first()
    assert 0 <= order[0] and order[1] <= 1


@pytest.mark.parametrize("broadcast", [True, False])
def test_mixing_keeps_the_documents_of_any_number_of_sources(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 5, raising=False)
    if not broadcast:
        monkeypatch.setattr(mixing.common, "small", lambda df, rows=0: False)
    rows = [(i, " ".join(["w"] * (3 + i % 4)), f"s{i % 40}") for i in range(400)] + [(1000, "", "blank")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, found = mixing.mix(docs, 0.99, 4.0)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r[0] for r in rows}
    assert len(found.sources) == 41 and abs(sum(found.weights) - 1) < 1e-9
    tokens_ = np.array([sum(3 + i % 4 for i in range(400) if i % 40 == int(s[1:])) if s != "blank" else 0 for s in found.sources], float)
    exponent, w, spent = mixing.solve(tokens_, 0.99, 4.0, None)
    assert abs(exponent - found.exponent) < 1e-9 and np.allclose(found.budgets, w * spent)


def test_mixing_edge_rows(docs, empty):
    out, _ = mixing.mix(docs, 0.9, 4.0)
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert set(docs.columns) <= set(out.columns)
    assert mixing.mix(empty, 0.9, 4.0)[0].count() == 0
    assert mixing.mix(docs.filter("text is null"), 0.9, 4.0)[0].count() == 1


def test_language_id(spark, sf_dir, docs, empty):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(d.filter("doc_id % 4 != 0"))
    right = langid.identify(d.filter("doc_id % 4 = 0"), model, ["lang"]).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.9
    got = {r.doc_id: r for r in langid.identify(docs, model, ["doc_id"]).collect()}
    for i in (3, 4, 5, 9):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[1].rejected
    assert langid.identify(empty, model, ["doc_id"]).count() == 0
    assert langid.fit(empty) is None and {r.lang_pred for r in langid.identify(docs, None, ["doc_id"]).collect()} == {"und"}


def test_ngrams_do_not_cross_texts():
    one, _, _ = langid.ngram_buckets(["Abc def"])
    two, starts, letters = langid.ngram_buckets(["xyz", "Abc def", None, ""])
    for a, b in zip(one, two):
        assert a.tolist() == b[starts[1] : starts[2]].tolist()
    assert letters.tolist() == [3, 6, 0, 0]


def test_toxicity(spark, docs, empty):
    rnd = np.random.default_rng(5)
    vocab = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    rows = []
    for i in range(600):
        w = rnd.choice(vocab, rnd.integers(20, 60)).tolist()
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(2):
                w[rnd.integers(0, len(w))] = str(rnd.choice(["idiotic", "moron", "loserish", "scum"]))
        rows.append((i, " ".join(w), toxic))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    model = toxicity.fit(d, d.filter("doc_id % 3 != 1").select("doc_id", "toxic"))
    scored = toxicity.score(d.filter("doc_id % 3 = 1"), model, ["doc_id", "toxic"]).collect()
    assert all((r.score >= 0.7) == bool(r.toxic) for r in scored)
    hidden = spark.createDataFrame([(1, " ".join(vocab[:30]) + " you m0r0n"), (2, " ".join(vocab[:30]))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(hidden, model, ["doc_id"]).collect()}
    assert got[1] > got[2]
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model, ["doc_id"]).collect())
    assert toxicity.score(empty, model, ["doc_id"]).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.fit(empty, empty.select("doc_id", F.lit(1).alias("toxic"))), ["doc_id"]).collect()} == {0.0}


def test_toxicity_is_not_sure_of_what_it_cannot_know(spark):
    rnd = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{chr(97 + v % 26)}{chr(97 + v // 26)}x" for v in rnd.integers(0, 600, 40)), int(rnd.random() < 0.3)) for i in range(600)]
    rows += [(1000, None, 1), (1001, "", None), (1002, "odd label", 7), (None, "no id", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    model = toxicity.fit(d, d.filter("doc_id % 3 != 1 or doc_id is null").select("doc_id", "toxic"))
    scored = [r.score for r in toxicity.score(d.filter("doc_id % 3 = 1 and doc_id < 1000"), model, ["doc_id"]).collect()]
    assert max(scored) < 0.7 and abs(np.mean(scored) - 0.3) < 0.08


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    xs, ps = toxicity.isotonic(raw, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(ps) >= 0).all() and 0 < ps[0] < ps[-1] < 1


def test_backoff_scores(docs, empty):
    got = collections.defaultdict(list)
    for r in lm.backoff_scores(docs).collect():
        got[r.doc_id].append(r)
    texts = [[w.lower() for w in WORD.findall(r[1] or "")] for r in ROWS]
    c = collections.Counter(w for t in texts for w in t)
    n = sum(c.values())
    known = {w for w, k in c.items() if k >= max(2, n * 2.0**-21)}
    unk = sum(k for w, k in c.items() if w not in known)
    kinds = len(c) - len(known)
    m = lambda w: w if w in known else None
    share = lambda w: math.log((c[w] if w else max(unk, 1) / max(1, kinds)) / n)
    pairs = collections.Counter((m(a), m(b)) for t in texts for a, b in zip(t, t[1:]))
    for (i, *_), t in zip(ROWS, texts):
        own = collections.Counter((m(a), m(b)) for a, b in zip(t, t[1:]))
        s = share(m(t[0])) if t else 0.0
        for (a, b), k in own.items():
            others = pairs[a, b] - k
            s += k * (math.log(others) - math.log(c[a] if a else max(unk, 1)) if others > 0 else math.log(0.4) + share(b))
        r = got[i][0]
        assert r.n_words == len(t) and abs(r.log_score - s) <= 1e-6 * max(1, abs(s))
        assert (r.mean_log_score is None) == (not t)
    assert sum(map(len, got.values())) == len(ROWS) and lm.backoff_scores(empty).count() == 0


def test_backoff_tells_rare_words_apart_in_a_large_input(spark):
    # 7 million words, so that a floor by share of all words would pool those that occur three times.
    big = spark.range(70).select(F.col("id").alias("doc_id"), F.expr("repeat('a b ', 50000)").alias("text"))
    few = spark.createDataFrame([(1000 + i, "rare pair") for i in range(3)] + [(2000, "odd one"), (2001, "odd two"), (2002, "odd three")], "doc_id long, text string")
    got = {r.doc_id: r.log_score for r in lm.backoff_scores(big.unionByName(few)).filter("doc_id >= 1000").collect()}
    n = 7_000_000 + 12
    assert all(abs(got[1000 + i] - (math.log(3 / n) + math.log(2 / 3))) < 1e-9 for i in range(3))
    # (odd, unknown) is one bigram: two of three are in other texts.
    assert all(abs(got[2000 + i] - (math.log(3 / n) + math.log(2 / 3))) < 1e-9 for i in range(3))


PAGE = (
    "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav><div id='cookie-notice'>We use cookies</div>"
    "<div class='wrap'><div class='sidebar'><p>Side text that is long enough to matter here</p></div><div class='post-{n}'><h1>Title &amp; more</h1><p>First&nbsp;paragraph   with <b>bold</b> text.<p>Second &lt;one&gt;"
    "<div class=advert>Buy</div><ul><li>a<li>b</ul><form>Name <input></form><section class='comments'><p>I think that this is a very long reader comment about it all</p></section></div></div><footer>(c)</footer></body></html>"
)
WANT = "Title & more\n\nFirst paragraph with bold text.\n\nSecond <one>\n\na\n\nb"


def test_html_extraction(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.replace("{n}", str(i)), "x") for i in range(20)] + [(50, None, None, "x"), (51, "bad url", "", "x"), (52, "https://h.example/z", "<p>only &#233; this &amp", "x"), (52, "https://h.example/z", "<p>only &#233; this &amp", "x")]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(by[i] == WANT for i in range(20)) and by[50] == by[51] == "" and by[52] == "only é this &"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_keeps_the_whole_article():
    long, more = "Sentence of the article that goes on for a while. " * 8, "The other half of it, with as many words as it needs. " * 4
    one = html.extract(f"<body><div class=page><div class=a><p>{long}</div><div class=b><p>{more}</div></div></body>", None)
    assert one == f"{long.strip()}\n\n{more.strip()}"
    assert html.extract(f"<main><h1>Title</h1><div class=body><p>{long}</div></main>", None) == f"Title\n\n{long.strip()}"
    assert html.extract(f"<body><div><h1>Title</h1><div class=body><p>{long}</div></div><div id=menu><a href=x>one</a></div></body>", None) == f"Title\n\n{long.strip()}"
    # A page of another layout, whose container at the winning path is a teaser.
    winning = html.vote(html.parse(f"<html><body><div><p>{long}</div></body></html>")[0][0])
    other = f"<html><body><div><p>Read this.</div><section class=s><p>{long}</section></body></html>"
    assert html.extract(other, [winning]) == long.strip()
    # Words of longer names count only outside the article.
    page = f"<body><article><p>{long}<div class=search-methods><p>On search.</div><div class=share-of-votes><p>On votes.</div><div class='note comments'><p>Nice!</div></article><div class=site-footer><p>(c) us</div></body>"
    assert html.extract(page, None) == f"{long.strip()}\n\nOn search.\n\nOn votes."


def test_html_kinds_of_layout():
    """Ten layouts with what each must return, in six variants of their texts."""
    for k in range(6):
        head, a, b = f"Heading {k}", f"First paragraph {k} of the text, which is what one came for. " * (1 + k), f"Second paragraph {k}, no less a part of it. " * (1 + k % 3)
        a, b = a.strip(), b.strip()
        whole, menu = f"{head}\n\n{a}\n\n{b}", "<nav><a href=/>Home</a></nav><div class=menu><a href=/a>A</a> <a href=/b>B</a></div>"
        body = f"<h1>{head}</h1><p>{a}</p><p>{b}</p>"
        layouts = [
            f"{menu}<article>{body}</article><footer>(c)</footer>", f"{menu}<main>{body}</main><aside>Also read</aside>", f"<div id=wrap><div class=cookie-banner>Accept</div><div class=post>{body}</div></div>",
            f"<div class=page><header><h2>Site</h2></header><div class=content>{body}</div><div class=right-sidebar><p>Popular today</div></div>", f"<table><tr><td><a href=/>Home</a><td>{body}</table>",
            f"<section><h1>{head}</h1><section><p>{a}</section><section><p>{b}</section></section>", f"{body}<form>Mail <input name=m><button>Go</button></form>", f"<div><div><div><div>{body}</div></div></div></div>",
            f"<div class=story><h1>{head}</h1><div class=text><p>{a}<div class=advert>Buy</div><p>{b}</div></div><div class=comments><p>I think so too</div>", f"<body><div role=main>{body}<div role=complementary><p>Teaser</div></div><script>x='<p>no</p>'</script>",
        ]
        for page in layouts:
            assert html.extract(page, None) == whole, page


@pytest.mark.parametrize("unit", ["<div>", "<div class='a b1'>x", "<b>", "<li>x", "<p>x</div>", "<a '", "<!-- ", "<section><h1>t</h1>", "</p>", "<b><hr>"])
def test_html_time_grows_with_the_page(unit):
    import time

    began = time.process_time()
    html.extract(unit * (500_000 // len(unit)), None)
    assert time.process_time() - began < 10


def test_html_host_consensus_overrules_a_page(spark):
    page = "<body><article><p>Short.</p></article><div class='x'><p>A long passage outside of the article that would win on this page alone, were it not for its host.</p></div></body>"
    rows = [(i, f"https://h.example/{i}", "<body><article><p>Some longer article text number that wins here.</p></article></body>") for i in range(9)] + [(9, "https://h.example/9", page)]
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Short."
