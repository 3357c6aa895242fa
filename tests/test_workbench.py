"""Workbench operators against the standard library and by hand."""

import difflib
import hashlib
import hmac
import math

import pyarrow as pa
from pyspark.sql import functions as F

from trovelight.operators import workbench as W


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_hmac_is_the_library_s(spark):
    for secret in ("k", "x" * 100):
        assert one(spark, W.hmac_sha256(secret, F.col("m")), m="grüß\n") == hmac.new(secret.encode(), "grüß\n".encode(), hashlib.sha256).hexdigest()


def test_graph_level(spark):
    for node in range(50):
        u = (int.from_bytes(hashlib.sha256(str(node).encode()).digest()[:8], "big") + 1) / (2**64 + 1)
        assert one(spark, W.graph_level(F.col("n")), n=node) == min(16, int(-math.log(u) / math.log(12)))


def test_spans(spark):
    text = "a@b.co, then c@d.org; token=x1 13812345678"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x@y.zz")], "id long, t string")
    got = {(r.id, r.kind, text[r.start : r.end] if r.id == 1 else (r.start, r.end)) for r in W.sensitive_spans(df, "id", "t").collect()}
    assert got == {(1, "email", "a@b.co"), (1, "email", "c@d.org"), (1, "credential", "token=x1"), (1, "phone", "13812345678"), (4, "email", (0, 6))}


def test_halves_and_status(spark):
    assert one(spark, W.midpoint_parts(F.col("t")), t="abcde") == ["ab", "cde"]
    assert one(spark, W.shown_status(F.col("s")), s="queued") == "pending"
    assert one(spark, W.shown_status(F.col("s")), s="failed") == "failed"


def test_requests(spark):
    rows = spark.createDataFrame([("k", "a", 1), ("k", "a", 2), ("k", "b", 3), ("m", None, 4), ("m", None, 5)], "key string, f string, n long")
    assert [r.outcome for r in W.judge_requests(rows, "key", "f", F.col("n")).orderBy("n").collect()] == ["created", "reused", "conflict", "created", "reused"]


def test_diffs(spark):
    df = spark.createDataFrame([(1, "a\nb", "a\nc"), (2, None, "x"), (3, "s", "s")], "id long, before string, after string")
    got = {r.id: r.diff for r in W.unified_diffs(df).collect()}
    assert got[1] == "\n".join(difflib.unified_diff(["a", "b"], ["a", "c"], "before", "after", lineterm=""))
    assert "+x" in got[2] and got[3] == ""


def test_diffs_are_made_of_some_bytes_at_a_time(monkeypatch):
    monkeypatch.setattr(W, "DIFF_BYTES", 1_000)
    rows = [(i, "x" * 300 if i % 3 else None, "y\n" * (i % 200)) for i in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["id", "before", "after"]).slice(3), pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.string(), pa.string())], ["id", "before", "after"])]
    out = list(W._diffs(iter(batches)))
    assert len(out) > 10 and max(b.num_rows for b in out) <= 12
    want = [(i, "\n".join(difflib.unified_diff((a or "").splitlines(), b.splitlines(), "before", "after", lineterm=""))) for i, a, b in rows[3:]]
    assert [(r["id"], r["diff"]) for b in out for r in b.to_pylist()] == want


def test_stats_and_citations(spark):
    chunks = spark.createDataFrame([([1.0], False), ([], False), (None, False), ([1.0], True)], "embedding array<double>, excluded boolean")
    assert tuple(W.chunk_stats(chunks).first()) == (4, 1, 2, 1)
    cited = spark.createDataFrame([(1,), (2,)], "doc_id long")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, title string")
    got = W.open_citations(cited, docs, docs.filter("doc_id = 1")).orderBy("doc_id").collect()
    assert [(r.title, r.state) for r in got] == [("a", "open"), ("b", "gone")]
