"""Text, vector, retrieval and source functions on literal inputs."""

import io
import math
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from trovelight import config
from trovelight.functions import text as T
from trovelight.functions import vectors as V
from trovelight.operators import lifecycle as L
from trovelight.operators import postings as P
from trovelight.operators import search as S
from trovelight.sources import connectors, files
from trovelight.streaming import events as E


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()[0]


def test_block_splitter(spark):
    src = "# A\n\npara one\nline two\n\n\n```py\nx\n\ny\n```\n"
    rows = files.split_blocks(spark.createDataFrame([(1, src)], "k int, t string"), "k", "t").orderBy("ordinal").collect()
    assert [(r.type, r.content_text, r.start_line, r.end_line) for r in rows] == [("heading", "A", 1, 2), ("paragraph", "para one\nline two", 3, 6 - 1), ("code", "```py\nx", 7, 9), ("paragraph", "y\n```", 10, 12)]


@pytest.mark.parametrize("text,n", [("", 1), ("python", 2), ("安装指南", 3), ("启动 Demo 之前 Python", 6)])
def test_token_estimate(spark, text, n):
    assert one(spark, T.token_estimate(F.col("t"), "ceil"), t=text) == n


def test_hash_embedding(spark):
    df = spark.createDataFrame([("a", "python"), ("b", "install python"), ("c", "python is needed to install"), ("d", "")], "k string, t string")
    slots = {(r.k, r.slot): r.weight for r in V.embedding_slots(df, "k", "t").collect()}
    assert {s: w for (k, s), w in slots.items() if k == "a"} == {9: -0.40824829, 36: -0.40824829, 38: 0.40824829, 73: 0.40824829, 81: 0.40824829, 114: 0.40824829}
    dense = {r.k: r.embedding for r in V.embed(df, "k", "t").collect()}
    assert abs(sum(x * y for x, y in zip(dense["b"], dense["c"])) - 0.7092993683) < 1e-7
    assert dense["d"] == [0.0] * 128
    assert one(spark, V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


CORPUS = [("a", "Install guide", "Install guide / paragraph 1", "python is needed to install"), ("b", "Other", "Other / paragraph 1", "python python fast api"), ("d", "安装指南", "安装指南 / heading 1", "安装 Demo 需要 python。如何安装"), ("c", "Misc", "Misc / heading 1", "nothing here at all"), ("e", "Zed", "Zed / x 1", "café naïve"), ("f", "Yed", "Yed / x 1", "foo-bar v1.2")]


def test_bm25_scores_and_terms(spark):
    chunks = spark.createDataFrame(CORPUS, "chunk_id string, title string, breadcrumb string, content string")
    q = spark.createDataFrame([("q", "install python"), ("cjk", "安装"), ("cafe", "cafe"), ("phrase", "foo-bar"), ("rev", "bar-foo"), ("dot", "v1.2"), ("case", "PYTHON"), ("none", "？")], "query_id string, query string")
    got = {}
    for r in P.bm25_channel(q, chunks, ["title", "breadcrumb", "content"], 10).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.bm25
    assert set(got["q"]) == {"a", "b", "d"}
    assert math.isclose(got["q"]["a"], -1.9107111550241689, rel_tol=1e-9)
    assert math.isclose(got["q"]["b"], -1.3906447534766122e-06, rel_tol=1e-9)
    assert math.isclose(got["q"]["d"], -9.683098591549295e-07, rel_tol=1e-9)
    assert (set(got["cjk"]), set(got["cafe"]), set(got["phrase"]), set(got["dot"]), set(got["case"])) == ({"d"}, {"e"}, {"f"}, {"f"}, {"a", "b", "d"})
    assert "rev" not in got and "none" not in got


def test_fusion_and_evidence(spark):
    v = spark.createDataFrame([("q", 1, 0.9, 1), ("q", 2, 0.35, 2)], "query_id string, chunk_id int, vector_score double, vector_rank int")
    t = spark.createDataFrame([("q", 1, -1.0, 2)], "query_id string, chunk_id int, bm25 double, full_text_rank int")
    got = {r.chunk_id: round(r.fusion, 8) for r in S.fuse(v, t).collect()}
    assert got == {1: 0.03252247, 2: round(1 / 62, 8)}
    rows = spark.createDataFrame([("q", 1, 0.0, None, 0.35), ("q", 2, 0.0, None, 0.3501), ("q", 3, 0.0, 0.0, 0.1), ("q", 4, 0.1, None, None)], "query_id string, rank int, rerank_score double, full_text_score double, vector_score double")
    sel = {r["rank"]: (r.selected, r.ordinal, r.reason) for r in S.select_evidence(rows).collect()}
    assert sel == {1: (False, None, "no_signal"), 2: (True, 1, None), 3: (False, None, "no_signal"), 4: (True, 2, None)}


def test_answers(spark):
    q = spark.createDataFrame([("q", "x"), ("r", "y")], "query_id string, query string")
    ev = spark.createDataFrame([("q", True, 1, "First. Second."), ("q", True, 2, "No stop")], "query_id string, selected boolean, ordinal int, content string")
    got = {r.query_id: (r.answer, list(r.citations), r.status, r.valid) for r in S.validate_citations(S.extractive_answers(ev, q), ev).collect()}
    assert got == {"q": (T.BY_EVIDENCE + "\n\nFirst. [1]\n\nNo stop。 [2]", [1, 2], "sufficient", True), "r": (T.NO_EVIDENCE, [], "insufficient", True)}


@pytest.mark.parametrize("column,value,want", [
    (lambda c: T.mask_sensitive(c), "a@b.org 13812345678 token=abc 4213812345678000", "[EMAIL] [PHONE] [CREDENTIAL] 4213812345678000"),
    (lambda c: T.redact(c), "postgres://u:pw@h/db Password: x, Authorization=y", "[REDACTED_CONNECTION] Password=[REDACTED], Authorization=[REDACTED]"),
    (lambda c: T.mask_sensitive(c), "password=a,b;c end", "[CREDENTIAL] end"),
    (lambda c: T.human_size(F.length(c) * 0 + 1152 * 1024), "x", "1.12 MB"),
    (lambda c: T.human_size(F.length(c) * 0 + 1000), "x", "0.98 KB"),
    (lambda c: T.refuses(c).cast("string"), "我不知道", "true"),
    (lambda c: T.vector_weight(c).cast("string"), "第一列", "0.9"),
    (lambda c: T.first_sentence(c), "  a b\n c", "  a b\n c。"),
    (lambda c: T.locator(F.struct(F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("slide"), F.lit(None).cast("string").alias("sheet"), F.length(c).alias("start"), F.lit(None).cast("int").alias("end"))), "abc", "第 3-3 行"),
    (lambda c: T.iso_millis(F.timestamp_millis(F.length(c) + 1234)), "abc", "1970-01-01T00:00:01.237Z"),
    (lambda c: T.origin(c), "HTTPS://User@Example.org:443/a?b", "https://example.org"),
    (lambda c: T.origin(c), "http://h:8080/", "http://h:8080"),
    (lambda c: T.origin(c), "ftp://h/", None),
    (lambda c: T.csv_cell(c), 'a "b", c', '"a ""b"", c"'),
    (lambda c: T.intent(c), "怎么做", "procedure"),
    (lambda c: T.intent(c), "统计一下", "fact"),
    (lambda c: T.intent(c), "how to install it", "knowledge_query"),
    (lambda c: T.language(c), "安装", "zh-CN"),
    (lambda c: T.fold(c), "café ß", "cafe ß"),
    (lambda c: T.stable_json(c), '{"b": 1, "a": {"d": 2, "c": null}}', '{"a":{"c":null,"d":2},"b":1}'),
    (lambda c: T.stable_json(c), "{", None),
    (lambda c: T.mask_secret(c), "abcdefgh", "••••efgh"),
    (lambda c: T.clean_controls(c), "a\r\nb\rc\x07", "a\nb\nc"),
    (lambda c: files.safe_path(c), "a\\b/./c?.txt", "a/b/c_.txt"),
    (lambda c: files.safe_path(c), "../x", None),
    (lambda c: files.safe_path(c), "/etc/x", None),
    (lambda c: files.safe_path(c), "C:/x", None),
    (lambda c: files.csv_block(F.encode(c, "UTF-8")), '﻿a,"b, ""c""",\n1,2,3\n', 'a | b, "c" | \n1 | 2 | 3'),
])
def test_text(spark, column, value, want):
    assert one(spark, column(F.col("t")), t=value) == want


def test_lexical_is_substring(spark):
    assert one(spark, T.lexical_score(F.lit("in on in"), F.lit("Install"))) == 0.5
    assert one(spark, T.lexical_score(F.lit("？"), F.lit("x"))) == 0.0


def test_profile():
    assert config.profile({"fusion": {"k": 31}})["fusion"] == {"method": "rrf", "k": 31, "vectorWeight": 1.0, "fullTextWeight": 1.0}
    for bad in ({"fusion": {"k": 0}}, {"embedding": {"dimensions": 4}}, {"embedding": {"provider": "x"}}, {"rerank": {"topK": True}}):
        with pytest.raises(ValueError):
            config.profile(bad)
    assert config.normalise_weights(3, 1) == (0.75, 0.25)
    with pytest.raises(ValueError):
        config.normalise_weights(0, 0)


@pytest.mark.parametrize("sql,ok", [("SELECT 1", True), ("WITH t AS (SELECT 1) SELECT * FROM t", True), ("SELECT 1;", True), ("DELETE FROM t", False), ("SELECT 1; SELECT 2", False), ("SELECT 1 -- x", False), ("SELECT * FROM t WHERE a='DROP'", False), ("SELECT analyze FROM t", False), ("SELECT load_extension('x')", False), ("SELECT 1 */", False)])
def test_sql_guard(sql, ok):
    if ok:
        connectors.guard(sql)
    else:
        with pytest.raises(connectors.QueryRejected):
            connectors.guard(sql)


def test_template(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    t = connectors.Template("SELECT id FROM numbers WHERE id >= ? ORDER BY id", row_limit=3)
    assert [r.id for r in connectors.execute(spark, t, [4]).collect()] == [4, 5, 6]
    with pytest.raises(connectors.QueryRejected):
        connectors.execute(spark, t, {})
    assert connectors.Template("SELECT 1", 99_999, 1).row_limit == 10_000 and len(connectors.schema_hash(spark.range(1))) == 64


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_files_and_archives(spark, tmp_path):
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    a = "xmlns:a='http://schemas.openxmlformats.org/drawingml/2006/main'"
    m = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    (tmp_path / "x.zip").write_bytes(zipped({"extra.txt": "hello", "../outside.txt": "no", "inner.zip": "PK", "b.exe": "x", "old.md": "seen"}))
    (tmp_path / "d.docx").write_bytes(zipped({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>"}))
    (tmp_path / "p.pptx").write_bytes(zipped({"ppt/slides/slide1.xml": f"<x {a}><a:p><a:r><a:t>Slide</a:t></a:r></a:p></x>"}))
    (tmp_path / "s.xlsx").write_bytes(zipped({"xl/sharedStrings.xml": f"<sst {m}><si><t>cell</t></si></sst>", "xl/worksheets/sheet1.xml": f"<worksheet {m}><sheetData><row><c t='s'><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>"}))
    (tmp_path / "bad.docx").write_bytes(b"PKnothing")
    (tmp_path / "lie.pdf").write_bytes(b"no pdf")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("in/a.csv")
        info.size = 3
        t.addfile(info, io.BytesIO(b"a,b"))
        link = tarfile.TarInfo("link.txt")
        link.type = tarfile.SYMTYPE
        t.addfile(link)
    listing = files.read_files(spark, str(tmp_path), ["nothing"])
    kinds = {r.path.rsplit("/", 1)[1]: (r.media_type, r.error) for r in files.detect(listing).collect()}
    assert kinds["lie.pdf"] == (None, "MIME_MISMATCH") and kinds["x.zip"] == ("application/zip", None) and kinds["d.docx"][1] is None
    blocks = {(r.path.rsplit("/", 1)[1], r.ordinal): (r.content_text, r.error) for r in files.office_blocks(listing).collect()}
    assert blocks["d.docx", 2][0] == "Two" and blocks["p.pptx", 1][0] == "Slide" and blocks["s.xlsx", 1][0] == "cell | 7" and blocks["bad.docx", 0][1].startswith("PARSE_FAILED")
    members = files.expand_archives(listing)
    seen = spark.createDataFrame([("seen",)], "t string").select(F.sha2("t", 256).alias("sha256"))
    status = {r.name: (r.status, r.error) for r in files.import_manifest(members, seen).collect()}
    assert status == {"extra.txt": ("queued", None), "../outside.txt": ("failed", "UNSAFE_PATH"), "inner.zip": ("nested", None), "b.exe": ("unsupported", None), "old.md": ("duplicate", None), "in/a.csv": ("queued", None), "link.txt": ("failed", "LINK_OR_DEVICE")}
    results, parsed = files.parse(listing)
    states = {r.path.rsplit("/", 1)[1]: (r.state, r.error, r.n_blocks) for r in results.collect()}
    assert states["d.docx"] == ("ready", None, 2) and states["p.pptx"] == ("review_required", None, 1) and states["bad.docx"] == ("failed", "PARSE_FAILED", 0)
    assert states["lie.pdf"] == ("quarantined", "MIME_MISMATCH", 0) and states["x.zip"] == ("failed", "ARCHIVE_REQUIRES_IMPORT", 0) and states["t.tar.gz"][1] == "ARCHIVE_REQUIRES_IMPORT"
    assert [r.markdown for r in results.filter("path like '%/d.docx'").collect()] == ["# d.docx\n\nOne\n\nTwo\n"] and parsed.count() == 4
    odd = spark.createDataFrame([("in/a.txt", bytearray(b"\xff\xfe")), ("in/b.md", bytearray("# T\n\nx".encode())), ("in/c.gif", bytearray(b"g")), ("in/d.csv", bytearray(b"a,\xff")), ("in/none", bytearray())], "path string, content binary")
    assert {r.path: (r.state, r.error, r.warning) for r in files.parse(odd)[0].collect()} == {
        "in/a.txt": ("failed", "ENCODING_INVALID", None), "in/b.md": ("ready", None, None), "in/c.gif": ("review_required", None, "OCR_PROVIDER_REQUIRED"), "in/d.csv": ("failed", "ENCODING_INVALID", None), "in/none": ("unsupported", "UNSUPPORTED_FORMAT", None),
    }
    before = listing.select("path", "length", "modificationTime")
    after = before.withColumn("length", F.when(F.col("path").endswith("lie.pdf"), 1).otherwise(F.col("length"))).filter(~F.col("path").endswith("x.zip"))
    change = {r.path.rsplit("/", 1)[1]: r.change for r in files.changed_files(before, after).collect()}
    assert change["lie.pdf"] == "changed" and change["x.zip"] == "removed" and change["d.docx"] == "same"
    blobs = files.put_blobs(spark.createDataFrame([], "workspace_id string, sha256 string, path string, size long"), listing.withColumn("workspace_id", F.lit("w")))
    assert blobs.count() == listing.count() and files.put_blobs(blobs, listing.withColumn("workspace_id", F.lit("w"))).count() == blobs.count()
    manifest = listing.select("path", F.sha2("content", 256).alias("sha256"))
    assert files.verify_manifest(manifest, manifest).isEmpty()
    assert [r.fault for r in files.verify_manifest(manifest, manifest.filter(~F.col("path").endswith("x.zip"))).collect()] == ["missing"]


def test_revisions(spark):
    rev = spark.createDataFrame([("a", 1, "one", False), ("a", 2, "two", False), ("b", 1, "bee", False)], "logical_id string, revision_number long, content string, excluded boolean")
    edits = spark.createDataFrame([("a", 2, "three", True), ("b", 5, "no", False)], "logical_id string, base_revision long, content string, excluded boolean")
    new, bad = L.append_revision(rev, edits)
    now = L.latest(new, ["logical_id"], F.desc("revision_number"))
    assert {(r.logical_id, r.content) for r in now.filter("not excluded").collect()} == {("b", "bee")}
    assert [r.error for r in bad.collect()] == ["CHUNK_REVISION_CONFLICT"]
    split = L.split_revision(rev, spark.createDataFrame([("b", ["x", "y"])], "logical_id string, parts array<string>"))
    live = L.latest(split, ["logical_id"], F.desc("revision_number")).filter("not excluded")
    assert {r.content for r in live.collect()} == {"two", "x", "y"}
    merged = L.merge_revisions(rev, spark.createDataFrame([("g", "a", 1), ("g", "b", 2)], "group_id string, logical_id string, ordinal int"))
    live = L.latest(merged, ["logical_id"], F.desc("revision_number")).filter("not excluded")
    assert [r.content for r in live.collect()] == ["two\n\nbee"]


def test_audit_chain(spark):
    import hashlib
    import json

    events = spark.createDataFrame([("w", i, f"a\"ct{i}", '{"k":1}') for i in range(6)] + [("v", 1, None, "{}")], "workspaceId string, eventId int, action string, details string")
    empty = events.limit(0).select("*", F.lit("").alias("previous_hash"), F.lit("").alias("event_hash"))
    first = L.append_events(empty, events.filter("eventId < 3"), "workspaceId", "eventId", L.AUDIT_JSON)
    chain = L.append_events(first, events.filter("eventId >= 3"), "workspaceId", "eventId", L.AUDIT_JSON)
    prev = "GENESIS"
    for r in chain.filter("workspaceId = 'w'").orderBy("eventId").collect():
        body = json.dumps({"eventId": r.eventId, "workspaceId": "w", "action": r.action, "details": {"k": 1}, "previous": prev}, separators=(",", ":"))
        assert (r.previous_hash, r.event_hash) == (prev, hashlib.sha256(body.encode()).hexdigest())
        prev = r.event_hash
    check = lambda c: {r.workspaceId: tuple(r)[1:] for r in L.verify_chain(c, "workspaceId", "eventId", L.AUDIT_JSON).collect()}
    assert check(chain) == {"w": (6, 0, None, None), "v": (1, 0, None, None)}
    assert check(chain.withColumn("action", F.when(F.col("eventId") == 3, "x").otherwise(F.col("action"))))["w"] == (6, 1, 3, "event_hash mismatch")
    assert check(chain.filter("eventId != 2"))["w"][2:] == (3, "previous_hash mismatch")


def test_an_archive_stops_at_its_budget(spark):
    data = zipped({"a.txt": "a", "big.txt": "0" * 500_000, "c.txt": "c"})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("a.txt", "a"), ("big.txt", "0" * 5_000_000), ("c.txt", "c")):
            z.writestr(name, text)
    rows = spark.createDataFrame([("x.zip", bytearray(data)), ("y.zip", bytearray(out.getvalue()))], "path string, content binary")
    got = {(r.archive, r.name): r.error for r in files.expand_archives(rows).collect()}
    assert got == {("x.zip", "a.txt"): None, ("x.zip", "big.txt"): None, ("x.zip", "c.txt"): None, ("y.zip", "a.txt"): None, ("y.zip", "big.txt"): "ARCHIVE_BUDGET"}


def test_vector_channel_in_blocks(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 8))
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0])], "chunk_id long, embedding array<double>")
    asked = chunks.filter("chunk_id < 10").select(F.col("chunk_id").alias("query_id"), "embedding")
    want = {(q, int(c)) for q in range(10) for c in np.argsort(-(x @ x[q]))[:5]}
    for size in (256, 3):
        monkeypatch.setattr(S, "QUERIES_AT_ONCE", size)
        assert {(r.query_id, r.chunk_id) for r in S.vector_channel(asked, chunks, 5).collect()} == want


def test_idempotent_tasks(spark):
    tasks = spark.createDataFrame([("k1", "f", "succeeded"), ("k2", "f", "failed"), ("k3", "g", "running")], "idempotency_key string, fingerprint string, status string")
    req = spark.createDataFrame([("k1", "f"), ("k1", "f"), ("k2", "f"), ("k3", "f"), ("k4", "f")], "idempotency_key string, fingerprint string")
    assert {r.idempotency_key: r.outcome for r in L.idempotent_create(tasks, req).collect()} == {"k1": "reused", "k2": "requeued", "k3": "conflict", "k4": "created"}
    assert {r.status for r in L.recover(tasks).collect()} == {"succeeded", "failed", "queued"}


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name)

    got = run(E.tumbling_counts(stream, "ts", "1 day", "event_type", delay="60 days"), "complete", "days")
    assert sorted(map(str, got.collect())) == sorted(map(str, E.tumbling_counts(events, "ts", "1 day", "event_type").collect()))
    nonces = run(E.first_nonces(stream.withColumn("nonce", F.col("event_id") % 50), ["nonce"], "ts", "60 days"), "append", "nonces")
    assert nonces.count() == 50
    tasks = stream.select(F.lit("t").alias("task_id"), F.col("event_id").alias("sequence"), F.element_at(F.array(F.lit("queued"), F.lit("running"), F.lit("succeeded")), (F.col("event_id") + 1).cast("int")).alias("state")).filter("sequence < 3")
    last = run(E.task_states(tasks), "update", "folded").collect()
    assert max(last, key=lambda r: r.n_events).n_events == 3


def test_requests_in_order(spark):
    tasks = spark.createDataFrame([("ok", "f", "succeeded"), ("bad", "f", "failed")], "idempotency_key string, fingerprint string, status string")
    rows = [("new", "b", 2), ("new", "a", 3), ("new", "b", 4), ("ok", "f", 1), ("ok", "g", 2), ("bad", "f", 5), ("bad", "f", 6), ("bad", "h", 4), (None, "x", 1), (None, "x", 1), ("nil", None, 1), ("nil", None, 2), ("nil", "z", 3)]
    requests = spark.createDataFrame(rows, "idempotency_key string, fingerprint string, sequence int").withColumn("status", F.lit("extra"))
    want = dict(zip(rows, ["created", "conflict", "reused", "reused", "conflict", "requeued", "reused", "conflict", "created", "created", "created", "reused", "conflict"]))
    got = L.create_in_order(tasks, requests).collect()
    assert len(got) == len(rows) and {(r.idempotency_key, r.fingerprint, r.sequence): r.outcome for r in got} == want
    assert L.create_in_order(tasks, requests.limit(0)).count() == 0
    assert {r.outcome for r in L.create_in_order(tasks.limit(0), requests.filter("sequence = 1 and fingerprint is not null")).collect()} == {"created"}
