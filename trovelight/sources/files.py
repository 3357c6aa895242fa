"""File sources: format detection, text blocks, CSV, archives, office files, directory snapshots and content-addressed sinks."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovelight.functions import text as T
from trovelight.operators import hierarchy

#: Media types by extension.
MEDIA = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "csv": "text/csv", "md": "text/markdown", "txt": "text/plain", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "bmp": "image/bmp", "tif": "image/tiff",
    "tiff": "image/tiff", "webp": "image/webp", "gif": "image/gif", "zip": "application/zip", "tar": "application/x-tar", "tar.gz": "application/gzip", "tgz": "application/gzip",
}
ZIPPED = ("docx", "pptx", "xlsx")
IMAGES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp", "gif")
ARCHIVES = ("zip", "tar", "tar.gz", "tgz")
MAX_FILES, MAX_BYTES, MAX_FILE_BYTES, MAX_RATIO, MAX_DEPTH = 250, 200 << 20, 50 << 20, 100, 32
#: States of a document after an error; every other error leaves it failed.
ERROR_STATES = {"NEEDS_PASSWORD": "needs_password", "UNSUPPORTED_FORMAT": "unsupported", "MIME_MISMATCH": "quarantined"}


def read_files(spark: SparkSession, path: str, excludes: list[str] | None = None) -> DataFrame:
    """binaryFile listing below a folder, without paths that hold an excluded part (lower case)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    for part in excludes or []:
        files = files.filter(~F.contains(F.lower("path"), F.lit(part.lower())))
    return files


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(?i)\.(tar\.gz|[A-Za-z0-9]+)$", 1))


def detect(files: DataFrame) -> DataFrame:
    """Add ``media_type`` or ``error``: unsupported extensions, and contents that don't begin as the extension says."""
    ext = extension(F.col("path"))
    media = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    head = F.substring(F.hex("content"), 1, 10)
    lies = ((ext == "pdf") & ~head.startswith("255044462D")) | (ext.isin(*ZIPPED) & ~head.startswith("504B"))
    error = F.when(F.try_element_at(media, ext).isNull(), "UNSUPPORTED_FORMAT").when(lies, "MIME_MISMATCH")
    return files.withColumn("media_type", F.when(error.isNull(), F.try_element_at(media, ext))).withColumn("error", error)


def safe_path(path: Column) -> Column:
    """A relative path with unsafe characters replaced; null for absolute ones, drives, NUL, '..' and more than 32 levels."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    bad = path.rlike(r"^[/\\]|^[A-Za-z]:|\x00") | F.exists(parts, lambda p: p == "..") | (F.size(parts) > MAX_DEPTH) | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(F.transform(parts, lambda p: T.safe_filename(p)), "/"))


def split_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ordinal, type, content_md, content_text, start_line, end_line: blocks between blank lines.

    A block's end is the line of the blank that closes it, or the last line. Its first line makes it a heading, code or a paragraph.
    """
    lines = df.select(key, F.posexplode(F.split(T.clean_controls(F.col(text)), "\n")).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i")
    blank = F.trim(F.regexp_replace("line", r"\s", " ")) == ""
    numbered = lines.withColumn("blank", blank).withColumn("island", F.sum(F.when(F.col("blank"), 1).otherwise(0)).over(w)).withColumn("last", F.max("i").over(Window.partitionBy(key)))
    block = numbered.filter(~F.col("blank")).groupBy(key, "island").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.max("last").alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("content_md"))
    kind = F.when(F.col("content_md").rlike(r"^#{1,6}\s"), "heading").when(F.col("content_md").startswith("```"), "code").otherwise("paragraph")
    plain = F.when(F.col("content_md").rlike(r"^#{1,6}\s"), F.regexp_replace("content_md", r"^#{1,6}\s+", "")).otherwise(F.col("content_md"))
    end = F.when(F.col("b") == F.col("last"), F.col("b") + 1).otherwise(F.col("b") + 2)
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("a"))
    return block.select(key, ordinal.alias("ordinal"), kind.alias("type"), "content_md", F.trim(plain).alias("content_text"), (F.col("a") + 1).alias("start_line"), end.alias("end_line"))


def csv_block(content: Column) -> Column:
    """One table block of a UTF-8 CSV (its byte-order mark dropped): cells joined by ' | '. Quoted cells keep their commas."""
    body = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    rows = F.filter(F.split(body, r"\r?\n"), lambda r: r != "")
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(1)), lambda c: F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"')))
    trimmed = lambda r: F.slice(cells(r), 1, F.greatest(F.lit(1), F.size(cells(r)) - F.when(r.endswith(","), 0).otherwise(1)))
    return F.array_join(F.transform(rows, lambda r: F.array_join(trimmed(r), " | ")), "\n")


def _texts(xml: bytes, tag: str) -> list[str]:
    return ["".join(node.itertext()) for node in ElementTree.fromstring(xml).iter() if node.tag.rpartition("}")[2] == tag]


def _office(ext: str, data: bytes) -> list[tuple[str, str, int, str]]:
    """(block type, text, page, sheet) of one office file."""
    z = zipfile.ZipFile(io.BytesIO(data))
    if ext == "docx":
        return [("paragraph", p, 0, "") for p in _texts(z.read("word/document.xml"), "p") if p.strip()]
    if ext == "pptx":
        slides = sorted((n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(filter(str.isdigit, posixpath.basename(n))) or 0))
        return [("paragraph", t, i, "") for i, n in enumerate(slides, 1) if (t := "\n".join(x for x in _texts(z.read(n), "p") if x.strip()))]
    shared = _texts(z.read("xl/sharedStrings.xml"), "si") if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for n in sorted((x for x in z.namelist() if x.startswith("xl/worksheets/sheet")), key=lambda x: int("".join(filter(str.isdigit, posixpath.basename(x))) or 0)):
        rows = []
        for row in (r for r in ElementTree.fromstring(z.read(n)).iter() if r.tag.endswith("}row")):
            cells = []
            for c in (c for c in row if c.tag.endswith("}c")):
                value = next(("".join(v.itertext()) for v in c if v.tag.endswith("}v") or v.tag.endswith("}is")), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            rows.append(" | ".join(cells))
        out.append(("table", "\n".join(rows), 0, posixpath.basename(n).removesuffix(".xml")))
    return out


def office_blocks(files: DataFrame) -> DataFrame:
    """path, ordinal, type, content_text, slide, sheet, error of docx, pptx and xlsx files; one row with an error where a file can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, ext, data in zip(pdf["path"], pdf["ext"], pdf["content"]):
                try:
                    rows += [(path, i, kind, text, slide, sheet, None) for i, (kind, text, slide, sheet) in enumerate(_office(ext, bytes(data)), 1)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    rows.append((path, 0, None, None, 0, "", f"PARSE_FAILED: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "ordinal", "type", "content_text", "slide", "sheet", "error"])

    some = files.withColumn("ext", extension(F.col("path"))).filter(F.col("ext").isin(*ZIPPED)).select("path", "ext", "content")
    return some.mapInPandas(run, "path string, ordinal int, type string, content_text string, slide int, sheet string, error string")


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All readable formats in one plan: (results, blocks) of files(path, content).

    results: path, media_type, state, error, n_blocks, markdown, quality_status, publishable. blocks: path, ordinal, type, content_md, content_text, token_count. A file goes to the branch of its
    extension: text, CSV, office files, or images, which need a text provider and so a review. Slides and images are to be reviewed; what can't be read has the state of its error.
    """
    seen = detect(files).withColumn("ext", extension(F.col("path")))
    good = seen.filter("error is null")
    text = good.filter(F.col("ext").isin("md", "txt", "csv")).select("path", "ext", F.col("content").cast("string").alias("t"), F.is_valid_utf8(F.col("content").cast("string")).alias("whole"))
    blocks = split_blocks(text.filter("whole and ext != 'csv'"), "path", "t").select("path", "ordinal", "type", "content_md", "content_text")
    table = text.filter("whole and ext = 'csv'").select("path", F.lit(1).alias("ordinal"), F.lit("table").alias("type"), csv_block(F.encode("t", "UTF-8")).alias("content_md")).withColumn("content_text", F.col("content_md"))
    office = office_blocks(good)
    read = office.filter("error is null").select("path", "ordinal", "type", F.col("content_text").alias("content_md"), "content_text")
    all_blocks = blocks.unionByName(table).unionByName(read).filter(F.trim("content_text") != "").withColumn("token_count", T.token_estimate(F.col("content_text")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "content_md"))), lambda x: x["content_md"]), "\n\n")  # the blocks of one file
    per_file = all_blocks.groupBy("path").agg(F.count("*").alias("n_blocks"), body.alias("body"))
    broken = office.filter("error is not null").select("path", F.lit("PARSE_FAILED").alias("_broken")).unionByName(text.filter("not whole").select("path", F.lit("ENCODING_INVALID").alias("_broken")))
    rows = seen.select("path", "media_type", "ext", "error").join(broken, "path", "left").join(per_file, "path", "left")
    error = F.coalesce("error", "_broken", F.when(F.col("ext").isin(*ARCHIVES), "ARCHIVE_REQUIRES_IMPORT"), F.when(F.col("ext") == "pdf", "PARSER_DEPENDENCY_UNAVAILABLE"))
    rows = rows.withColumn("error", error).withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
    review = F.col("ext").isin("pptx", *IMAGES)
    quality = F.when(F.col("error").isNotNull(), F.lit(None).cast("string")).when(review, "review_required").otherwise("publishable")
    failed = F.coalesce(*[F.when(F.col("error") == e, s) for e, s in ERROR_STATES.items()], F.lit("failed"))
    state = F.when(F.col("error").isNotNull(), failed).when(quality == "publishable", "ready").otherwise("review_required")
    title = F.element_at(F.split("path", "/"), -1)
    markdown = F.when(F.col("error").isNull(), F.concat(F.trim(F.concat(F.lit("# "), title, F.lit("\n\n"), F.coalesce("body", F.lit("")))), F.lit("\n")))
    warning = F.when(F.col("ext").isin(*IMAGES) & F.col("error").isNull(), "OCR_PROVIDER_REQUIRED")
    results = rows.select("path", "media_type", state.alias("state"), "error", warning.alias("warning"), "n_blocks", markdown.alias("markdown"), quality.alias("quality_status"), F.coalesce((quality == "publishable") & (F.col("n_blocks") > 0), F.lit(False)).alias("publishable"))
    return results, all_blocks


class _Budget:
    """What may still be read of one archive; asked before a member is."""

    def __init__(self, packed: int):
        self.files, self.left = 0, min(MAX_BYTES, MAX_RATIO * max(1, packed))

    def refuses(self, size: int) -> str | None:
        self.files += 1
        self.left -= size
        return "ARCHIVE_BUDGET" if self.files > MAX_FILES or self.left < 0 else "FILE_TOO_LARGE" if size > MAX_FILE_BYTES else None


def _members(name: str, data: bytes) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """(member, size, content, error) of a zip, tar or tar.gz; what the budget refuses is not decompressed, and nothing after it is looked at."""
    budget = _Budget(len(data))
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    over = budget.refuses(m.file_size)
                    error = over if over == "ARCHIVE_BUDGET" else "ENCRYPTED" if m.flag_bits & 1 else over
                    yield m.filename, m.file_size, None if error else z.read(m), error
                    if over == "ARCHIVE_BUDGET":
                        return
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if not m.isdir():
                    over = budget.refuses(m.size)
                    error = over if over == "ARCHIVE_BUDGET" else "LINK_OR_DEVICE" if not m.isfile() else over
                    yield m.name, m.size, None if error else t.extractfile(m).read(), error
                    if over == "ARCHIVE_BUDGET":
                        return


def expand_archives(files: DataFrame) -> DataFrame:
    """archive, path (safe, null if rejected), size, content, error for each member, within the budgets of files, bytes and ratio; the member that breaks one is the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    for name, size, content, error in _members(path, bytes(data)):
                        rows.append((path, name, size, content, error))
                except (zipfile.BadZipFile, tarfile.TarError, EOFError) as e:
                    rows.append((path, None, 0, None, f"BAD_ARCHIVE: {type(e).__name__}"))
                yield pd.DataFrame(rows, columns=["archive", "name", "size", "content", "error"])

    some = files.filter(F.lower("path").rlike(r"\.(zip|tar|tar\.gz|tgz)$")).select("path", "content")
    out = some.mapInPandas(run, "archive string, name string, size long, content binary, error string").withColumn("path", safe_path(F.col("name")))
    twice = F.count("*").over(Window.partitionBy("archive", "path")) > 1
    error = F.coalesce("error", F.when(F.col("path").isNull() & F.col("name").isNotNull(), "UNSAFE_PATH"), F.when(F.col("path").isNotNull() & twice, "DUPLICATE_PATH"))
    return out.withColumn("error", error)


def import_manifest(members: DataFrame, seen: DataFrame) -> DataFrame:
    """Status of each member: failed, nested, unsupported, duplicate or queued."""
    ext, sha = extension(F.col("path")), F.sha2("content", 256)
    known = seen.select("sha256").distinct().withColumn("_known", F.lit(True))
    rows = members.withColumn("sha256", sha).join(known, "sha256", "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(ext.isin(*ARCHIVES), "nested").when(~ext.isin(*MEDIA), "unsupported").when(F.col("_known"), "duplicate").otherwise("queued")
    return rows.withColumn("status", status).drop("_known")


def put_blobs(base: DataFrame, blobs: DataFrame) -> DataFrame:
    """Content-addressed insert if absent: workspace_id, sha256, path ws/aa/bb/sha256, size."""
    sha = F.sha2("content", 256)
    new = blobs.select("workspace_id", sha.alias("sha256"), F.concat_ws("/", "workspace_id", F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha).alias("path"), F.octet_length("content").cast("long").alias("size"))
    return base.unionByName(new.dropDuplicates(["workspace_id", "sha256"]).join(base.select("workspace_id", "sha256"), ["workspace_id", "sha256"], "left_anti"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, removed, changed, same) of two listings by size and modification time."""
    a = before.select("path", F.col("length").alias("l0"), F.col("modificationTime").alias("m0"))
    b = after.select("path", F.col("length").alias("l1"), F.col("modificationTime").alias("m1"))
    change = F.when(F.col("l0").isNull(), "added").when(F.col("l1").isNull(), "removed").when((F.col("l0") != F.col("l1")) | (F.col("m0") != F.col("m1")), "changed").otherwise("same")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def plan_import(listing: DataFrame, excludes: list[str] = (), max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``listing(root, path, size, ...)`` as the import of each directory takes it: with position, bytes (up to the file) and status.

    Paths that hold an excluded part (lower case) are left out. The first ``max_files`` of a root by path are candidates, later ones ``beyond_files``. If the
    candidates together pass ``max_bytes``, all of the root are ``refused``. Else a file is ``unsupported`` (an unknown extension or an archive), ``resource_limit``
    (too large) or ``selected``. A null size is 0; rows without a path are left out; repeated paths count each, smaller first.
    """
    rows = listing.filter("path is not null")
    for part in excludes:
        rows = rows.filter(~F.contains(F.lower("path"), F.lit(part.lower())))
    rows = hierarchy.running(rows, "root", ["path", "size"], F.col("size"))
    # The total of a root is the running sum of its last candidate: one row for each root.
    over = rows.filter(F.col("position") <= max_files).groupBy("root").agg(F.max("bytes").alias("_total")).filter(F.col("_total") > max_bytes)
    over = over.select(F.col("root").alias("_root"), F.lit(True).alias("_over"))
    name = extension(F.col("path"))
    rows = rows.join(over, F.col("root").eqNullSafe(F.col("_root")), "left")
    status = F.when(F.col("position") > max_files, "beyond_files").when(F.col("_over"), "refused").when(~name.isin(*MEDIA) | name.isin(*ARCHIVES), "unsupported").when(F.col("size") > max_file_bytes, "resource_limit").otherwise("selected")
    return rows.withColumn("status", status).drop("_root", "_over")


def checked_import(plan: DataFrame, now: DataFrame, identity: list[str]) -> DataFrame:
    """Selected files of ``plan`` whose columns ``identity`` (size, times, inode, device, as far as known) differ in ``now`` fail with DIRECTORY_FILE_CHANGED."""
    seen = now.select(F.col("root").alias("_root"), F.col("path").alias("_path"), F.struct(*identity).alias("_now"), F.lit(True).alias("_seen")).dropDuplicates(["_root", "_path"])
    rows = plan.join(seen, F.col("root").eqNullSafe(F.col("_root")) & (F.col("path") == F.col("_path")), "left")
    same = F.reduce(F.array(*[F.col(c).isNull() | F.col(c).eqNullSafe(F.col("_now")[c]) for c in identity]), F.lit(True), lambda a, b: a & b)
    lost = (F.col("status") == "selected") & (F.col("_seen").isNull() | ~same)
    return rows.withColumn("code", F.when(lost, "DIRECTORY_FILE_CHANGED")).withColumn("status", F.when(lost, "failed").otherwise(F.col("status"))).drop("_root", "_path", "_now", "_seen")


def import_outcome(checked: DataFrame) -> DataFrame:
    """One row a root: n_files (candidates), n_failures, truncated, status (refused, partial or succeeded)."""
    taken = F.col("status") != "beyond_files"
    failed = F.count_if(F.col("status").isin("failed", "unsupported", "resource_limit"))
    status = F.when(F.count_if(F.col("status") == "refused") > 0, "refused").when(failed > 0, "partial").otherwise("succeeded")
    return checked.groupBy("root").agg(F.count_if(taken).alias("n_files"), failed.alias("n_failures"), (F.count_if(~taken) > 0).alias("truncated"), status.alias("status"))


def verify_manifest(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Files whose name is on one side only or whose sha256 differs; an empty result is a sound backup."""
    both = manifest.select("path", F.col("sha256").alias("a")).join(listing.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("a").isNull(), "unexpected").when(F.col("b").isNull(), "missing").otherwise("changed").alias("fault"))


def write_artifact(blocks: DataFrame, path: str, key: str) -> None:
    """Blocks partitioned by document revision, each with the checksum of its text."""
    blocks.withColumn("sha256", F.sha2("content_text", 256)).write.partitionBy(key).parquet(path)
