"""Releases as folders on shared storage, and a log of which one is active.

A release is built beside its place, checked as it was written, and renamed into it with its manifest, so what lies under its name is whole. What is active is
the last entry of a log whose entries are created exclusively, one number each: of two sessions that switch at once one gets a conflict, and readers see the old
or the new release, never a mixture. A build that fails, at whatever step, leaves the log as it was.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.functions import vectors as V
from trovelight.operators import hierarchy, lifecycle
from trovelight.sources import store

#: What a chunk of a release must name, for answers to cite it.
PROVENANCE = ("document", "revision", "artifact", "content")
MODEL = "hash-embedding-128"
PUBLISHED = ["chunk_id", "document", "revision", "artifact", "content"]
#: Rows of a partition in which texts meet their ordinals.
ROWS_AT_ONCE = 20_000


class ReleaseError(RuntimeError):
    """A build or switch that was refused; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Release:
    dataset: str
    release: str
    version: int
    content: str
    n_chunks: int
    n_reused: int
    n_blocking: int


def _empty(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


class ReleaseLog:
    """The releases of datasets below ``root`` (``spark.checkpoint.dir`` where it isn't given)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.folder = spark, store.Folder(spark, root or f"{store.shared_dir(spark)}/published")

    # --- files -----------------------------------------------------------------------------------------------------------

    @staticmethod
    def _place(dataset: str) -> str:
        return hashlib.sha256(dataset.encode()).hexdigest()[:32]

    def _write(self, name: str, value: dict) -> bool:
        """Create a small file; False if it is there."""
        try:
            out = self.folder.create(name)
        except FileExistsError:
            return False
        out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        out.close()
        return True

    def _read(self, name: str) -> dict | None:
        """A small file; None where it is missing or was never finished."""
        if not self.folder.has(name):
            return None
        try:
            return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder.root}/{name}", wholetext=True).collect()))  # a few hundred bytes
        except ValueError:
            return None

    # --- the log -----------------------------------------------------------------------------------------------------------

    def _entries(self, dataset: str) -> list[int]:
        return [int(n) for n in self.folder.names(f"{self._place(dataset)}/log") if n.isdigit()]

    def history(self, dataset: str) -> list[dict]:
        """Switches in their order: release, previous, action. Entries that a session began and never finished count as none."""
        found = [self._read(f"{self._place(dataset)}/log/{n:012d}") for n in self._entries(dataset)]
        return [f for f in found if f]

    def active(self, dataset: str) -> str | None:
        for n in reversed(self._entries(dataset)):
            if found := self._read(f"{self._place(dataset)}/log/{n:012d}"):
                return found["release"]
        return None

    def manifest(self, dataset: str, release: str) -> Release | None:
        found = self._read(f"{self._place(dataset)}/{release}/manifest.json")
        return Release(**found) if found else None

    def chunks(self, dataset: str, release: str | None = None) -> DataFrame:
        """The rows of a release, by default of the active one."""
        release = release or self.active(dataset)
        if release is None or self.manifest(dataset, release) is None:
            raise ReleaseError("NOT_FOUND", f"{dataset} has no release {release or 'that is active'}")
        return self.spark.read.parquet(f"{self.folder.root}/{self._place(dataset)}/{release}/chunks")

    def states(self, dataset: str) -> dict[str, str]:
        """active, superseded or ready for each whole release of a dataset."""
        now, past = self.active(dataset), {e["release"] for e in self.history(dataset)}
        names = [n for n in self.folder.names(self._place(dataset)) if n.startswith("rel_")]
        return {n: "active" if n == now else "superseded" if n in past else "ready" for n in names}

    def switch(self, dataset: str, release: str, action: str = "activate", after: int | None = None) -> None:
        """Make a whole release active. ``after`` is the log's length that the caller saw; RELEASE_CONFLICT if another switch came first."""
        if self.manifest(dataset, release) is None:
            raise ReleaseError("INVALID_STATE", f"{release} is no whole release")
        after = self.position(dataset) if after is None else after
        entry = {"release": release, "previous": self.active(dataset), "action": action}
        if after != self.position(dataset) or not self._write(f"{self._place(dataset)}/log/{after + 1:012d}", entry):
            raise ReleaseError("RELEASE_CONFLICT", f"another switch of {dataset} came first")

    def position(self, dataset: str) -> int:
        return max(self._entries(dataset), default=0)

    def rollback(self, dataset: str, release: str) -> None:
        """Make an older release active again; the active one can't be rolled back to."""
        if release == self.active(dataset):
            raise ReleaseError("INVALID_STATE", f"{release} is active")
        self.switch(dataset, release, "rollback")

    # --- builds --------------------------------------------------------------------------------------------------------------

    @staticmethod
    def _included(chunks: DataFrame, *more: Column) -> DataFrame:
        """Chunks that aren't excluded, with the hashes of what is published of them."""
        hashes = [h.alias(f"_hash{i}") for i, h in enumerate(store.row_hashes(PUBLISHED))]
        return chunks.filter(~F.coalesce("excluded", F.lit(False))).select(*PUBLISHED, *hashes, *more)

    @staticmethod
    def _live(chunks: DataFrame, documents: DataFrame) -> DataFrame:
        return chunks.join(documents.filter(~F.col("status").eqNullSafe("deleted")).select("document"), "document", "left_semi")

    @classmethod
    def publishable(cls, chunks: DataFrame, documents: DataFrame) -> DataFrame:
        return cls._live(cls._included(chunks), documents).select(*PUBLISHED)

    def fingerprint(self, chunks: DataFrame, documents: DataFrame, config_hash: str = "") -> str:
        """A name for what a build would publish, to be held against it later. Only documents and hashes are shuffled."""
        keys = self._live(self._included(chunks).select("document", "_hash0", "_hash1"), documents)
        return hashlib.sha256(f"{store.combined(keys, [F.col('_hash0'), F.col('_hash1')])}|{config_hash}".encode()).hexdigest()

    def build(self, dataset: str, chunks: DataFrame, documents: DataFrame, config_hash: str = "", expected: str | None = None, allow_review: bool = False, activate: bool = True) -> Release:
        """Publish the latest revisions ``chunks(chunk_id, document, revision, artifact, content, excluded)`` of ``documents(document, status)``.

        Refusals: RELEASE_CONTENT_CHANGED (``expected`` is a fingerprint and the content another), RELEASE_QUALITY_BLOCKED (documents in a state that blocks, unless
        ``allow_review``), NO_PUBLISHABLE_CHUNKS, RELEASE_VALIDATION_FAILED (a written row lacks a document, revision, artifact or content), RELEASE_CONFLICT.
        The same content, configuration and review rule are the same release: it is built once, and asked for again it is only switched to. Rows are numbered from 1
        by (chunk_id, document, content); repeated rows count each, further columns are ignored. Embeddings of texts that the active release has too are taken from
        it, the others are computed. What is live, its fingerprint and its order are found from keys and hashes, so texts are shuffled once, to their ordinals, and never
        sorted. Chunks are read twice: they must not change in between, for which the written rows are held against the fingerprint.
        """
        begun, before = self.position(dataset), self.active(dataset)
        content = self.fingerprint(chunks, documents, config_hash)
        if expected is not None and expected != content:
            raise ReleaseError("RELEASE_CONTENT_CHANGED")
        name = "rel_" + hashlib.sha256(f"{dataset}|{content}|{'review' if allow_review else 'strict'}".encode()).hexdigest()[:32]
        found = self.manifest(dataset, name)
        if found is None:
            blocking = documents.filter(F.col("status").isin(*lifecycle.UNPUBLISHABLE)).count()
            if blocking and not allow_review:
                raise ReleaseError("RELEASE_QUALITY_BLOCKED", f"{blocking} documents")
            found = self._built(dataset, name, chunks, documents, content, config_hash, blocking, before)
        if activate and before != name:
            self.switch(dataset, name, after=begun)
        return found

    def _built(self, dataset: str, name: str, chunks: DataFrame, documents: DataFrame, content: str, config_hash: str, blocking: int, before: str | None) -> Release:
        place = self._place(dataset)
        draft = f"{place}/_new-{uuid.uuid4().hex}"
        try:
            order = ["chunk_id", "document", "content_sha256"]
            digest = F.sha2(F.coalesce("content", F.lit("")), 256)
            chunks = store.written(self.spark, self._included(chunks, digest.alias("content_sha256"), F.monotonically_increasing_id().alias("_row")), "release")
            keys = store.written(self.spark, self._live(chunks.select("_row", *order), documents), "release")
            numbered = hierarchy.running(keys.select("_row", *order, F.lit(dataset).alias("_dataset")), "_dataset", order, F.lit(0), ("ordinal", "_none")).select("_row", "ordinal", "content_sha256")
            self._with_vectors(chunks, numbered, keys.count(), dataset, before).write.parquet(f"{self.folder.root}/{draft}/chunks")
            rows = self.spark.read.parquet(f"{self.folder.root}/{draft}/chunks")
            faulty = F.lit(False)
            for column in PROVENANCE:
                faulty = faulty | _empty(column)
            n, bad, reused = rows.agg(F.count("*"), F.count_if(faulty), F.count_if("reused")).first()
            if not n:
                raise ReleaseError("NO_PUBLISHABLE_CHUNKS")
            if bad:
                raise ReleaseError("RELEASE_VALIDATION_FAILED", f"{bad} of {n} chunks without their sources")
            written = store.fingerprint(rows, PUBLISHED)
            if hashlib.sha256(f"{written}|{config_hash}".encode()).hexdigest() != content:
                raise ReleaseError("RELEASE_CONTENT_CHANGED", "while it was built")
            version = 1 + max((m.version for r in self.states(dataset) if (m := self.manifest(dataset, r))), default=0)
            made = Release(dataset, name, version, content, n, reused, blocking)
            self._write(f"{draft}/manifest.json", vars(made))
            if not self.folder.rename(draft, f"{place}/{name}"):
                made = self.manifest(dataset, name)  # another session built the same
            return made
        finally:
            self.folder.remove(draft)

    def _with_vectors(self, rows: DataFrame, numbered: DataFrame, n: int, dataset: str, before: str | None) -> DataFrame:
        """The ``n`` numbered rows with model, embedding and reused. A text that very many rows share is looked up by broadcast of that key, so no task gets all of its rows."""
        if before is not None:
            old = self.chunks(dataset, before).filter(F.col("model") == MODEL).groupBy("content_sha256").agg(F.first("embedding").alias("embedding"))  # equal for equal texts
            numbered = hierarchy.lookup(store.written(self.spark, numbered, "release"), old, "content_sha256")
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_AT_ONCE))
        found = numbered.drop("content_sha256").repartition(parts, "_row").hint("shuffle_hash")
        both = rows.select("_row", *PUBLISHED, "content_sha256").repartition(parts, "_row").join(found, "_row").drop("_row")
        both = both.withColumn("reused", F.lit(False) if before is None else F.col("embedding").isNotNull())
        return V.with_embedding(both, "content").withColumn("model", F.lit(MODEL))
