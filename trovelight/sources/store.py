"""What is derived from a release, kept on shared storage under the content of its input.

An entry is found by a fingerprint of the rows it was made from, so a table that was replaced gets another entry, and sessions share what one of them has
made. Entries are written beside their place and renamed into it, so a build that fails leaves nothing behind. The least recently used go first.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a temporary folder on a single machine where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _OWN.setdefault("dir", "") or f"file://{tempfile.mkdtemp(prefix='trovelight-')}"
        _OWN["dir"] = found
    return found.rstrip("/")


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_hashes(columns: list[str]) -> list[Column]:
    """The two hashes of a row that ``fingerprint`` sums."""
    each = F.struct(*columns)
    return [F.xxhash64(F.lit(seed), each) for seed in (1, 2)]


def combined(df: DataFrame, hashes: list[Column]) -> str:
    """The fingerprint of rows whose hashes are given."""
    n, a, b = df.agg(F.count("*"), *[F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string") for h in hashes]).first()
    return f"{n}-{int(a) % (1 << 64):016x}{int(b) % (1 << 64):016x}"


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> str:
    """A name for the rows of ``df`` in any order: their number and the sums of two hashes of each. One scan, no shuffle of rows."""
    return combined(df, row_hashes(columns or df.columns))


class Folder:
    """Existence, listing, renaming and removal below a folder of any store that Hadoop reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = root.rstrip("/"), spark._jvm
        self._fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, below: str = "") -> list[str]:
        if not self._fs.exists(self.path(below)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(below)))

    def has(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def rename(self, old: str, new: str) -> bool:
        return not self.has(new) and self._fs.rename(self.path(old), self.path(new))

    def remove(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def touch(self, name: str) -> None:
        self._fs.mkdirs(self.path(name).getParent())
        self._fs.create(self.path(name), True).close()

    def create(self, name: str):
        """An output stream of a new file; FileExistsError if the file is there, whoever made it."""
        self._fs.mkdirs(self.path(name).getParent())
        try:
            return self._fs.create(self.path(name), False)
        except Py4JJavaError as error:
            if self.has(name):
                raise FileExistsError(name) from error
            raise

    def changed(self, name: str) -> int:
        return self._fs.getFileStatus(self.path(name)).getModificationTime() if self.has(name) else 0


class ReleaseStore:
    """Entries by kind and content, at most ``most`` of a kind."""

    def __init__(self, spark: SparkSession, most: int = 4, root: str | None = None):
        self.spark, self.most = spark, most
        self.folder = Folder(spark, root or f"{shared_dir(spark)}/releases")

    def path(self, kind: str, content: str, build: Callable[[str], None]) -> str:
        """The folder of an entry; ``build`` writes it to the path it is given, if no one has before."""
        name = f"{kind}-{content}"
        if not self.folder.has(name):
            made = f"_new-{uuid.uuid4().hex}"
            try:
                build(f"{self.folder.root}/{made}")
                self.folder.rename(made, name)  # another session may have been first
            finally:
                self.folder.remove(made)
        self.folder.touch(f"_used/{name}")
        entries = [n for n in self.folder.names() if n.startswith(f"{kind}-") and n != name]
        for old in sorted(entries, key=lambda n: self.folder.changed(f"_used/{n}"), reverse=True)[self.most - 1 :]:
            self.folder.remove(old)
            self.folder.remove(f"_used/{old}")
        return f"{self.folder.root}/{name}"

    def table(self, kind: str, content: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self.spark.read.parquet(self.path(kind, content, lambda path: build().write.parquet(path)))
