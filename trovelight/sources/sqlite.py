"""SQLite databases as a Spark data source: one file, or a folder of files that hold parts of one table (shards).

Reading is read-only by the connection itself and ends at a time limit. Ranges of row ids of each shard are the partitions, conditions run in the
database with Spark's meaning, and only the columns of the read schema are fetched. Writing makes one shard per task; a manifest that is replaced at the end names
the shards that count, so tasks that failed or ran twice leave nothing that is read.

Files must lie where driver and executors see them under the same path, such as a mounted shared folder. Streams, catalogs and updates in place aren't offered.
"""

from __future__ import annotations

import datetime
import glob
import json
import math
import os
import sqlite3
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

NAME = "sqlite_shards"
MANIFEST = "_shards.json"
#: Values of an ``in`` condition.
MOST_VALUES = 500
#: Rows of a batch that travels to Spark at once.
BATCH = 8_192
#: Spark types that a column may have, with the type a shard declares for it.
DECLARED = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "binary": "BLOB", "date": "TEXT", "timestamp_ntz": "TEXT"}
_WHOLE = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}


class SqliteError(RuntimeError):
    pass


def local_path(path: str) -> str:
    """The path without ``file:``; SqliteError for other stores, whose files SQLite can't open."""
    head, colon, rest = path.partition(":")
    if colon and "/" not in head:
        if head != "file":
            raise SqliteError(f"SQLite files need a mounted path, not {head}:")
        path = "/" + rest.lstrip("/")
    return path


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Reading:
    """A read-only connection whose statements may run for ``timeout_ms`` altogether; time that the caller spends between fetches doesn't count."""

    def __init__(self, path: str, timeout_ms: int):
        self.left, self._until = timeout_ms / 1000, math.inf
        try:
            self.raw = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True, timeout=self.left)
            self.raw.execute("PRAGMA query_only=ON")
            self.raw.execute("PRAGMA trusted_schema=OFF")
        except sqlite3.Error as error:
            raise SqliteError(f"can't open {path} for reading: {error}") from error
        self.raw.set_progress_handler(lambda: int(time.monotonic() > self._until), 1_000)

    def _timed(self, call):
        began = time.monotonic()
        self._until = began + self.left
        try:
            return call()
        except sqlite3.Error as error:
            raise SqliteError("over the time limit" if time.monotonic() > self._until else str(error)) from error
        finally:
            self.left -= time.monotonic() - began
            self._until = math.inf

    def batches(self, sql: str, values: list, size: int = BATCH) -> Iterator[list[tuple]]:
        cursor = self._timed(lambda: self.raw.execute(sql, values))
        while rows := self._timed(lambda: cursor.fetchmany(size)):
            yield rows

    def rows(self, sql: str, values: list = ()) -> list[tuple]:
        return self._timed(lambda: self.raw.execute(sql, values).fetchall())

    def close(self) -> None:
        self.raw.close()

    def __enter__(self) -> Reading:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def affinity(declared: str) -> str:
    """SQLite's rule for the affinity of a declared type."""
    d = declared.upper()
    for words, found in ((("INT",), "INTEGER"), (("CHAR", "CLOB", "TEXT"), "TEXT"), (("BLOB",), "BLOB"), (("REAL", "FLOA", "DOUB"), "REAL")):
        if any(w in d for w in words):
            return found
    return "NUMERIC" if d else "BLOB"


#: What a column is read as where the reader names no schema. Numeric columns may hold anything, so they come as text.
AS_READ = {"INTEGER": "bigint", "TEXT": "string", "BLOB": "binary", "REAL": "double", "NUMERIC": "string"}


def manifest(path: str) -> dict | None:
    at = os.path.join(path, MANIFEST)
    if not os.path.isdir(path) or not os.path.exists(at):
        return None
    with open(at, encoding="utf-8") as f:
        return json.load(f)


def shards(path: str) -> list[str]:
    """The files of a path: itself, those its manifest names, or all *.sqlite and *.db in it."""
    if os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        raise SqliteError(f"no file or folder at {path}")
    known = manifest(path)
    if known is not None:
        return [os.path.join(path, name) for name in known["shards"]]
    return sorted(glob.glob(os.path.join(glob.escape(path), "*.sqlite")) + glob.glob(os.path.join(glob.escape(path), "*.db")))


def columns(connection: Reading, table: str) -> list[tuple[str, str, bool, bool]]:
    """(name, declared type, nullable, primary key) of each column of a table or view."""
    return [(r[0], r[1] or "", not r[2], bool(r[3])) for r in connection.rows('SELECT name, type, "notnull", pk FROM pragma_table_info(?)', [table])]


def _literal(kind: str, declared: str, value: object) -> object:
    """A condition's value as the database stores it; SqliteError where the comparison would differ from Spark's."""
    if kind in _WHOLE and isinstance(value, int) and not isinstance(value, bool):
        return value
    if kind == "double" and isinstance(value, (int, float)) and math.isfinite(value) and affinity(declared) in ("REAL", "INTEGER"):
        return float(value)
    if kind == "string" and isinstance(value, str) and "\0" not in value:
        return value
    if kind == "date" and isinstance(value, str) and affinity(declared) == "TEXT":
        return datetime.date.fromisoformat(value).isoformat()
    raise SqliteError(f"{value!r} can't be compared with a {kind} in the database")


def _side(name: str, kind: str, declared: str) -> str:
    """The column as filters and the select list use it: text is compared by bytes, as Spark does."""
    if kind == "string":
        return f"{quoted(name)} COLLATE BINARY" if affinity(declared) == "TEXT" else f"CAST({quoted(name)} AS TEXT) COLLATE BINARY"
    return f"{quoted(name)} COLLATE BINARY" if kind == "date" else quoted(name)


COMPARED = ("=", "<>", "<", "<=", ">", ">=")


def condition(name: str, sign: str, value: object, kinds: dict[str, str], declared: dict[str, str]) -> tuple[str, list]:
    """A condition on a column as SQL and its values."""
    if name not in kinds:
        raise SqliteError(f"no column {name} in the schema that is read")
    kind, stored = kinds[name], declared.get(name, "")
    side = _side(name, kind, stored)
    if sign in ("is null", "is not null"):
        return f"{quoted(name)} {sign}", []
    if sign == "in" and isinstance(value, list) and len(value) <= MOST_VALUES:
        return f"{side} IN ({','.join('?' * len(value))})", [_literal(kind, stored, v) for v in value]
    if sign == "starts with" and kind == "string" and isinstance(value, str):
        return f"substr({side.removesuffix(' COLLATE BINARY')}, 1, {len(value)}) = ?", [_literal(kind, stored, value)]
    if sign in COMPARED:
        return f"{side} {sign} ?", [_literal(kind, stored, value)]
    raise SqliteError(f"no condition {sign!r} with {value!r}")


def _array(values: tuple, kind: str) -> pa.Array:
    """Values of a column in Arrow; those that don't fit its type are errors, never nulls."""
    if kind in _WHOLE:
        return pa.array(values, _WHOLE[kind])
    if kind == "boolean":
        if any(v not in (None, 0, 1) for v in values):
            raise ValueError("not 0 or 1")
        return pa.array([None if v is None else bool(v) for v in values], pa.bool_())
    if kind in ("double", "float"):
        if any(isinstance(v, (str, bytes)) for v in values):
            raise ValueError("not a number")
        return pa.array([None if v is None else float(v) for v in values], pa.float64() if kind == "double" else pa.float32())
    if kind == "string":
        return pa.array(values, pa.string())
    if kind == "binary":
        return pa.array([v.encode() if isinstance(v, str) else v for v in values], pa.binary())
    return pa.array(values, pa.string()).cast(pa.date32() if kind == "date" else pa.timestamp("us"))


def _row_id(declared: dict[str, str]) -> str | None:
    """A name of the row id that no column takes."""
    taken = {name.lower() for name in declared}
    return next((name for name in ("rowid", "oid", "_rowid_") if name not in taken), None)


@dataclass
class Range(D.InputPartition):
    path: str
    first: int | None
    last: int | None


class ShardReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.limit = local_path(options["path"]), options["table"], min(30_000, max(100, int(options.get("timeoutMs", 5_000))))
        self.rows_each = max(1, int(options.get("rowsPerPartition", 250_000)))
        self.kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if bad := sorted(set(self.kinds.values()) - set(DECLARED)):
            raise SqliteError(f"no SQLite form of {', '.join(bad)}")
        self.where = json.loads(options.get("where", "[]"))
        self.declared: dict[str, str] | None = None

    def _declared(self) -> dict[str, str]:
        if self.declared is None:
            self.declared = {}
            for path in shards(self.path)[:1]:
                with Reading(path, self.limit) as c:
                    self.declared = {name: kind for name, kind, *_ in columns(c, self.table)}
        return self.declared

    def partitions(self) -> list[Range]:
        """Ranges of row ids of each shard; a view or a table without row ids is one partition."""
        declared = self._declared()
        for name, sign, value in self.where:
            condition(name, sign, value, self.kinds, declared)
        row_id, out = _row_id(declared), []
        for path in shards(self.path):
            with Reading(path, self.limit) as c:
                plain = c.rows("SELECT 1 FROM pragma_table_list WHERE name = ? AND type = 'table' AND NOT wr", [self.table])
                if not plain or row_id is None:
                    out.append(Range(path, None, None))
                    continue
                low, high = c.rows(f"SELECT (SELECT min({row_id}) FROM {quoted(self.table)}), (SELECT max({row_id}) FROM {quoted(self.table)})")[0]
            if low is not None:
                out += [Range(path, at, min(at + self.rows_each - 1, high)) for at in range(low, high + 1, self.rows_each)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.path is None:
            return
        names, declared = list(self.kinds), self._declared()
        listed = ", ".join(f"CAST({quoted(n)} AS TEXT)" if self.kinds[n] == "string" and affinity(declared.get(n, "")) != "TEXT" else quoted(n) for n in names)
        where, values = [], []
        for name, sign, value in self.where:
            found = condition(name, sign, value, self.kinds, declared)
            where.append(found[0])
            values += found[1]
        if partition.first is not None:
            where.append(f"{_row_id(declared)} BETWEEN ? AND ?")
            values += [partition.first, partition.last]
        sql = f"SELECT {listed or '1'} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        with Reading(partition.path, self.limit) as c:
            for rows in c.batches(sql, values):
                arrays = []
                for name, column in zip(names, zip(*rows)):
                    try:
                        arrays.append(_array(column, self.kinds[name]))
                    except (ValueError, TypeError, AttributeError, OverflowError) as error:
                        raise SqliteError(f"column {name} of {self.table} holds a value that is no {self.kinds[name]}: {error}") from error
                yield pa.RecordBatch.from_arrays(arrays, names)


@dataclass
class Written(D.WriterCommitMessage):
    name: str
    rows: int


def _stored(column: pa.Array, kind: str) -> list:
    values = column.to_pylist()
    if kind in ("double", "float") and any(v is not None and math.isnan(v) for v in values):
        raise SqliteError("SQLite can't hold NaN")
    if kind in ("date", "timestamp_ntz"):
        return [None if v is None else v.isoformat(*([] if kind == "date" else [" "])) for v in values]
    return [int(v) if v is not None and kind == "boolean" else v for v in values]


class ShardWriter(D.DataSourceArrowWriter):
    """A shard for each task, built under a name of its own; ``commit`` replaces the manifest, by which the new shards begin to count all at once."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.table, self.overwrite = local_path(options["path"]), options["table"], overwrite
        self.kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if bad := sorted(set(self.kinds.values()) - set(DECLARED)):
            raise SqliteError(f"no SQLite form of {', '.join(bad)}")
        self.ddl = ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in self.kinds.items())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"part-{uuid.uuid4().hex}.sqlite"
        os.makedirs(self.path, exist_ok=True)
        at, n = os.path.join(self.path, name), 0
        connection = sqlite3.connect(at, isolation_level=None)
        try:
            connection.execute("PRAGMA journal_mode=OFF")  # a shard that isn't finished never counts
            connection.execute("PRAGMA synchronous=OFF")
            connection.execute(f"CREATE TABLE {quoted(self.table)} ({', '.join(f'{quoted(c)} {DECLARED[k]}' for c, k in self.kinds.items())})")
            connection.execute("BEGIN")
            into = f"INSERT INTO {quoted(self.table)} VALUES ({','.join('?' * len(self.kinds))})"
            for batch in iterator:
                connection.executemany(into, zip(*[_stored(batch.column(i), k) for i, k in enumerate(self.kinds.values())]))
                n += batch.num_rows
            connection.execute("COMMIT")
        except BaseException:
            connection.close()
            os.remove(at)
            raise
        connection.close()
        with open(at, "rb") as f:
            os.fsync(f.fileno())
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        before = manifest(self.path)
        if before and not self.overwrite and (before["table"], before["columns"]) != (self.table, self.ddl):
            self.abort(messages)
            raise SqliteError(f"{self.path} holds {before['table']} ({before['columns']})")
        kept = before["shards"] if before and not self.overwrite else []
        made = {"table": self.table, "columns": self.ddl, "shards": kept + [m.name for m in messages if m and m.rows]}
        draft = os.path.join(self.path, f"_draft-{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as f:
            json.dump(made, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, os.path.join(self.path, MANIFEST))
        gone = [m.name for m in messages if m and not m.rows] + (before["shards"] if before and self.overwrite else [])
        for name in gone:
            os.remove(os.path.join(self.path, name))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(os.path.join(self.path, m.name)):
                os.remove(os.path.join(self.path, m.name))


class SqliteShards(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        path, table = local_path(self.options["path"]), self.options["table"]
        known = manifest(path)
        if known is not None:
            if known["table"] != table:
                raise SqliteError(f"{path} holds {known['table']}, not {table}")
            return known["columns"]
        found = shards(path)
        if not found:
            raise SqliteError(f"no database in {path}")
        with Reading(found[0], 5_000) as c:
            listed = columns(c, table)
        if not listed:
            raise SqliteError(f"no table {table} in {found[0]}")
        return ", ".join(f"`{n.replace('`', '``')}` {AS_READ[affinity(kind)]}" for n, kind, *_ in listed)

    def reader(self, schema: T.StructType) -> ShardReader:
        return ShardReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options, schema, overwrite)


def _register(spark: SparkSession) -> None:
    try:
        spark.dataSource.register(SqliteShards)
    except AnalysisException as error:  # sessions of one application share what a session before them registered
        if error.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def read(spark: SparkSession, path: str, table: str, schema: str | T.StructType | None = None, where: list[tuple] = (), timeout_ms: int = 5_000, rows_per_partition: int = 250_000) -> DataFrame:
    """A table or view of a database, or of a folder of shards.

    ``schema`` names the columns to fetch and their types (else all, by what they are declared as). ``where`` holds conditions (column, sign, value) that all apply and
    run in the database, with Spark's meaning: the signs of ``COMPARED``, ``in`` (a list), ``starts with``, ``is null`` and ``is not null`` (value None), on columns of the
    schema that are whole numbers, doubles, text or dates (as date or ISO text). They belong to this call and its plan. (Spark 4.1 can hand a DataFrame's own filters to
    such a source, but keeps the last ones with the table: a second query on the same DataFrame then got the rows of the first one, so this source takes none.)
    ``timeout_ms`` (30,000 at most) bounds the time of a partition's statement in the database. A value that doesn't fit its column's type is an error, and so is text that
    is no UTF-8; an empty table has no partitions. Row ids with large gaps make empty partitions, for which ``rows_per_partition`` may be raised.
    """
    _register(spark)
    plain = [(name, sign, value.isoformat() if isinstance(value, datetime.date) else value) for name, sign, value in where]
    options = {"path": path, "table": table, "where": json.dumps(plain), "timeoutMs": timeout_ms, "rowsPerPartition": rows_per_partition}
    reader = spark.read.format(NAME).options(**options)
    return (reader.schema(schema) if schema else reader).load()


def write(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """``df`` as shards of ``table`` below ``path``, one for each of its partitions; ``mode`` is append or overwrite. One writer at a time.

    Dates and times are stored as ISO text. NaN and types without a SQLite form are errors that leave the folder as it was; nulls, empty tables and repeated rows are kept.
    """
    _register(df.sparkSession)
    df.write.format(NAME).mode(mode).option("path", path).option("table", table).save()


def tables(path: str, timeout_ms: int = 5_000) -> list[tuple[str, str, str, str, bool, bool]]:
    """(table, kind, column, declared type, nullable, primary key) of all tables and views of the first file at ``path``; reads the schema only."""
    out = []
    for at in shards(local_path(path))[:1]:
        with Reading(at, timeout_ms) as c:
            for name, kind in c.rows("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name"):
                out += [(name, kind, *column) for column in columns(c, name)]
    return out
