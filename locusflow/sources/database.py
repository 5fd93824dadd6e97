"""Tables of an SQLite file as source and sink, and batches for a server; a write counts as a whole or not at all."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import urllib.parse
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from locusflow.runtime import ship
from locusflow.sources.remote import attempt, request

#: Rows that a task or the commit holds at a time; seconds to wait for the file's lock.
ROWS, LOCK = 10_000, 60

#: The tables of a profile database.
TABLES = (
    "CREATE TABLE IF NOT EXISTS loci (id INTEGER PRIMARY KEY, name TEXT UNIQUE, annotation TEXT, custom_annotation TEXT)",
    "CREATE TABLE IF NOT EXISTS subschemas (subschema_id TEXT PRIMARY KEY, loci JSON)",
    "CREATE TABLE IF NOT EXISTS profiles (profile_id TEXT PRIMARY KEY, type TEXT, date TEXT, profile_json JSON, subschema_id TEXT REFERENCES subschemas (subschema_id))",
    "CREATE TABLE IF NOT EXISTS samples (id INTEGER PRIMARY KEY, name TEXT NOT NULL UNIQUE, date TEXT NOT NULL, profile_id TEXT NOT NULL REFERENCES profiles (profile_id))",
)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def local_path(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/")


def create_profile_database(path: str) -> None:
    """The tables of a profile database, where they are not yet."""
    with closing(sqlite3.connect(local_path(path), timeout=LOCK)) as db, db:
        for statement in TABLES:
            db.execute(statement)


def _columns(path: str, table: str) -> list[tuple[str, str]]:
    """(name, type of Spark) of a table's columns, by the declared types' affinity."""
    with closing(sqlite3.connect(f"file:{urllib.parse.quote(local_path(path))}?mode=ro", uri=True)) as db:
        found = db.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    if not found:
        raise ValueError(f"no table {table} in {path}")
    kind = lambda t: "long" if "INT" in t else "double" if any(x in t for x in ("REAL", "FLOA", "DOUB")) else "binary" if "BLOB" in t else "string"
    return [(name, kind(declared.upper())) for _, name, declared, *_ in found]


@dataclass
class RowIds(InputPartition):
    first: int
    last: int


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, splits: int):
        self.path, self.table, self.schema, self.splits = path, table, schema, splits

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{urllib.parse.quote(local_path(self.path))}?mode=ro", uri=True, timeout=LOCK)

    def partitions(self) -> list[RowIds]:
        with closing(self.connect()) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [RowIds(0, -1)]
        each = -(-(high - low + 1) // self.splits)
        return [RowIds(k, min(high, k + each - 1)) for k in range(low, high + 1, each)]

    def read(self, partition: RowIds) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.schema)
        names = ", ".join(quoted(n) for n in self.schema.fieldNames())
        with closing(self.connect()) as db:
            rows = db.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last))
            while some := rows.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kind, strict=True)], schema=kind)


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class SqliteWriter(DataSourceWriter):
    """Tasks write their rows beside the file; the commit takes them into it in one transaction, some rows at a time."""

    def __init__(self, path: str, table: str, schema: StructType, key: list[str], batch: str | None):
        self.path, self.table, self.names, self.key, self.batch = path, table, schema.fieldNames(), key, batch
        self.staging = f"{local_path(path)}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        Path(self.staging).mkdir(parents=True, exist_ok=True)
        path, n = f"{self.staging}/{uuid.uuid4().hex}", 0
        with open(path, "w", encoding="utf-8") as out:
            for row in iterator:
                out.write(json.dumps(list(row), ensure_ascii=False) + "\n")
                n += 1
        return Part(path, n)

    def statement(self) -> str:
        names, marks = ", ".join(map(quoted, self.names)), ", ".join("?" * len(self.names))
        rest = [n for n in self.names if n not in self.key]
        change = f"UPDATE SET {', '.join(f'{quoted(n)} = excluded.{quoted(n)}' for n in rest)}" if rest else "NOTHING"
        met = f" ON CONFLICT ({', '.join(map(quoted, self.key))}) DO {change}" if self.key else ""
        return f"INSERT INTO {quoted(self.table)} ({names}) VALUES ({marks}){met}"

    def commit(self, messages: list[Part]) -> None:
        with closing(sqlite3.connect(local_path(self.path), timeout=LOCK, isolation_level=None)) as db:
            db.execute("PRAGMA foreign_keys = ON")
            db.execute("BEGIN IMMEDIATE")
            try:
                if self._fresh(db):
                    for message in messages:
                        with open(message.path, encoding="utf-8") as rows:
                            db.executemany(self.statement(), map(json.loads, rows))
                db.execute("COMMIT")
            except BaseException:
                db.execute("ROLLBACK")
                raise
        self._clear()

    def _fresh(self, db: sqlite3.Connection) -> bool:
        """Whether the named batch is not in the file yet; it is noted in the same transaction."""
        if self.batch is None:
            return True
        db.execute("CREATE TABLE IF NOT EXISTS _batches (name TEXT, batch TEXT, PRIMARY KEY (name, batch))")
        return db.execute("INSERT OR IGNORE INTO _batches VALUES (?, ?)", (self.table, self.batch)).rowcount == 1

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        staging = Path(self.staging)
        for path in staging.glob("*") if staging.exists() else ():
            path.unlink(missing_ok=True)
        if staging.exists():
            staging.rmdir()


class SqliteTable(DataSource):
    """Format ``sqlite_table``: a table of an SQLite file that driver and executors reach by the same path.

    Options: path, table; to read, splits (ranges of row numbers, 16); to write, key (columns of a unique index, by commas:
    rows with a key that is there replace its values, else rows are added) and batch (a name: one that was written is
    passed over when it comes again).  Each row's values are numbers, texts or null.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in _columns(self.options["path"], self.options["table"]))

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("splits", "16")))

    def writer(self, schema: StructType, overwrite: bool) -> SqliteWriter:
        if overwrite:
            raise ValueError("sqlite_table takes mode append")
        return SqliteWriter(self.options["path"], self.options["table"], schema, [x for x in self.options.get("key", "").split(",") if x], self.options.get("batch"))


def read_sqlite(spark: SparkSession, path: str, table: str, splits: int = 16) -> DataFrame:
    ship(spark)
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").options(path=path, table=table, splits=splits).load()


def write_sqlite(rows: DataFrame, path: str, table: str, key: tuple[str, ...] = (), batch: str | None = None) -> None:
    """Add ``rows`` to a table, by ``key`` where given, in one transaction; a file of this kind has one writer at a time.

    Of rows with the same key, which one stays is not said: take them apart before.  A failed write leaves the file as it was.
    """
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(SqliteTable)
    options = {"path": path, "table": table, "key": ",".join(key)} | ({"batch": batch} if batch is not None else {})
    rows.write.format("sqlite_table").mode("append").options(**options).save()


def store_profiles(profiles: DataFrame, path: str, date: str, kind: str = "wgMLST") -> dict[str, int]:
    """Store (FILE, locus, cell) in a profile database: new loci, new profiles by their hash, samples with their profile.

    Returns the numbers of samples, of distinct profiles and of profiles that were new.
    """
    from pyspark.sql import functions as F

    from locusflow.operators import store
    from locusflow.runtime import Stage

    create_profile_database(path)
    spark = profiles.sparkSession
    done = Stage(spark).write(store.profile_json(profiles), "profiles")
    known = read_sqlite(spark, path, "profiles")
    fresh = Stage(spark).write(store.insert_new(known, done), "fresh")
    write_sqlite(profiles.select(F.col("locus").alias("name")).distinct(), path, "loci", ("name",))
    write_sqlite(fresh.select("profile_id", F.lit(kind).alias("type"), F.lit(date).alias("date"), F.col("profile").alias("profile_json")), path, "profiles", ("profile_id",))
    write_sqlite(done.select(F.col("FILE").alias("name"), F.lit(date).alias("date"), "profile_id"), path, "samples", ("name",))
    return {"samples": done.count(), "profiles": done.select("profile_id").distinct().count(), "inserted": fresh.count()}


@dataclass
class Sent(WriterCommitMessage):
    keys: list[str]
    rows: int


class BatchWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.url, self.names, self.write_id = options["url"].rstrip("/"), schema.fieldNames(), uuid.uuid4().hex
        self.rows, self.pause = int(options.get("rows", "1000")), float(options.get("pause", "0.5"))

    def post(self, what: str, body: object, key: str) -> None:
        headers = {"Content-Type": "application/json", "Idempotency-Key": key}
        data = json.dumps(body, ensure_ascii=False, sort_keys=True).encode()
        attempt(lambda: request(f"{self.url}/{what}", data, headers), pause=self.pause)

    def write(self, iterator: Iterator) -> Sent:
        keys, some, n, place = [], [], 0, uuid.uuid4().hex

        def send() -> None:
            key = hashlib.sha256(f"{place}:{len(keys)}".encode()).hexdigest()
            self.post("batches", {"write": self.write_id, "rows": some}, key)
            keys.append(key)

        for row in iterator:
            some.append(dict(zip(self.names, row, strict=True)))
            n += 1
            if len(some) == self.rows:
                send()
                some = []
        if some:
            send()
        return Sent(keys, n)

    def commit(self, messages: list[Sent]) -> None:
        self.post("commit", {"write": self.write_id, "batches": [k for m in messages for k in m.keys], "rows": sum(m.rows for m in messages)}, self.write_id)

    def abort(self, messages: list[Sent | None]) -> None:
        self.post("abort", {"write": self.write_id}, self.write_id)


class HttpBatches(DataSource):
    """Format ``http_batches``: rows are posted to ``url``/batches in batches that do not count until ``url``/commit names them.

    Every post has an Idempotency-Key, so that one whose answer was lost can be sent again.  Batches of tasks that failed or
    ran twice are not named by the commit.  Options: url, rows (of a batch), pause.
    """

    @classmethod
    def name(cls) -> str:
        return "http_batches"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options, schema)


def upload(rows: DataFrame, url: str, batch_rows: int = 1000, pause: float = 0.5) -> None:
    """Send ``rows`` to a server, as HttpBatches says."""
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(HttpBatches)
    rows.write.format("http_batches").mode("append").options(url=url, rows=batch_rows, pause=pause).save()
