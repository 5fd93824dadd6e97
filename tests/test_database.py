import json
import sqlite3
import threading
from contextlib import closing
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from locusflow import cli
from locusflow.sources import database


def rows_of(path, text="SELECT * FROM t ORDER BY 1"):
    with closing(sqlite3.connect(path)) as db:
        return db.execute(text).fetchall()


@pytest.fixture()
def table(tmp_path):
    path = str(tmp_path / "a b.db")
    with closing(sqlite3.connect(path)) as db, db:
        db.execute('CREATE TABLE t (k INTEGER PRIMARY KEY, "a,b" TEXT, x REAL)')
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, None if i % 7 == 0 else f"é{i}", i / 2) for i in range(-50, 400, 3)])
        db.execute("CREATE TABLE empty (k INTEGER)")
    return path


def test_scan(spark, table):
    got = database.read_sqlite(spark, table, "t", splits=5)
    assert got.dtypes == [("k", "bigint"), ("a,b", "string"), ("x", "double")]
    assert sorted(map(tuple, got.collect())) == rows_of(table) and got.rdd.getNumPartitions() == 5
    assert database.read_sqlite(spark, f"file:{table}", "empty").count() == 0
    with pytest.raises(Exception, match="no table"):
        database.read_sqlite(spark, table, "other").count()


def test_upsert_and_batches(spark, table):
    before = dict((r[0], r) for r in rows_of(table))
    new = spark.range(-50, 200).select(F.col("id").alias("k"), F.lit("new").alias("a,b"), F.lit(1.0).alias("x")).repartition(6)
    database.write_sqlite(new, table, "t", ("k",), batch="1")
    want = sorted((before | {k: (k, "new", 1.0) for k in range(-50, 200)}).values())
    assert rows_of(table) == want
    database.write_sqlite(new.withColumn("x", F.lit(9.0)), table, "t", ("k",), batch="1")
    assert rows_of(table) == want  # a batch that comes again is passed over
    database.write_sqlite(new.where("false"), table, "t", ("k",))
    database.write_sqlite(spark.createDataFrame([(None,), (5,)], "k long"), table, "empty")
    assert rows_of(table) == want and rows_of(table, "SELECT count(*), count(k) FROM empty") == [(2, 1)]


def failing(spark, mark, attempts):
    """250 rows of five tasks; the third fails in its last row, in as many attempts."""

    def run(batches):
        for batch in batches:
            yield batch
        if 120 in set(batch["k"]) and TaskContext.get().attemptNumber() < attempts:
            raise RuntimeError("lost")

    return spark.range(0, 250, 1, 5).select(F.col("id").alias("k"), F.lit(mark).alias("a,b"), F.lit(0.0).alias("x")).mapInPandas(run, "k long, `a,b` string, x double")


def test_failed_write_leaves_all_as_it_was(spark, table, tmp_path):
    before = rows_of(table)
    with pytest.raises(Exception, match="lost"):
        database.write_sqlite(failing(spark, "bad", 99), table, "t", ("k",), batch="2")
    assert rows_of(table) == before and [p.name for p in tmp_path.iterdir()] == ["a b.db"]
    # Rows that the table refuses, here a key that is there without an upsert, take back those before them too.
    with pytest.raises(Exception, match="UNIQUE|IntegrityError"):
        database.write_sqlite(spark.createDataFrame([(1000, "x", 0.0), (before[0][0], "y", 0.0)], "k long, `a,b` string, x double").coalesce(1), table, "t")
    assert rows_of(table) == before


def test_retried_task_counts_once(tmp_path):
    """Tasks are retried on a cluster; here the writer is run as the tasks of one would run it."""
    path = str(tmp_path / "p.db")
    with closing(sqlite3.connect(path)) as db, db:
        db.execute("CREATE TABLE t (k INTEGER)")
    from pyspark.sql.types import LongType, StructField, StructType

    writer = database.SqliteWriter(path, "t", StructType([StructField("k", LongType())]), [], None)

    def broken():
        yield (1,)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    writer.write(iter([(1,), (2,)]))  # its answer is lost: another attempt's message is the one that counts
    writer.commit([writer.write(iter([(1,), (2,)])), writer.write(iter([(3,)]))])
    assert rows_of(path) == [(1,), (2,), (3,)] and [p.name for p in tmp_path.iterdir()] == ["p.db"]


def test_profiles(spark, tmp_path):
    path = str(tmp_path / "profiles.db")
    cells = [(s, f"l{i}", c) for s, row in {"a": ["1", "INF-2", "LNF"], "b": ["1", "2", "PLNF"], "c": ["3", "2", "1"]}.items() for i, c in enumerate(row)]
    frame = spark.createDataFrame(cells, "FILE string, locus string, cell string")
    assert database.store_profiles(frame, path, "2020-01-01T00:00:00") == {"samples": 3, "profiles": 2, "inserted": 2}
    assert database.store_profiles(frame, path, "2021-01-01T00:00:00") == {"samples": 3, "profiles": 2, "inserted": 0}
    assert rows_of(path, "SELECT count(*), count(DISTINCT profile_id), min(date) FROM samples") == [(3, 2, "2021-01-01T00:00:00")]
    assert rows_of(path, "SELECT name FROM loci ORDER BY 1") == [("l0",), ("l1",), ("l2",)]
    stored = dict(rows_of(path, "SELECT s.name, json_extract(p.profile_json, '$.l1') FROM samples s JOIN profiles p USING (profile_id)"))
    assert stored == {"a": "2", "b": "2", "c": "2"}


class Intake(BaseHTTPRequestHandler):
    """Keeps batches by their key; loses the answer to each first post."""

    staged: dict = {}
    visible: list = []
    log: list = []

    def log_message(self, *args):
        pass

    def do_POST(self):
        body, key = json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.headers["Idempotency-Key"]
        first = (self.path, key) not in Intake.log
        Intake.log.append((self.path, key))
        if self.path == "/batches":
            Intake.staged[key] = body["rows"]
        elif self.path == "/commit" and first:
            Intake.visible += [r for k in body["batches"] for r in Intake.staged.pop(k)]
        if self.path == "/abort":
            Intake.staged.clear()
        if first:
            return self.close_connection
        self.send_response(200)
        self.send_header("Content-Length", "0")
        self.end_headers()


@pytest.fixture()
def intake():
    Intake.staged, Intake.visible, Intake.log = {}, [], []
    got = ThreadingHTTPServer(("127.0.0.1", 0), Intake)
    threading.Thread(target=got.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{got.server_port}"
    got.shutdown()
    got.server_close()


def test_upload(spark, intake):
    rows = spark.range(0, 95, 1, 4).select(F.col("id").alias("k"), F.lit("é").alias("s"))
    database.upload(rows, intake, 10, 0.01)
    assert sorted((r["k"], r["s"]) for r in Intake.visible) == [(k, "é") for k in range(95)] and not Intake.staged
    with pytest.raises(Exception, match="lost"):
        database.upload(failing(spark, "bad", 99), intake, 10, 0.01)
    assert len(Intake.visible) == 95 and not Intake.staged and Intake.log[-1][0] == "/abort"


def test_upload_from_command_line(intake, tmp_path):
    (tmp_path / "l1.fasta").write_text(">l1_1\nATGAAATAA\n>l1_2\nATGAAAAAATAA\n>l1_3\nATGA\n")
    assert cli.main(["LoadSchema", "-i", f"{tmp_path}/l1.fasta", "-o", f"{tmp_path}/out", "--url", intake]) == 0
    assert [(r["locus"], r["n"], [x["length"] for x in sorted(json.loads(r["lengths"]), key=lambda x: x["length"])]) for r in Intake.visible] == [("l1", 2, [9, 12])]
