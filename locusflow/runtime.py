"""Makes the package importable in Python workers, and keeps tables that cut the lineage on shared storage."""

from __future__ import annotations

import atexit
import contextlib
import importlib.util
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application; the driver serves the file."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(importlib.util.find_spec("locusflow").submodule_search_locations[0])
    handle, name = tempfile.mkstemp(prefix="locusflow-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, Path("locusflow") / path.relative_to(top))
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable, schema: object) -> DataFrame:
    """mapInArrow whose function may use this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def fold_sorted(df: DataFrame, by: str, order: list, start: Callable, schema: str) -> DataFrame:
    """What a fold over the rows of each ``by``, in the order of ``order``, gives: for folds that no window expresses.

    Spark sorts, spilling as it must, and the rows stream through: a task holds one key's state, never its rows.
    ``start()`` makes a state; its ``step(row)`` and ``end()`` give lists of tuples of ``schema``.
    """
    ship(df.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                if state is None or getattr(row, by) != key:
                    out += state.end() if state else []
                    state, key = start(), getattr(row, by)
                out += state.step(row)
            yield pd.DataFrame(out, columns=names, dtype=object)
        if state:
            yield pd.DataFrame(state.end(), columns=names, dtype=object)

    return df.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


#: Rows up to which a table is sent to every executor; a larger one is joined without a hint.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of any file system that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables when the driver's Python ends, if the session still can."""

    def run() -> None:
        with contextlib.suppress(Exception):
            delete(spark, path)

    atexit.register(run)


class Stage:
    """Tables on shared storage, written between steps that are read more than once; they cut the lineage."""

    def __init__(self, spark: SparkSession):
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = f"file://{tempfile.mkdtemp(prefix='locusflow-')}"
        self.spark, self.root = spark, f"{where.rstrip('/')}/{uuid.uuid4().hex}"
        delete_at_exit(spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            delete(self.spark, f"{self.root}/{name}")
