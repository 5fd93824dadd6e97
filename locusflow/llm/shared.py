"""What the operators share: shared-storage scratch tables, word rules, Arrow access to text."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.runtime import delete, delete_at_exit

#: The separators of words, as a Java character class and as the SQL text of a regex.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only for a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="locusflow-")
    return f"file://{_LOCAL[app]}"


class Scratch:
    """Intermediate tables on shared storage.  A table cuts the lineage: a lost executor costs a reread."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        delete_at_exit(spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, to keep the disk's peak low."""
        for name in names:
            delete(self.spark, f"{self.root}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a table of fewer files than there are cores is dealt anew.
SPREAD_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over all cores: a small table of few files would be read by as few tasks.

    Only small tables are dealt anew, so that it costs one small shuffle; large ones come in files and parts enough.
    """
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    if len(docs.inputFiles()) >= cores or docs.limit(SPREAD_ROWS + 1).count() > SPREAD_ROWS:
        return docs
    return docs.repartition(2 * cores)


def words_of(text: Column) -> Column:
    """The words of a text, native; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != F.lit(""))


def residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def row_key() -> Column:
    """doc_id, or for a row without one a hash of its text, above 2**62: rows without an id and with equal texts share it."""
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62)))


def whole_row(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns of ``df`` as one struct, so that an operator's own columns beside it clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in without])


def utf8_cells(column: pa.Array) -> list[bytes | None]:
    """The cells of a string column as UTF-8, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def str_cells(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(text: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``size`` bytes each, so that a very long text is never held as words."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > size and (gap := _BREAK.search(text, at + size)):
            end = gap.start()
        yield text[at:end].split()
        at = end


def batches_with(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that what Python holds of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
