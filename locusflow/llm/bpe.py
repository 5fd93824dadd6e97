"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The driver reads the rank file; tasks build one encoder per worker.  A long text is cut before it is encoded, only
where every match of the pattern ends: in front of white space behind something else, or between classes that no
alternative of the pattern spans.  A long run of white space, on which the library's regex overflows its stack, is
by the pattern one match (less its last character if more text follows) and is merged as one piece.  Ids travel as
raw little-endian 32-bit integers, and decoding gives raw bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.shared import batches_with, documents, str_cells
from locusflow.runtime import map_arrow

#: A text is cut into stretches of about so many characters, and a run of so much white space is a piece of its own.
STRETCH = 1 << 20
WHITE_RUN = 4096

#: The characters with the Unicode property White_Space.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Where a match of the pattern always ends: before white space, and at an ASCII letter or digit that another ASCII class
#: follows, or a common letter of CJK texts that their punctuation follows.
_SAFE = regex.compile(
    rf"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[A-Za-z])(?=[!-@\[-`{{-~])|(?<=[0-9])(?=[!-/:-~])"
    r"|(?<=[ぁ-ゖァ-ヺ一-龥])(?=[、。！，？])"
)
_RUN = regex.compile(rf"[{WHITE}]{{{WHITE_RUN},}}")


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[str, bool]]:
    """The text in stretches that can be encoded apart, each with whether it is white space of one match."""
    at = 0
    for run in _RUN.finditer(text):
        yield from ((part, False) for part in _cut(text, at, run.start(), size))
        at = run.end() - (run.end() < len(text))
        yield text[run.start() : at], True
    yield from ((part, False) for part in _cut(text, at, len(text), size))


def _cut(text: str, at: int, end: int, size: int) -> Iterator[str]:
    while at < end:
        gap = _SAFE.search(text, at + size, end) if end - at > size else None
        stop = gap.start() if gap else end
        yield text[at:stop]
        at = stop


@lru_cache(2)
def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The library's encoder for the bytes of a rank file; a worker keeps those of two files."""
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def ids_of(text: str, coder: tiktoken.Encoding, size: int = STRETCH) -> np.ndarray:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    if len(text) <= min(size, WHITE_RUN):
        return np.array(coder.encode_ordinary(text), "<u4")
    parts = [np.array(coder._encode_single_piece(s) if white else coder.encode_ordinary(s), "<u4") for s, white in stretches(text, size)]
    return np.concatenate(parts) if parts else np.empty(0, "<u4")


def bytes_of(ids: bytes | None, coder: tiktoken.Encoding) -> bytes | None:
    """What raw ids decode to; null for null, for a rest of under four bytes and for an id without a token."""
    if ids is None or len(ids) % 4:
        return None
    try:
        return coder.decode_bytes(np.frombuffer(ids, "<u4").tolist())
    except KeyError:
        return None


def _ranks(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, size: int = STRETCH) -> DataFrame:
    """(doc_id, ids binary) of each row: the ids that tiktoken gives without special tokens, four bytes each.

    A null text counts as empty and has no ids.  Ids of documents may be null or repeat, each row is encoded for itself;
    an empty table gives an empty result, and other columns are not read.  The rank file is read by the driver alone and
    sent to the executors; its size is bounded by the vocabulary.
    """
    ranks = _ranks(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks.value, pattern)
        for batch in batches_with(batches):
            cells = [ids_of(text, coder, size).tobytes() if text else b"" for text in str_cells(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids binary) with ``decoded``: the raw bytes of the ids' tokens, which need not be UTF-8.

    Null ids, ids that no token has and cells that are no whole number of ids decode to null.
    """
    ranks = _ranks(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks.value, pattern)
        for batch in batches_with(batches):
            cells = [bytes_of(cell, coder) for cell in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], ["doc_id", "ids", "decoded"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def id_array(ids: Column) -> Column:
    """Raw ids as an array of integers, native."""
    n = F.floor(F.octet_length(ids) / 4).cast("int")
    at = lambda i, k: F.conv(F.hex(F.substring(ids, 4 * i + k + 1, 1)), 16, 10).cast("int") * F.lit(256**k)
    numbers = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i, 0) + at(i, 1) + at(i, 2) + at(i, 3))
    return F.when(n > 0, numbers).when(n == 0, F.array().cast("array<int>"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = decode(encode(documents(spark, sf_dir), path, pattern), path, pattern)
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
