"""Arrow functions where no built-in exists: other digests, and the integer-list codec kept for compatibility."""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import functions as F
from pyspark.sql import types as T


def digest_udf(kind: str):
    """Digest of binary values by any name of hashlib or zlib; checksums as unsigned decimals."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        if kind in ("crc32", "adler32"):
            return str(getattr(zlib, kind)(data) & 0xFFFFFFFF)
        return hashlib.new(kind, data).hexdigest()

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return run


def stream_digest(path: str, kind: str, block: int) -> tuple[int, str]:
    """(size, digest) of a file of any file system that Arrow knows, read in blocks."""
    local = path.startswith("file:")  # as it stands: Spark leaves blanks in paths as they are
    files, name = (LocalFileSystem(), "/" + path[5:].lstrip("/")) if local else FileSystem.from_uri(path)
    checksum = {"crc32": zlib.crc32, "adler32": zlib.adler32}.get(kind)
    size, total, state = 0, checksum(b"") if checksum else 0, None if checksum else hashlib.new(kind)
    with files.open_input_file(name) as source:
        while part := source.read(block):
            size += len(part)
            if checksum:
                total = checksum(part, total)
            else:
                state.update(part)
    return size, str(total) if checksum else state.hexdigest()


def encode_polyline(numbers: list[float], precision: int = 0) -> str:
    """A letter for the precision, then the differences of the numbers, scaled and rounded, sign folded into the lowest bit,
    in letters of five bits each, lowest first."""
    out, last = [chr(precision + 63)], 0
    for number in numbers:
        step, last = round((number - last) * 10**precision), number
        bits = ~(step << 1) if step < 0 else step << 1
        while True:
            bits, low = bits >> 5, bits & 31
            out.append(chr((low | 32 if bits else low) + 63))
            if not bits:
                break
    return "".join(out)


def decode_polyline(text: str) -> list[int | float]:
    """The numbers, to the precision that the first letter gives; none of an empty text."""
    out, total, bits, shift = [], 0, 0, 0
    precision = ord(text[0]) - 63 if text else 0
    for letter in text[1:]:
        value = ord(letter) - 63
        bits |= (value & 31) << shift
        shift += 5
        if not value & 32:
            total += ~(bits >> 1) if bits & 1 else bits >> 1
            out.append(round(total / 10**precision, precision) if precision else total)
            bits = shift = 0
    return out


@F.pandas_udf(T.StringType())
def polyline(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else encode_polyline(list(x)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def unpolyline(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else decode_polyline(x))
