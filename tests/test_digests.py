import hashlib
import tracemalloc
import zlib

from locusflow.functions.codecs import stream_digest
from locusflow.sources import fasta


def test_file_hashes(spark, tmp_path):
    """Names with blanks and files of many blocks, by every kind of digest; empty files are not listed."""
    contents = {"empty.fa": b"", "one name.fa": b">a\nACGT\n", "long.fa": b">b\n" + b"ACGT" * 100_000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    for kind in ("blake2b", "sha256", "md5", "crc32", "adler32"):
        got = {r["path"].rsplit("/", 1)[1]: (r["size"], r["digest"]) for r in fasta.file_hashes(spark, str(tmp_path), kind).collect()}
        plain = lambda d: str(getattr(zlib, kind)(d)) if kind in ("crc32", "adler32") else hashlib.new(kind, d).hexdigest()  # noqa: B023, E731
        assert got == {name: (len(data), plain(data)) for name, data in contents.items() if data}


def test_a_huge_file_is_never_held(tmp_path):
    """A sparse file of 3 GB in blocks: more than a cell can have."""
    path, size = tmp_path / "huge.fa", 3 << 30
    with open(path, "wb") as f:
        f.truncate(size)
    tracemalloc.start()
    n, digest = stream_digest(f"file:{path}", "crc32", 1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = 0
    for _ in range(3 << 10):
        want = zlib.crc32(bytes(1 << 20), want)
    assert (n, digest) == (size, str(want)) and peak < 16 << 20
