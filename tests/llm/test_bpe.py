import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from locusflow.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("size", [1, 5, 40])
def test_stretches_change_nothing(library, size):
    """Cut as often as can be, random texts have the ids of the library on the whole text, and their bytes."""
    r = random.Random(size)
    letters = [chr(c) for c in [*range(1, 256), *range(0x370, 0x400), *range(0x4E00, 0x4E10), 0x3001, 0x3002, 0xFF0C, 0x3000, *range(0x1FFF, 0x2030), 0x1680, 0x205F, 0x1F600, 0xFEFF, 0x301, 0x661]]
    letters += ["  ", "'s", " the", "word", "12", "\n\n", " 'll", "<|endoftext|>", "\x1c", "\u3002", "\u304b\u306a"] * 4
    for _ in range(600):
        text = "".join(r.choice(letters) for _ in range(r.randrange(80)))
        ids = np.concatenate([np.array(library.encode_ordinary(s), "<u4") for s, _ in bpe.stretches(text, size)] or [np.empty(0, "<u4")])
        assert "".join(s for s, _ in bpe.stretches(text, size)) == text
        assert ids.tolist() == library.encode_ordinary(text)
        assert bpe.bytes_of(ids.tobytes(), library) == text.encode()


@pytest.mark.parametrize("white", [" ", "\n", "\u3000", " \n\t"])
@pytest.mark.parametrize("ends", [("", ""), ("a", ""), ("", "b"), ("a", "b"), ("a.", "'s")])
def test_long_white_space(library, white, ends):
    text = ends[0] + white * (2 * bpe.WHITE_RUN // len(white)) + ends[1]
    assert bpe.ids_of(text, library).tolist() == library.encode_ordinary(text)


def test_white_space_beyond_the_regex(library):
    """A run on which the library fails is encoded, and decodes to itself."""
    text = "a" + " " * 1_500_000 + "b" + "xy" * 400_000 + "\n" * 5000
    assert bpe.bytes_of(bpe.ids_of(text, library).tobytes(), library) == text.encode()


@pytest.mark.parametrize("cell", [None, b"\x01", b"\xff\xff\xff\xff", np.array([50256], "<u4").tobytes()])
def test_ids_without_a_token(library, cell):
    assert bpe.bytes_of(cell, library) is None


def test_query_on_rows(spark, docs, none, library):
    rows = bpe.decode(bpe.encode(docs, PATH, PATTERN, size=50), PATH, PATTERN).select("*", bpe.id_array(bpe.F.col("ids")).alias("array")).collect()
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in rows))
    assert got == want
    assert all(r["array"] == library.encode_ordinary(bytes(r["decoded"]).decode()) for r in rows)
    assert bpe.encode(none, PATH, PATTERN).count() == 0
    clash = docs.limit(3).withColumn("ids", bpe.F.lit(1)).withColumn("decoded", bpe.F.lit(2))
    assert bpe.decode(bpe.encode(clash, PATH, PATTERN), PATH, PATTERN).count() == 3


def test_op13(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op13_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, raw = library.encode_ordinary(texts[r["doc_id"]]), texts[r["doc_id"]].encode()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
