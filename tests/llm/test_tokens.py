import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from locusflow.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.load(PATH))


@pytest.mark.parametrize("text", ["", " ", "a\n\n\n b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "it's WE'LL", "é" * 700, "1" * 999, " " * 999, "\x1c\x85​　 x"])
def test_cases(library, counter, text):
    assert counter.tokens(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_random(library, counter):
    r = random.Random(4)
    letters = [chr(c) for c in [*range(1, 600), *range(0x370, 0x400), *range(0x4E00, 0x4E40), 0x1F600, 0xFEFF, 0x301]] + ["  ", "'s", " the", "<|endoftext|>"]
    for _ in range(800):
        text = "".join(r.choice(letters) for _ in range(r.randrange(60)))
        assert counter.tokens(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_whole_tokens_are_proved(library, counter):
    assert len(counter.model.whole) > 49_000
    for s in random.Random(1).sample(sorted(counter.model.whole), 500):
        assert len(tokens.regex.findall(tokens.PRE_TOKEN, s)) != 1 or len(library.encode(s, add_special_tokens=False).ids) == 1


def test_query(docs, none, library):
    got = tokens.count_tokens(docs, PATH).toPandas()
    texts = [r["text"] or "" for r in docs.collect()]
    want = sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert sorted(zip(got.n_bytes, got.n_tokens, strict=True)) == want
    assert (got.over_limit == (got.n_tokens > 1024)).all()
    assert tokens.count_tokens(none, PATH).count() == 0
