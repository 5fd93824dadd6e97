import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""
    r = random.Random(11)
    vocab = ["the", "And", "über", "café,", "x", "###", "A&B", "42", "THE", "niño.", "won't"] + [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = [r.choice(vocab) for _ in range(r.choice([0, 1, 7, 8, 25, 60, 120]))]
        if i % 7 == 0 and len(words) > 20:
            words += words[3:19]
        if i % 11 == 0:
            words = [w.upper() + "!!" for w in words]
        if i % 13 == 0:
            words = [w for w in words for _ in range(3)]
        text = "".join(w + r.choice([" ", " ", "  ", "\n", "\t", "\r\n", "\x0b"]) for w in words)
        if i % 9 == 0:
            text += "\nsame line\nsame line\n \nsame line "
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", "src10", "Ä", None]), len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "src0", 0), (902, " \n ", "en", "tiny", 3), (None, "no id here", None, "src1", 10)]
    rows += [rows[3], rows[3], (5, "same id, other text", "en", "src0", 1), (950, "long " * 30_000 + "end", "en", "src1", 150_003)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
