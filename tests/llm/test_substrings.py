import hashlib
import random
from collections import Counter

import numpy as np

from locusflow.llm import substrings as S


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(6)]
    out = []
    for i in range(70):
        parts = [text(r.choice([0, 5, 60]))]
        for _ in range(r.choice([0, 1, 2])):
            p = r.choice(shared)
            cut = r.randrange(len(p) // 2)
            parts += [p[cut:] if r.random() < 0.5 else p, text(r.choice([0, 1, 30]))]
        out.append(" ".join(parts))
    for i in range(20):
        near = list(out[3] + text(40))
        near[r.randrange(len(near))] = "X"
        out.append("".join(near))
    return out + ["z" * 700, "ab" * 300, out[5], out[5], "", None, "short", text(20) * 3, "\x00" * 500]


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, key long")
    got = S.remove_repeats(docs, **more).collect()
    want = brute([(t or "").encode() for _, t in rows], more.get("length", 200))
    key = lambda x: (-1 if x[0] is None else x[0], *x[1:5])
    assert sorted(map(key, got)) == sorted(map(key, [(i, *w) for (i, _), w in zip(rows, want, strict=True)]))


def test_whole(spark):
    run(spark, list(enumerate(corpus())))


def test_repeated_and_null_ids(spark):
    texts = corpus(2)[:40]
    rows = [(i % 9 if i % 4 else None, t) for i, t in enumerate(texts)] + [(77, texts[1]), (77, texts[1])]
    run(spark, rows, length=120, gram=24)


def test_hot_anchors_over_shards(spark):
    r = random.Random(9)
    common = "".join(r.choice("abcdef ") for _ in range(70))
    texts = ["".join(r.choice("ab") for _ in range(r.choice([20, 90]))) + common + "".join(r.choice("ab") for _ in range(60)) for _ in range(60)]
    texts += [t[5:] for t in texts[:15]]
    run(spark, list(enumerate(texts)), length=80, gram=24, kinds=3, shard_bytes=2000)


def test_empty(spark, none):
    assert S.remove_repeats(none).count() == 0


def test_suffix_array_and_prefixes():
    r = random.Random(4)
    for alphabet in (b"ab", b"a", bytes(range(256))):
        text = bytes(r.choice(alphabet) for _ in range(400)) * 2
        raw = np.concatenate([np.frombuffer(text, np.uint8), np.zeros(512, np.uint8)])
        order = S.suffix_array(raw, 256)
        padded = raw.tobytes()
        keys = [padded[i : i + 256] for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(len(text)))
        prefix = S.common_prefixes(raw, order, 200)
        for i, j in zip(order[:-1], order[1:], strict=True):
            same = next((k for k in range(200) if padded[i + k : i + k + 1] != padded[j + k : j + k + 1] or max(i, j) + k >= len(padded)), 200)
            assert prefix[j] == same, (i, j)


def test_blocks():
    text = bytes(random.Random(1).choices(b"abcd", k=5000))
    whole = S.segments(text)
    old, S._BLOCK = S._BLOCK, 700
    try:
        assert all(np.array_equal(a, b) for a, b in zip(whole, S.segments(text), strict=True))
    finally:
        S._BLOCK = old


def test_predecessor_with_another_first_byte():
    # The last suffix of "a" and the first of "b" are neighbours and have nothing in common; what follows them has.
    shared = bytes(random.Random(1).choices(b"cdefgh", k=300))
    segment, start, end = S.repeated_windows([b"a" + shared, b"b" + shared], np.array([102, 102]))
    assert list(zip(segment.tolist(), start.tolist(), end.tolist(), strict=True)) == [(0, 1, 102), (1, 1, 102)]


def test_suffixes_of_segments_as_far_as_they_reach():
    r = random.Random(5)
    for alphabet in (b"ab", b"\x00a", bytes(range(256))):
        common = [bytes(r.choices(alphabet, k=90)) for _ in range(4)]
        contents = [bytes(r.choices(alphabet, k=r.randrange(40))) + r.choice(common)[r.randrange(20) :] for _ in range(60)]
        counts = np.array([len(c) - 49 for c in contents])
        whole, room = b"".join(contents), np.concatenate([np.arange(len(c), 0, -1) for c in contents])
        order = S.suffix_array(np.frombuffer(whole + bytes(100), np.uint8), 50, room)
        keys = [whole[i : i + 50] for i in order]
        assert keys == sorted(keys) and sorted(order) == np.flatnonzero(room >= 50).tolist()
        seen = Counter(keys)
        found = {(i, j) for i, x, y in zip(*S.repeated_windows(contents, counts, 50), strict=True) for j in range(x, y)}
        assert found == {(i, j) for i, c in enumerate(contents) for j in range(len(c) - 49) if seen[c[j : j + 50]] > 1}


def test_ranks_too_wide_for_one_word():
    contents = [bytes(random.Random(6).choices(b"abcd", k=1_200_000))] * 2
    segment, start, end = S.repeated_windows(contents, np.array([1_199_801] * 2))
    assert list(zip(segment.tolist(), start.tolist(), end.tolist(), strict=True)) == [(0, 0, 1_199_801), (1, 0, 1_199_801)]


def test_texts_with_another_first_letter(spark):
    shared = "".join(random.Random(1).choices("cdefgh", k=300))
    run(spark, [(0, "a" + shared), (1, "b" + shared)])
