import random

import numpy as np
import xxhash

from locusflow.llm import simhash as S


def brute(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def group(rows):
    """Smallest id per component of the fingerprints within the radius, by brute force."""
    fps = [brute(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d or -1, f"{fps[i]:016x}", least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def corpus(n=120):
    r = random.Random(5)
    vocab = [f"w{i}Ä" for i in range(400)] + ["The", "OF"]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.choice([3, 4, 5, 60, 200]))]
        rows.append((i, " ".join(words)))
        for c in range(r.choice([0, 0, 1, 6])):
            copy = list(words)
            if r.random() < 0.7:
                copy[r.randrange(len(copy))] = "changed"
            rows.append((1000 + 10 * i + c, "\n".join(copy)))
    return rows + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "x" * 5000), (None, "lone text"), (7, rows[7][1])]


def test_whole(spark):
    rows = corpus()
    docs = spark.createDataFrame([(t, d, "fp") for d, t in rows], "text string, doc_id long, fp string")
    got = S.near_duplicates(docs, tile=64).select("doc_id", S.hex_of().alias("f"), "component_id").collect()
    assert sorted((-1 if r[0] is None else r[0] or -1, r[1], -1 if r[2] is None else r[2]) for r in got) == group(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0
    assert S.keep_one(docs).count() == 0


def test_forest_joins_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:80] ^ (np.uint64(1) << rng.integers(0, 63, 80, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near, near[:40] ^ np.uint64(7)]))
    fps = fps[S._order(fps)]
    for a, b in ((fps, fps), (fps[:150], fps[150:])):
        u, v = S.link_forest(a, b, block=16)
        assert all(int(x ^ y).bit_count() for x, y in zip(u, v, strict=True))
        both = np.concatenate([a, b])
        forest = S._Forest(len(fps))
        at = {int(x): i for i, x in enumerate(fps)}
        forest.add(np.array([at[int(x)] for x in u], int), np.array([at[int(x)] for x in v], int))
        want = S._Forest(len(fps))
        i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 4)
        want.add(np.array([at[int(x)] for x in a[i]], int), np.array([at[int(x)] for x in b[j]], int))
        assert (forest.root == want.root).all() and len(both)


def test_keep_one(spark):
    """Rows without an id fall with their group; alone, one of them stays."""
    text, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(3, text, "x"), (2, text, "y"), (2, text, "y"), (9, "other words here now", None), (None, other, "z"), (None, other, "z"), (None, text, "z"), (None, None, "q"), (20, other.replace("b", "c"), "m"), (20, other.replace("b", "d"), "n"), (20, other.replace("b", "c"), "m"), (20, text, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = S.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r[0] or 0, r[2] or "") for r in got.collect()) == [(0, "q"), (0, "z"), (2, "y"), (9, ""), (20, "m"), (20, "n")]


def test_long_text():
    words = [str(i % 977) for i in range(200_000)]
    assert S.fingerprint(" ".join(words).encode()) == S.fingerprint("\n\n".join(words).encode())


def test_keep_one_leaves_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one two three four five", "u1"), (2, "one two three four five", "u2"), (3, "other words stand here now", "u3")], "doc_id long, text string, _key string")
    docs = docs.selectExpr("*", "_key as key", "_key as row", "_key as known", "_key as _row", "_key as _fp")
    got = S.keep_one(docs.unionAll(docs.where("doc_id = 3"))).collect()
    assert sorted(tuple(r)[2:] for r in got) == [("u1",) * 6, ("u3",) * 6]
