import random
import re

from locusflow.llm import licenses as LI


def tokens(text):
    return [w for w in re.sub(r"[^\w]|_", " ", (text or "").lower()).split()]


def brute(rows):
    """Best containment of each license in the surroundings of any window."""
    best = {}
    for d, text in rows:
        t = tokens(text)
        for name, notice in LI.NOTICES:
            n = tokens(notice)
            k = min(5, len(n))
            own = {tuple(n[i : i + k]) for i in range(len(n) - k + 1)}
            there = [tuple(t[i : i + k]) for i in range(len(t) - k + 1)]
            step, length = max(1, (len(n) - k + 1) // 4), len(n) - k + 1
            c = max((len(own & set(there[max(0, i - step) : max(0, i - step) + length + 2 * step])) / len(own) for i in range(0, len(there), step)), default=0)
            if c >= 0.8:
                best[d, name] = max(c, best.get((d, name), 0))
    return best


def test_scan(spark, none):
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(50)] + ["the", "license", "under", "licensed", "version", "this", "work", "is"]
    rows = []
    for i, (_, notice) in enumerate(LI.NOTICES * 2):
        words = [r.choice(vocab) for _ in range(r.choice([0, 5, 40, 300]))]
        at = r.randrange(len(words) + 1)
        text = notice
        if i % 4 == 1:
            text = " ".join(w + "***" for w in notice.upper().split())
        if i % 4 == 2:
            text = " ".join(notice.split()[: len(notice.split()) // 2])
        if i % 4 == 3 and len(notice.split()) > 24:
            w = notice.split()
            w[-2] = "changed"
            text = " ".join(w)
        rows.append((i, " ".join(words[:at] + [text] + words[at:])))
    long = [n.split() for _, n in LI.NOTICES if len(n.split()) > 24]
    for i in range(120):
        w = list(r.choice(long))
        w[r.randrange(5, len(w) - 5)] = "changed"
        del w[: r.randrange(3)]
        rows.append((2000 + i, " ".join([*r.choices(vocab, k=r.choice([0, 3, 17, 60])), *w, *r.choices(vocab, k=r.choice([0, 9, 40]))])))
    rows += [(500, None), (501, ""), (502, "all rights"), (503, "All rights reserved"), (504, "x " * 8_000 + "Licensed under CC BY-NC 4.0."), (None, "All rights reserved."), (503, "All rights reserved")]
    got = LI.scan(spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, license string, size int"))
    found = {(x["doc_id"], x["license"]): x["containment"] for x in got.collect()}
    want = brute(rows)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert sum(0.8 <= c < 0.9 for c in want.values()) > 20
    assert all(found[k] >= 0.8 for k in found)
    assert LI.scan(none).count() == 0
