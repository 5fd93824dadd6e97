import re
from collections import defaultdict

from locusflow.llm import decontaminate as D

ITEM = "A train leaves the old station at 9 km per hour and meets Anna Smith near the bridge after 3 hours of travel. How far did it go before the rain began?"
OTHER = "Der alte Mann geht langsam durch den kleinen Garten und zählt die roten Blumen am Zaun neben dem Haus."


def swap(text, table):
    return re.sub(r"\b(" + "|".join(table) + r")\b", lambda m: table[m.group()], text)


def brute_tokens(text):
    """Tokens as (type or '', value), read word by word."""
    out, number = [], lambda w: w[0].isdigit() or w.lower() in D.NUMBER_WORDS
    words = re.findall(r"[^\W\d_]+|\d+(?:[.,:]\d+)*", text)
    for i, w in enumerate(words):
        if re.fullmatch("[A-ZÄÖÜ][a-zäöüß]+", w):
            out.append(("name", w.lower()))
        elif number(w):
            out.append(("number", w.lower()))
        elif w.lower() in D.UNITS and i and number(words[i - 1]) and not re.fullmatch("[A-Z][a-z]+", words[i - 1]):
            out.append(("unit", w.lower()))
        else:
            out.append(("", w.lower()))
    return out


def windows(text, size=5):
    """(window, form, slots, swaps) of both forms: names as slots and names as words."""
    t = brute_tokens(text)
    plain = [("", v) if k == "name" else (k, v) for k, v in t]
    swaps = [size == 5 and 2 * sum(x[0] != "" for x in each) <= len(t) for each in (t, plain)]
    for i in range(len(t) - size + 1):
        forms = [(tuple(x if x[0] == "" else (x[0],) for x in w), tuple(x[1] for x in w if x[0])) for w in (t[i : i + size], plain[i : i + size])]
        for (h, s), ok in zip(forms, swaps, strict=True):
            yield forms[0][0], h, s, ok


def brute(docs, items):
    out = {}
    for d, text in docs:
        for i, q in items:
            n_tokens = len(brute_tokens(q or ""))
            size = min(5, n_tokens)
            if not size or (size < D.SHORTEST and len(brute_tokens(text or "")) != size):
                continue
            mine = defaultdict(set)
            for _, h, s, _ in windows(text or "", size):
                mine[h].add(s)
            own = set(windows(q, size))
            n = len({w for w, _, _, _ in own})
            found = len({w for w, h, s, ok in own if (h in mine if ok else s in mine.get(h, ()))})
            same = len({w for w, h, s, _ in own if s in mine.get(h, ())})
            to = defaultdict(set)
            for _, h, s, ok in own:
                for other in mine.get(h, ()):
                    for a, b in zip(s, other, strict=True):
                        if ok or s == other:
                            to[a].add(b)
            steady = all(len(v) == 1 for v in to.values())
            if same >= 0.8 * n or (found >= 0.8 * n and steady):
                out[d, i] = (n, found, same, same < 0.8 * n)
    return out


DOCS = [
    (1, "Intro words come first. " + ITEM + " And then some more text follows here."),
    (2, "Some noise. " + swap(ITEM, {"9": "12", "Anna": "Peter", "Smith": "Jones", "3": "7"})),
    (3, swap(ITEM, {"9": "12", "3": "7"}) + " filler. " + swap(ITEM, {"9": "15", "3": "8"})),
    (4, "Nothing to see here, only clean prose about 9 km and 3 hours."),
    (5, OTHER.upper()),
    (6, " | ".join(OTHER.split())),
    (7, " ".join(w + "***" for w in OTHER.split())),
    (8, " ".join(OTHER.split()[:9])),
    (9, None), (10, ""), (11, "yes no"), (12, "yes no maybe"), (13, "5 6 7 8 9 " * 200),
    (14, "And then it rained. How far did it go? " + swap(OTHER, {"Der": "Ein"})), (15, "we ask who was king and where"), (16, "I ask: who was queen"),
]
ITEMS = [(100, ITEM), (101, OTHER), (102, "Yes, no!"), (103, None), (104, ""), (105, "Who was King?")]


def frame(spark, rows, key):
    return spark.createDataFrame([(k, t, -1, "x") for k, t in rows], f"{key} long, text string, h int, slots string")


def test_against_brute_force(spark):
    got = D.contaminated(frame(spark, DOCS, "doc_id"), frame(spark, ITEMS, "item_id"), occurrences=False).collect()
    assert {(r[0], r[1]): tuple(r[2:]) for r in got} == brute(DOCS, ITEMS)
    assert {r[0] for r in got} >= {1, 2, 5, 6, 7, 11, 14, 15} and not {r[0] for r in got} & {4, 8, 9, 10, 12, 13, 16}


def test_clean(spark, docs, none):
    d, b = frame(spark, DOCS + [(None, ITEM)], "doc_id"), frame(spark, ITEMS, "item_id")
    kept = D.clean(d, b)
    assert kept.columns == d.columns and sorted(r[0] or 0 for r in kept.collect()) == [4, 8, 9, 10, 12, 13, 16]
    assert D.clean(none, b).count() == 0 and D.clean(d, b.where("false")).count() == d.count()
    twice = frame(spark, [(None, ITEM), (None, "A clean text without an id, which stays."), (None, ITEM)], "doc_id")
    assert [r["text"][:7] for r in D.clean(twice, b).collect()] == ["A clean"]


def test_names_at_the_start_of_sentences(spark):
    """A renamed question whose sentences all start with the name, number words, and items that are mostly slots."""
    item = "Tom buys two red apples at the market. Tom eats one of them on the way. Tom then gives twelve plums to his sister."
    title = "Who Was The First King Of All The Western Isles And Hills"
    docs = [
        (1, swap(item, {"Tom": "Anna", "two": "nineteen", "one": "sixty", "twelve": "thirteen"})),
        (2, "Intro here. " + swap(item, {"Tom": "Maria"}).lower()),
        (3, swap(item, {"Tom": "Anna"}).replace("Anna then", "Paul then").replace("Anna eats", "Carla eats") + " Unrelated text follows."),
        (4, "What Is The Last Tale Of Both The Eastern Moors And Lakes"),
        (5, "Intro: " + title.lower()),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(frame(spark, docs, "doc_id"), frame(spark, [(1, item), (2, title)], "item_id")).collect()}
    assert {(1, 1), (5, 2)} <= got and not {(4, 2), (3, 2), (2, 2)} & got


def test_each_occurrence_is_judged(spark):
    """Worksheets, a copy beside a stray window of its template, an item with one value in two slots, a copy with words put in."""
    once = swap(ITEM, {"9": "12", "3": "7"})
    longer = once.replace("near the bridge", "near the very old stone bridge")
    same = "Tom bought 3 red apples at the market and then his sister gave him 3 green pears to take home that evening."
    docs = [
        DOCS[2],
        (20, once + " Later the slow train leaves the old station at 30 km per hour again."),
        (21, "So it goes. " + same.replace("3 red", "4 red").replace("3 green", "8 green")),
        (22, longer + " filler. " + swap(longer, {"12": "15", "7": "8"})),
        (23, " ".join(once.split()[:15]) + " filler. " * 60 + " ".join(swap(ITEM, {"9": "15", "3": "8"}).split()[15:])),
        (24, "5 6 7 8 9 " * 20),
    ]
    d, b = frame(spark, docs, "doc_id"), frame(spark, [(100, ITEM), (101, same)], "item_id")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, b, occurrences=True).collect()}
    assert got == {(3, 100), (20, 100), (21, 101), (22, 100)} | {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, b, occurrences=False).collect()}
    assert not {r["doc_id"] for r in D.contaminated(d, b, occurrences=False).collect()} & {3, 20, 21, 22}
    assert {r[0] for r in D.clean(d, b).collect()} <= {23, 24}


def test_many_windows_are_joined_by_shuffle(spark, monkeypatch):
    d, b = frame(spark, DOCS, "doc_id"), frame(spark, ITEMS, "item_id")
    want = sorted(D.contaminated(d, b).collect())
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert sorted(D.contaminated(d, b).collect()) == want
    monkeypatch.setattr(D, "BROADCAST_HASHES", 0)
    assert sorted(D.contaminated(d, b).collect()) == want


def test_occurrences_lose_nothing(spark, none):
    d, b = frame(spark, DOCS, "doc_id"), frame(spark, ITEMS + [(None, ITEM)], "item_id")
    got = {(r[0], r[1]): tuple(r[2:]) for r in D.contaminated(d, b, occurrences=True).collect()}
    want = brute(DOCS, ITEMS)
    assert want.items() <= got.items() and {x for x in got if x[1] is not None} - set(want) == {(3, 100)} and (3, None) in got
    assert D.contaminated(none, b, occurrences=True).count() == 0


def test_clean_leaves_columns_of_any_name(spark):
    item = "the quick brown fox jumps over the lazy dog near the old mill"
    docs = spark.createDataFrame([(1, "before " + item + " after", "u1"), (2, "nothing of the kind is said in this text", "u2")], "doc_id long, text string, _key string")
    docs = docs.selectExpr("*", "_key as key", "_key as row")
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [tuple(r)[2:] for r in D.clean(docs, benchmark).collect()] == [("u2",) * 3]
