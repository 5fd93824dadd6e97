import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusflow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d for i, c in enumerate(reversed(digits)) for d in divmod(int(c) * (1 + i % 2), 10)]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]


def base(text):
    return [s for s in pii.spans(text) if s[0] in pii.BASE]


PIECES = ["a", ".", "@", "x.y", "-", " ", "+", "1", "4", "12", "255", "256", "0", "(", ")", "4111111111111111", "b@c.de", "\n", "é", "www.", "token = ", "٣"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_base_is_the_patterns(pieces):
    text = "".join(pieces)
    assert base(text) == brute(text)


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ('x token = "2d480315a6562b81c25342984c4087344558d00e" y', "secret", "2d480315a6562b81c25342984c4087344558d00e"),
        ("see https://ex.org/a?b=1, ok", "url", "https://ex.org/a?b=1,"),
        ("IBAN: DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
        ("SSN 123-45-6789.", "ssn", "123-45-6789"),
        ("Account number: 99887766 is", "account", "99887766"),
        ("at 221 Baker Street today", "street", "221 Baker Street"),
    ],
)
def test_more(text, kind, found):
    assert [text[a:b] for k, a, b in pii.spans(text) if k == kind] == [found]


def test_clean_text_has_none():
    assert pii.spans("The account of the street was token and secret to all. Chapter 12, page 1,024.") == []
    assert pii.spans(None) == pii.spans("") == []


def test_masked():
    text = "mail a@b.co now, +1 (803) 555-5351; a@b.co"
    assert pii.masked(text, pii.spans(text)) == "mail <EMAIL> now, <PHONE>; <EMAIL>"
    assert pii.masked("abcdef", [("x", 1, 4), ("y", 2, 5)]) == "a<X>f"


def test_long():
    text = "9" * 300_000 + " " + "a." * 50_000 + "@"
    assert base(text) == [] and pii.spans("1." * 4000)[:1] == [("ip", 0, 7)]


def test_query(docs, none):
    got = {(r["doc_id"], r["spans"]) for r in pii.find_pii(docs).collect()}
    assert got == {(r["doc_id"], pii.joined(pii.spans(r["text"]))) for r in docs.collect()}
    out = pii.mask_pii(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and pii.mask_pii(none).count() == 0


def test_spans_of_many_lines_in_time():
    """Work grows with the spans, not with their square: a log with an address and a link in every line."""
    import time

    line = "visit https://example.org/a/{0} or write to user{0}@example.org today\n"
    text = "".join(line.format(i) for i in range(60_000))
    began = time.perf_counter()
    found = pii.spans(text)
    assert time.perf_counter() - began < 30
    assert sum(k == "email" for k, _, _ in found) == sum(k == "url" for k, _, _ in found) == 60_000


def test_further_spans_against_the_plain_rule():
    """The spans added are those that overlap nothing taken before, one after the other."""
    import random

    r = random.Random(3)
    bits = ["https://a.b/c", "me@x.org", "SSN: 123-45-6789", "12 Long Street", "account: 12345678", "password=hunter2Abc", "10.0.0.1", "+49 30 1234567", " ", "\n", "/", "."]
    for _ in range(300):
        text = "".join(r.choice(bits) for _ in range(r.randrange(25)))
        found = pii.spans(text)
        taken = [(a, b) for k, a, b in found if k in pii.BASE]
        for k, a, b in found:
            if k in pii.MORE:
                assert not any(a < y and x < b for x, y in taken), (text, k, a, b)
                taken.append((a, b))
