"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs, digits, schemes and cues of
identifiers.  From each anchor a local parser expands to the boundaries of an email, an address, a number, a URL
or a secret and validates it.  The base kinds are exactly the leftmost non-overlapping matches of their
patterns; spans of further kinds are added to them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.shared import batches_with, documents, str_cells
from locusflow.runtime import map_arrow

#: The base kinds in their order, and the further kinds after them.
BASE = ("email", "ip", "card", "phone")
MORE = ("url", "iban", "ssn", "account", "secret", "street")

#: Anchors by what they start.  Cues of identifiers stand in lower, upper and title case.
_SCHEMES = ("http://", "https://", "ftp://", "www.")
_CUES = {
    "account": ("account", "acct", "konto", "cuenta", "compte", "passport", "customer id", "user id"),
    "secret": ("token", "api key", "api_key", "apikey", "secret", "password", "passwd", "access key", "access_key"),
    "ssn": ("ssn", "social security"),
    "iban": ("iban",),
    "street": (" street", " avenue", " road", " lane", " boulevard", " drive"),
}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?:https?://|ftp://|www\.)[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?(?:/[^\s\"'<>|]*)?")
_IBAN = re.compile(r"[\s:=#\"']{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"[\s:=#\"']{0,4}(?:number|no\.?|is)?[\s:=#\"']{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_ACCOUNT = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|id))?[\s:=#\"']{1,4}([A-Z]{0,3}[0-9][0-9-]{4,22}[0-9])(?![0-9A-Za-z])", re.I)
_SECRET = re.compile(r"\s*(?:[:=]|is)\s*[\"']?([A-Za-z0-9_\-+/]{16,}={0,2})[\"']?")
_STREET = re.compile(r"([0-9]{1,5}(?: [A-Z][a-z]+){1,3})$")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in "@+0123456789":
        found.add_word(mark, (mark if mark in "@+" else "digit", 1))
    for scheme in _SCHEMES:
        for form in {scheme, scheme.upper(), scheme.title()}:
            found.add_word(form, ("url", len(form)))
    for kind, cues in _CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _card(text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _secret(text: str) -> bool:
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


def _run_start(text: str, at: int, floor: int) -> int:
    while at > floor and _LOCAL.match(text, at - 1):
        at -= 1
    return at


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: base kinds in their order by start, then the further kinds.

    A span of a further kind that overlaps a base span or an earlier further span is not added.
    """
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + MORE}
    past = {"email": 0, "ip": 0, "card": 0, "phone": 0, "url": 0}
    run_end = -1
    for last, (kind, size) in automaton().iter(text):
        at = last - size + 1
        if kind == "@":
            start = _run_start(text, at, past["email"]) if at >= past["email"] else at
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found["email"].append((start, m.end()))
                past["email"] = m.end()
        elif kind == "digit":
            if at >= past["card"] and (m := _CARD.match(text, at)):
                past["card"] = m.end()
                if _card(m.group()):
                    found["card"].append(m.span())
            if at >= past["ip"] and at > run_end:
                m = _IP.match(text, at)
                if m:
                    past["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                        found["ip"].append(m.span())
                else:
                    run_end = at
                    while run_end + 1 < len(text) and text[run_end + 1] in "0123456789":
                        run_end += 1
        elif kind == "+":
            if at >= past["phone"] and (m := _PHONE.match(text, at)):
                past["phone"] = m.end()
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif kind == "url":
            if at >= past["url"] and (m := _URL.match(text, at)):
                found["url"].append(m.span())
                past["url"] = m.end()
        elif kind == "street":
            m = _STREET.search(text[max(0, at - 60) : at])
            if m and not text[last + 1 : last + 2].isalpha():
                found["street"].append((max(0, at - 60) + m.start(), last + 1))
        else:
            shape, valid = {"iban": (_IBAN, _iban), "ssn": (_SSN, None), "account": (_ACCOUNT, None), "secret": (_SECRET, _secret)}[kind]
            m = shape.match(text, last + 1)
            if m and (valid is None or valid(m.group(1))):
                found[kind].append(m.span(1))
    base = [(k, a, b) for k in BASE for a, b in found[k]]
    more: list[tuple[str, int, int]] = []
    if any(found[k] for k in MORE):
        # Stretches taken so far, apart and in order: a span meets one only if it meets that around or after its start.
        starts, ends = _apart([(a, b) for _, a, b in base])
        for k in MORE:
            fresh = []
            for a, b in sorted(set(found[k])):
                at = bisect_right(ends, a)
                if (at == len(starts) or starts[at] >= b) and not (fresh and a < fresh[-1][1]):
                    more.append((k, a, b))
                    fresh.append((a, b))
            starts, ends = _apart([*zip(starts, ends, strict=True), *fresh])
    return base + more


def _apart(spans_: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans_):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at, open_end = [], 0, -1
    for a, b, k in sorted((a, b, k) for k, a, b in found):
        if a < open_end:
            if b > open_end:
                at = open_end = b
            continue
        out += [text[at:a], f"<{k.upper()}>"]
        at = open_end = b
    return "".join([*out, text[at:]])


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, digest of the base spans, all spans.

    A null text counts as empty: no spans.  Ids may be null or repeat; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            rows = [spans(t) for t in str_cells(batch.column(1))]
            counts = [pa.array([sum(s[0] == k for s in r) for r in rows], pa.int64()) for k in BASE]
            digests = [hashlib.sha256(joined([s for s in r if s[0] in BASE]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(r) for r in rows], pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, _SCHEMA)


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span masked in text and n_chars, where there is one, counted anew; null texts stay null."""
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            at = batch.schema.get_field_index("text")
            texts = [t and masked(t, spans(t)) for t in str_cells(batch.column(at))]
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    out = map_arrow(docs, run, schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(schema["n_chars"].dataType))
    return out.select(*columns)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
