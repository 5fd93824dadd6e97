"""Token counts of a byte-level BPE by the whole-token shortcut.

Offline, every string of the vocabulary is merged by the merge list; those that end as one token are proved
whole.  A pre-token that is one of them counts as one directly; only the rest is merged, and each worker keeps
a bounded cache of the counts of merged pre-tokens.
"""

from __future__ import annotations

import contextlib
import heapq
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.shared import batches_with, documents, str_cells
from locusflow.runtime import map_arrow

LIMIT = 1024
CACHE = 800_000
LONG = 1 << 22

#: White space of the tokenizer's pattern, and the pattern.
_WHITE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        letters[b] = chr(b if b in plain else extra)
        extra += b not in plain
    return letters


@dataclass(frozen=True)
class Model:
    """What a byte-level BPE file says.  A piece is a byte's value or 256 plus the rank of the merge that made it.

    ``joins`` maps two pieces, as left << 20 | right, to the piece of their merge; ``whole`` are the texts proved to
    be one token; ``added`` are the strings cut out first.
    """

    joins: dict[int, int]
    whole: frozenset[str]
    added: tuple[str, ...]


_NONE = 1 << 60


def merged(pieces: list[int], joins: dict[int, int]) -> int:
    """Number of pieces after all merges: again and again the pair of the lowest rank, everywhere from the left."""
    find = joins.get
    while len(pieces) > 1:
        found = [find(a << 20 | b, _NONE) for a, b in zip(pieces, pieces[1:], strict=False)]
        best = min(found)
        if best == _NONE:
            break
        at = found.index(best)
        pieces[at : at + 2] = [best]
    return len(pieces)


def merged_long(pieces: list[int], joins: dict[int, int]) -> int:
    """As merged(), by a heap over linked neighbours: near-linear for pre-tokens of any length."""
    n = count = len(pieces)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(joins[k], i) for i in range(n - 1) if (k := pieces[i] << 20 | pieces[i + 1]) in joins]
    heapq.heapify(heap)
    while heap:
        to, i = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or joins.get(pieces[i] << 20 | pieces[j]) != to:
            continue
        pieces[i], alive[j], after[i] = to, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        count -= 1
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (k := pieces[a] << 20 | pieces[b]) in joins:
                heapq.heappush(heap, (joins[k], a))
    return count


def load(path: str) -> Model:
    """Read the file on the driver and prove the whole tokens; the size of all of it is bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"].get("byte_fallback") or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"not a plain byte-level BPE: {path}")
    back = {c: b for b, c in enumerate(byte_letters())}
    piece, joins = dict(back), {}
    for rank, m in enumerate(spec["model"]["merges"]):
        a, b = m.split(" ", 1) if isinstance(m, str) else m
        joins[piece[a] << 20 | piece[b]] = piece.setdefault(a + b, 256 + rank)
    whole = set()
    for string in spec["model"]["vocab"]:
        if all(c in back for c in string) and merged([back[c] for c in string], joins) == 1:
            with contextlib.suppress(UnicodeDecodeError):
                whole.add(bytes(back[c] for c in string).decode())
    return Model(joins, frozenset(whole), tuple(a["content"] for a in spec["added_tokens"]))


class Counter(dict):
    """Tokens of a pre-token; whole tokens from the start, others merged when first met."""

    def __init__(self, model: Model):
        super().__init__(dict.fromkeys(model.whole, 1))
        self.model, self.room = model, len(model.whole) + CACHE
        self.pattern = regex.compile(PRE_TOKEN)
        self.added = regex.compile("|".join(map(regex.escape, sorted(model.added, key=len, reverse=True)))) if model.added else None

    def __missing__(self, piece: str) -> int:
        raw = list(piece.encode())
        n = (merged if len(raw) < 40 else merged_long)(raw, self.model.joins)
        if len(self) < self.room and len(raw) <= 64:
            self[piece] = n
        return n

    def tokens(self, text: str) -> int:
        parts = self.added.split(text) if self.added and any(a in text for a in self.model.added) else (text,)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(part))) for part in parts)

    def pieces(self, text: str) -> Iterable[str]:
        """The pre-tokens; those of a very long text one by one."""
        return self.pattern.findall(text) if len(text) < LONG else (m.group() for m in self.pattern.finditer(text))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row.

    As the tokenizers library counts them without added begin or end tokens: strings of special tokens inside a text
    are single tokens.  A null text counts as empty: 0 and 0.  Ids may be null or repeat; other columns are not read.
    The file is read by the driver alone; executors get the merge list and the whole tokens.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model.value)
        for batch in batches_with(batches):
            texts = str_cells(batch.column(1))
            n = np.fromiter((counter.tokens(t) if t else 0 for t in texts), np.int64, len(texts))
            size = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
