"""Removal of repeated byte strings of a fixed length, exactly, by per-shard suffix arrays.

Each window of ``length`` bytes has an anchor: the position of the least hash among the ``gram``-byte strings inside
it, the leftmost on ties.  Equal windows have equal anchors, so only windows whose anchor occurs twice can
repeat; consecutive windows with one anchor are a segment.  Hashes only route: of equal segments two go to the shard of
their anchor, where they stand for all, and of others one.  The shard's suffix array (Larsson and Sadakane's refinement
by doubling) and common prefixes (Kasai's rule, as far as the length matters) tell which windows repeat.  An anchor with
more kinds than a shard takes is dealt over several, whose windows are merged by binary search among their sorted
digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.shared import Scratch, batches_with, documents, utf8_cells
from locusflow.runtime import map_arrow

LENGTH = 200
GRAM = 56
#: Kinds of segments of one anchor that one shard takes, and about how many bytes make a shard.
KINDS = 4000
SHARD_BYTES = 3 << 19
#: Shards that one task works through, one after the other.
SHARDS_PER_TASK = 32

_BLOCK = 1 << 20
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The hash of the ``gram`` bytes from each position: of two halves' hashes, which overlap in the last round."""
    h = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)) * _MULT[0]
    size, level = 8, 1
    while True:
        h ^= h >> np.uint64(31)
        if size == gram:
            return h * _MULT[-1]
        step = min(size, gram - size)
        x = h[:-step] * _MULT[level % (len(_MULT) - 1)]
        x += h[step:]
        h, size, level = x, size + step, level + 1


def segments(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of each run of windows with one anchor, in order."""
    if len(text) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw, width = np.frombuffer(text, np.uint8), length - gram + 1
    hashes, firsts, n_windows, last = [], [], len(text) - length + 1, -1
    for at in range(0, n_windows, _BLOCK):
        part = raw[at : at + _BLOCK + length - 1]
        h = gram_hashes(part, gram)
        n = len(h) - width + 1
        keys = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        keys[: len(h)] = (h & ~np.uint64((1 << 22) - 1)) | np.arange(len(h), dtype=np.uint64)
        rows = keys.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 22) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[place[0] + at != last], place[1:] != place[:-1]]))
        hashes.append(h[place[first]])
        firsts.append(first + at)
        last = place[-1] + at
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.diff(np.append(first, n_windows))


def suffix_array(raw: np.ndarray, depth: int, room: np.ndarray | None = None) -> np.ndarray:
    """Positions in the order of the ``depth`` bytes that follow them; ``raw`` is padded with 2 * depth zeros.

    Ranks by the first few bytes; then each round doubles the depth and sorts anew only the positions whose rank is shared.
    ``room`` is how many bytes are looked at from each position: positions with less than ``depth`` are left out of the
    result, and out of each round that would look further.  Keys are sorted with the position in their low bits, in one word
    as far as they fit.
    """
    n = len(raw) - 2 * depth
    if not n:
        return np.zeros(0, np.int64)
    bits = np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    codes, used = np.zeros(256, np.uint64), np.flatnonzero(np.bincount(raw, minlength=256))
    codes[used] = np.arange(len(used), dtype=np.uint64)
    width = max(1, (len(used) - 1).bit_length())
    h = min(depth, (64 - int(bits)) // width)
    keys = np.arange(n, dtype=np.uint64)
    for begin in range(0, n, 1 << 14):  # small enough for the processor's cache
        part = keys[begin : begin + (1 << 14)]
        symbols, first = codes[raw[begin : begin + len(part) + h]], np.zeros(len(part), np.uint64)
        for k in range(h):
            first <<= np.uint64(width)
            first |= symbols[k : k + len(part)]
        part |= first << bits
    keys.sort()
    live = (keys & low).view(np.int64)
    keys >>= bits
    group = (_starts(keys) + 1).astype(np.uint64)
    rank = np.zeros(len(raw), np.uint32)
    rank[live] = group
    if room is not None:
        room = np.clip(room, 0, depth).astype(np.min_scalar_type(depth))
    while h < depth:
        step = min(h, depth - h)
        if room is not None:
            far = room[live] >= h + step
            live, group = live[far], group[far]
        fresh = np.ones(len(live) + 1, bool)
        np.not_equal(group[1:], group[:-1], out=fresh[1:-1])
        shared = ~(fresh[1:] & fresh[:-1])
        live, group = live[shared], group[shared]
        if not len(live):
            break
        keys = group << bits
        keys |= rank[live + step]
        if 3 * int(bits) <= 64:
            keys <<= bits
            keys |= live.view(np.uint64)
            keys.sort()
            live = (keys & low).view(np.int64)
            keys >>= bits
        else:
            by = np.argsort(keys, kind="stable")
            live, keys = live[by], keys[by]
        # A group's ranks begin at its old one, so that those of other groups stay as they are.
        group = keys >> bits
        more = _starts(keys) - _starts(group)
        group += more.astype(np.uint64)
        moved = np.flatnonzero(more)
        rank[live[moved]] = group[moved]
        h += step
    live = np.arange(n) if room is None else np.flatnonzero(room == depth)
    keys = rank[live].astype(np.uint64) << bits
    keys |= live.view(np.uint64)
    keys.sort()
    return (keys & low).view(np.int64)


def _starts(keys: np.ndarray) -> np.ndarray:
    """For each of the sorted keys, where the first equal one stands."""
    first = np.arange(len(keys), dtype=np.int32)
    first[1:] *= keys[1:] != keys[:-1]
    return np.maximum.accumulate(first, out=first)


def common_prefixes(raw: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, up to ``depth``, of each position of ``order`` with its predecessor there, by position.

    By Kasai's rule a position whose predecessor is one past that of the position before has one byte less in common
    (or again ``depth``, which is as far as is looked), if that one has any; only the others are compared, eight bytes at a
    time.
    """
    n = int(order.max()) + 1 if len(order) else 0
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    # A predecessor with another first byte (where one letter's suffixes end) tells nothing of the position behind.
    follows = np.concatenate([[False], (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (raw[: n - 1] == raw[before[:-1]])])[:n]
    lead = np.flatnonzero(~follows & (before >= 0))
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    far = depth + 8
    length = np.zeros(n, np.int64)
    live, at = lead, 0
    # A run of followers needs the lead's full length: look on until the run's end would be past ``depth`` as well.
    run = np.diff(np.append(np.flatnonzero(~follows), n))
    need = np.zeros(n, np.int64)
    need[np.flatnonzero(~follows)] = run + far
    while len(live):
        a, b = live + at, before[live] + at
        ok = (np.maximum(a, b) < len(words)) & (at < need[live])
        live, a, b = live[ok], a[ok], b[ok]
        x = words[a] ^ words[b]
        same = x == 0
        length[live[same]] = at + 8
        rest, bits = live[~same], x[~same]
        low = bits & (~bits + np.uint64(1))
        length[rest] = at + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
        live, at = live[same], at + 8
    lead_of = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.minimum(np.maximum(length[lead_of] - (np.arange(n) - lead_of), 0), depth)


def repeated_windows(contents: list[bytes], counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of each run of windows that occur anywhere else among the segments, in order."""
    text = b"".join(contents)
    raw = np.frombuffer(text + bytes(2 * length), np.uint8)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    first = np.cumsum(sizes) - sizes
    # Bytes from each position to its segment's end: windows are what has ``length`` of them.
    room = np.repeat(first + counts + (length - 1), sizes) - np.arange(len(text))
    order = suffix_array(raw, length, room)
    same = common_prefixes(raw, order, length)[order[1:]] >= length
    twin = np.zeros(len(text), bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    # One segment's runs do not touch the next one's: no window begins at its last ``length`` - 1 bytes.
    edges = np.flatnonzero(np.diff(twin.view(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    segment = np.searchsorted(first, start, "right") - 1
    return segment, start - first[segment], end - first[segment]


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _segment_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(a, s, key, p, n) of each segment: its anchor's hash, its own, document, first window and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            cols = [np.concatenate(a).view(np.int64), np.concatenate(s), np.concatenate(key), np.concatenate(p).astype(np.int32), np.concatenate(n).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "s", "key", "p", "n"])

        a, s, key, p, n, held = [], [], [], [], [], 0
        for batch in batches_with(batches, 256):
            for k, text in zip(batch.column(0).to_pylist(), utf8_cells(batch.column(1)), strict=True):
                if text is None or len(text) < length:
                    continue
                hashes, first, count = segments(text, length, gram)
                ends = first + count + length - 1
                view = memoryview(text)
                cut = zip(first.tolist(), ends.tolist(), strict=True)
                a.append(hashes)
                s.append(np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in cut), np.uint64, len(first)).view(np.int64))
                key.append(np.full(len(first), k, np.int64))
                p.append(first)
                n.append(count)
                held += len(first)
                if held > 50_000:
                    yield rows()
                    a, s, key, p, n, held = [], [], [], [], [], 0
        if a:
            yield rows()

    return map_arrow(docs.select("key", "text"), run, "a long, s long, key long, p int, n int")


def _contents(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (key, a, s, p, n, ones, shard, hot), one row of each kind of segment, with the segment's bytes."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("a", "s", "p", "n", "ones", "shard", "hot")).alias("segs"))
    names = ["key", "a", "s", "p", "n", "ones", "shard", "hot", "content"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches, 256):
            rows = []
            for key, text, segs in zip(batch.column(0).to_pylist(), utf8_cells(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                rows += [(key, *(x[name] for name in names[1:-1]), text[x["p"] : x["p"] + x["n"] + length - 1]) for x in segs]
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array([*c], t) for c, t in zip(cols, types, strict=True)], names)

    joined = docs.select("key", "text").join(lists, "key")
    return map_arrow(joined.select("key", "text", "segs"), run, "key long, a long, s long, p int, n int, ones boolean, shard long, hot boolean, content binary")


def _shard_results(contents: DataFrame, length: int, shards: int) -> DataFrame:
    """(key, start, end, a, s, digest, shard): repeated runs of segments that occur once; of kinds of segments, a and s, by
    their first byte; windows of hot anchors by digest, not yet judged."""

    names = ["key", "start", "end", "a", "s", "digest", "shard"]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())

    def judge(parts: list[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        key, a, s, p, n, ones, hot = (rows.column(c).to_numpy() for c in ("key", "a", "s", "p", "n", "ones", "hot"))
        contents = rows.column("content").to_pylist()
        # A kind that occurs again stands twice in the shard's text, so that its suffixes meet each other.
        twice = np.flatnonzero(~ones)
        which, start, end = repeated_windows(contents + [contents[i] for i in twice], np.concatenate([n, n[twice]]), length)
        own = which < len(contents)
        which, start, end = which[own], start[own], end[own]
        one, at = ones[which], np.where(ones, p, 0)[which]
        cols = [(key[which], ~one), (at + start, None), (at + end + length - 1, None), (a[which], one), (s[which], one)]
        arrays = [pa.array(c, t, mask=m) for (c, m), t in zip(cols, types, strict=False)]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(which), t) for t in types[5:])], names)
        out, votes = [], set()
        for i in np.flatnonzero(hot).tolist():
            view = memoryview(contents[i])
            digests = [xxhash.xxh3_128_digest(view[j : j + length]) for j in range(n[i])]
            if ones[i]:
                out += [(key[i], p[i] + j, p[i] + j + length, None, None, d, shard) for j, d in enumerate(digests)]
            else:
                votes.update(digests)
        out += [(None, None, None, None, None, d, shard) for d in votes]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([*c], t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, shard = [], None
        for batch in batches:
            numbers = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if numbers[x] != shard and parts:
                    yield from judge(parts, shard)
                    parts = []
                shard = int(numbers[x])
                parts.append(batch.slice(x, y - x))
        if parts:
            yield from judge(parts, shard)

    tasks = min(shards, max(4 * contents.sparkSession.sparkContext.defaultParallelism, -(-shards // SHARDS_PER_TASK)))
    dealt = contents.repartition(tasks, "shard").sortWithinPartitions("shard")
    return map_arrow(dealt, run, "key long, start int, end int, a long, s long, digest binary, shard long")


def _merged_hot(windows: DataFrame) -> DataFrame:
    """(key, start, end) of windows whose digest another shard has as well.

    Each shard's run of distinct digests is merged with the others': a partition sorts the digests dealt to it, at most
    one of each shard, and finds by binary search how many shards have one.  What is found is joined back to the windows,
    so that a digest with any number of windows is split like every skewed join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0) for b in batches if b.num_rows]
        if not parts:
            return
        runs = np.sort(np.frombuffer(b"".join(d for part in parts for d in part.to_pylist()), "S16").view("V16"))
        at = np.arange(len(runs))
        first, last = np.searchsorted(runs, runs, "left"), np.searchsorted(runs, runs, "right")
        yield pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in runs[(first == at) & (last - first > 1)]], pa.binary())], ["digest"])

    spark = windows.sparkSession
    pairs = windows.select("digest", "shard").distinct()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), windows.count() // 500_000)
    shared = map_arrow(pairs.repartition(n, "digest").select("digest"), run, "digest binary")
    return windows.where("start is not null").join(shared, "digest").select("key", "start", "end")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of the row: doc_id, or a hash of id and text where ids repeat or are null (equal rows then share it)."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").limit(1)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.withColumn("key", F.xxhash64("doc_id", "text") if ids.count() else F.col("doc_id"))


def repeated_spans(keyed: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, kinds: int = KINDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, start, end) covering exactly the bytes in windows that occur at least twice; spans may overlap."""
    every = scratch.write(_segment_rows(keyed, length, gram), "segments")
    twice = scratch.write(every.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"), "twice")
    met = scratch.write(every.join(twice, "a", "left_semi"), "met")
    scratch.drop("segments", "twice")
    classes = scratch.write(met.groupBy("a", "s").agg(F.count("*").alias("c"), F.min(F.struct("key", "p", "n")).alias("rep")), "classes")
    kinds_of = scratch.write(classes.groupBy("a").agg(F.count("*").alias("nd")), "kinds")
    total = classes.agg(F.sum((F.col("rep.n") + (length - 1)) * F.least("c", F.lit(2)))).first()[0] or 0
    shards = max(keyed.sparkSession.sparkContext.defaultParallelism, -(-total // shard_bytes))
    salt = F.pmod(F.xxhash64("s"), F.ceil(F.col("nd") / kinds))
    shard = F.pmod(F.xxhash64("a", salt), F.lit(shards)).alias("shard")
    wanted = classes.join(kinds_of, "a").select("rep.key", "a", "s", "rep.p", "rep.n", (F.col("c") == 1).alias("ones"), shard, (F.col("nd") > kinds).alias("hot"))
    judged = scratch.write(_shard_results(_contents(keyed, wanted, length), length, int(shards)), "judged")
    alike = judged.where("s is not null").select("a", "s", "start", "end")
    whole = met.join(alike, ["a", "s"]).select("key", (F.col("p") + F.col("start")).alias("start"), (F.col("p") + F.col("end")).alias("end"))
    parts = judged.where("digest is null and s is null").select("key", "start", "end")
    hot = judged.where("digest is not null")
    return whole.unionAll(parts).unionAll(_merged_hot(hot)) if hot.limit(1).count() else whole.unionAll(parts)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kinds: int = KINDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row: what is left without repeated strings.

    A byte goes if it lies in a ``length``-byte string that also starts anywhere else, in the same text or another; matches
    do not cross texts and are judged on the input.  A null text counts as empty.  Rows with equal ids are rows of their
    own: repeated rows repeat each other's text.  Texts shorter than ``length`` stay whole.  Only doc_id and text are read.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, scratch, length, gram, kinds, shard_bytes)
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches, 256):
            out = []
            starts = batch.column(2)
            for text, found in zip(utf8_cells(batch.column(1)), starts.to_pylist(), strict=True):
                text = text or b""
                kept, n = text, 0
                if found:
                    marks = np.zeros(len(text) + 1, np.int32)
                    np.add.at(marks, [x["start"] for x in found], 1)
                    np.add.at(marks, [x["end"] for x in found], -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    n = len(_runs(gone))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            cols = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([*c], t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = keyed.join(lists, "key", "left").select("doc_id", "text", "spans")
    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
