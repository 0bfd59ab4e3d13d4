"""Removal of long repeated byte strings, marked by run-compressed Burrows-Wheeler indexes of bounded size.

Every byte that a string of `least` bytes covers is removed if that string also starts anywhere else, in another
document, in a repeated row or in the same document, overlaps included. Strings are judged on the input.

1. A window of `least` bytes selects the leftmost of its GRAM-byte strings of least hash, its anchor, by its content alone.
   Window starts with one anchor form an interval; the bytes their windows cover are the anchor's context. Equal windows
   have equal anchors at equal places, so a string can repeat only among contexts of one anchor string.
2. Equal contexts are folded to one with a count before anything else is shuffled; anchors that occur once go.
3. Contexts are dealt by anchor to buckets of about BUCKET_BYTES. A bucket's contexts form one text whose suffixes are sorted by
   doubling. Its Burrows-Wheeler transform is kept as runs with the text places (samples) of each run's first and last row. Two rows that meet
   at a border of runs are compared once; inside a run the match of a place is that of the place before it, less
   one byte. So one stream over the text gives each place's longest match elsewhere from the samples alone, and
   matches of `least` bytes or more are marked. A context that stands for several copies is repeated as a whole; if it is the only
   one of its anchor, nothing is left to compare.
4. An anchor with more than HOT different contexts (a line that a third of all documents hold) would make an unbounded
   bucket. Its contexts are cut again: each of their windows selects another anchor by another hash, and windows of one
   first and second anchor form smaller contexts, which are folded, counted and dealt in the same way. Most windows around a short
   common line select an anchor outside it and leave. What is still common after LEVELS cuts goes by
   windows, each as its own hash of 128 bits, counted over all contexts.
5. Marks return to all places of a context, and each document is cut.

Anchors, contexts and marks are narrow rows that combine before a shuffle; joins on them have one large side that adaptive
execution can split, and no broadcast. No bucket, document list or mark list grows with the table.

Why no match is lost: let the window at p repeat and let s <= p be the first place of its context for which the string from
s to the window's end occurs elsewhere. Rows that start with that string are neighbours, and all but s have another
byte before them (or s begins a context, where every border is sampled). So s lies at a border of runs, and its sample reaches the end of the window.

Defined cases: a null or empty text has no bytes and nothing removed; texts shorter than `least` stay whole; rows that
repeat are repeats of each other, whatever their doc_id, null included; a cut may split a character, so what stays is binary; an empty
table gives no rows; texts of any length are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import groups_for, stored

GRAM = 32
HOT = 1024
LEVELS = 2
BUCKET_BYTES = 1 << 19
SLICE_BYTES = 1 << 18
#: Symbols of nine bits that the first order of suffixes looks at.
PACKED = 4

_draw = np.random.Generator(np.random.PCG64(11))
BYTE = _draw.integers(0, 1 << 64, (LEVELS + 2, 256), np.uint64)
ODD = _draw.integers(0, 1 << 63, (LEVELS + 2, 40), np.uint64) * np.uint64(2) + np.uint64(1)


def string_hashes(raw: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place on, by doubling; equal strings hash alike."""
    part, width, total, taken = BYTE[seed][raw], 1, None, 0
    for k in range(size.bit_length()):
        if size >> k & 1:
            n = len(raw) - taken - width + 1
            total = part[taken : taken + n] if total is None else total[:n] * ODD[seed, 20 + k] + part[taken : taken + n]
            total = total ^ (total >> np.uint64(31))
            taken += width
        if size >> (k + 1):
            part = part[: len(part) - width] * ODD[seed, k] + part[width:]
            part ^= part >> np.uint64(29)
            width *= 2
    return total * ODD[seed, 39]


def anchors(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """text, first and last window start (places in raw) and anchor hash of each interval; texts lie in raw at starts."""
    hashes = string_hashes(raw, GRAM, seed)
    key = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)  # of equal ones the leftmost
    width, grams = 1, least - GRAM + 1
    while width * 2 <= grams:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if width < grams:
        key = np.minimum(key[: len(key) - (grams - width)], key[grams - width :])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    windows = np.maximum(sizes - least + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    place = np.arange(len(text)) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    own = at[place]
    head = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])))[: len(own)])
    last = np.append(head[1:], len(own))[: len(head)] - 1
    return text[head], place[head], place[last], hashes[own[head]].view(np.int64)


def sliced(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Lists of whole texts of about SLICE_BYTES together; a longer text stands alone."""
    held, room = [], SLICE_BYTES
    for t in texts:
        held.append(t)
        room -= len(t) + 64
        if room <= 0:
            yield held
            held, room = [], SLICE_BYTES
    if held:
        yield held


def row_key(docs: DataFrame) -> Column:
    """Names a row by its id and text; rows that repeat share it."""
    return F.unhex(F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("-")), F.lit(":"), F.coalesce(docs["text"], F.lit(""))).cast("binary")))


def anchored(docs: DataFrame, least: int) -> DataFrame:
    """(rid, start, n, key, ctx): the contexts of every text, by place and length, with hashes of anchor and of context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in sliced(b["text"].cast(pa.binary()).to_pylist()):
                joined, rid = b"".join(part), b["rid"].slice(at, len(part))
                at += len(part)
                sizes = np.array([len(t) for t in part], np.int64)
                if sizes.max() < least:
                    continue
                raw, starts = np.frombuffer(joined, np.uint8), np.cumsum(sizes) - sizes
                text, first, last, key = anchors(raw, starts, sizes, least)
                ctx = [hashlib.blake2b(joined[i : j + least], digest_size=16).digest() for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rid.take(pa.array(text)), pa.array((first - starts[text]).astype(np.int32)), pa.array((last - first + least).astype(np.int32)), pa.array(key), pa.array(ctx, pa.binary())],
                    names=["rid", "start", "n", "key", "ctx"],
                )

    rows = docs.where(F.octet_length("text") >= least).select(row_key(docs).alias("rid"), "text")
    return rows.mapInArrow(run, "rid binary, start int, n int, key long, ctx binary")


def _ordered(key: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (of twice `bits` at most) in order, and their places; packed into one number where it holds both, which sorts much faster."""
    if max(3 * bits, 9 * PACKED + bits) <= 63:
        both = np.sort(key << bits | place)
        return both >> bits, both & ((1 << bits) - 1)
    by = np.argsort(key)
    return key[by], place[by]


def _ranked(key: np.ndarray, rows: np.ndarray, places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Set the rank of each place, the first row of the places with its key, and return the rows that share theirs.

    key, rows and places are in sorted order.
    """
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.append(head, len(key)))
    rank[places] = np.repeat(rows[head], size)
    return rows[np.repeat(size > 1, size)]


@dataclass
class RunIndex:
    """Run-compressed Burrows-Wheeler transform: symbol, first row, and text places of the first and last row of each run."""

    symbols: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    last: np.ndarray
    #: Names of PACKED, 2 PACKED, ... symbols at every place of the text, to compare two places.
    names: list[np.ndarray]
    line: np.ndarray

    @classmethod
    def build(cls, contexts: list[bytes]) -> RunIndex:
        """Index of the contexts, each closed by a symbol that no byte has; suffixes are sorted beyond the longest context."""
        longest = max(map(len, contexts))
        sizes = np.array([len(c) for c in contexts], np.int64)
        line = np.zeros(int(sizes.sum()) + len(sizes) + PACKED, np.int64)
        inside = np.zeros(len(line), bool)
        starts = np.cumsum(sizes + 1) - sizes - 1
        inside[np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)] = True
        line[inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 1
        key = line.copy()
        for i in range(1, PACKED):
            key <<= 9
            key[: len(line) - i] |= line[i:]
        bits, rows = len(line).bit_length(), np.arange(len(line), dtype=np.int32)
        key, order = _ordered(key, np.arange(len(line)), bits)
        rank = np.empty(len(line) + 1, np.int32)
        rank[-1] = -1  # what lies beyond the text comes first
        tied = _ranked(key, rows, order, rank)
        names, size = [rank], PACKED
        while size <= longest:
            # a rank is its group's first row, so only rows of larger groups are sorted again, in the rows they had
            place = order[tied]
            after = rank[np.minimum(place + size, len(line))].astype(np.int64) + 1
            key, order[tied] = _ordered(rank[place].astype(np.int64) << bits | after, place, bits)
            rank = rank.copy()
            tied = _ranked(key, tied, order[tied], rank)
            names.append(rank)
            size *= 2
        before = line[order - 1]  # the text is closed by zeros, so the first place has one before it, too
        head = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0))))
        return cls(before[head], head, order[head], order[np.append(head[1:], len(order)) - 1], names, line)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal symbols from places x and y on."""
        total, end = np.zeros(len(x), np.int64), len(self.line) - 1
        for k in range(len(self.names) - 1, -1, -1):
            a, b = np.minimum(x + total, end), np.minimum(y + total, end)
            total += (self.names[k][a] == self.names[k][b]) * (PACKED << k)
        alive = np.ones(len(x), bool)
        for _ in range(PACKED):
            alive &= self.line[np.minimum(x + total, end)] == self.line[np.minimum(y + total, end)]
            total += alive
        return total

    def reach(self) -> np.ndarray:
        """For every place, how far a match that starts there or before goes, streamed from the samples of the runs."""
        upper, lower = self.last[:-1], self.first[1:]
        shared = self.common(upper, lower)
        stop = np.flatnonzero(self.line == 0)
        ends = stop[np.searchsorted(stop, np.arange(len(self.line)))]  # where the place's context closes
        far = np.zeros(len(self.line), np.int64)
        for place in (upper, lower):
            np.maximum.at(far, place, np.minimum(place + shared, ends[place]))
        return np.maximum.accumulate(far)


def spans_of(hit: np.ndarray, least: int) -> list[dict[str, int]]:
    """Byte spans that the windows at the true places cover."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).view(np.int8)))
    return [{"s": int(a), "e": int(b) - 1 + least} for a, b in zip(edges[::2], edges[1::2], strict=True)]


SPANS = "array<struct<s: int, e: int>>"
SPANS_TYPE = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def marked(contexts: dict[bytes, tuple[bytes, int]], least: int) -> tuple[list[bytes], list[list[dict[str, int]]]]:
    """Contexts (name: bytes and number of copies) with their repeated spans, those without left out."""
    reach = RunIndex.build([c for c, _ in contexts.values()]).reach()
    names, spans, at = [], [], 0
    for name, (text, copies) in contexts.items():
        n = len(text) - least + 1
        hit = reach[at : at + n] - np.arange(at, at + n) >= least
        if copies > 1:
            hit[:] = True
        if hit.any():
            names.append(name)
            spans.append(spans_of(hit, least))
        at += len(text) + 1
    return names, spans


def by_index(contexts: DataFrame, least: int) -> DataFrame:
    """(ctx, spans) from indexes of buckets of contexts; an anchor's contexts share a bucket."""

    def run(bucket: pa.Table) -> pa.Table:
        found = dict(zip(bucket["ctx"].to_pylist(), zip(bucket["text"].to_pylist(), bucket["m"].to_pylist(), strict=True), strict=True))
        names, spans = marked(found, least)
        return pa.table({"ctx": pa.array(names, pa.binary()), "spans": pa.array(spans, SPANS_TYPE)})

    n = groups_for(contexts, F.octet_length("text"), BUCKET_BYTES)
    dealt = contexts.select(F.pmod(F.xxhash64("key"), F.lit(n)).alias("bucket"), "ctx", "m", "text")
    return dealt.groupBy("bucket").applyInArrow(run, f"ctx binary, spans {SPANS}")


def cut_again(contexts: DataFrame, least: int, seed: int) -> DataFrame:
    """(ctx, at, sub, key, m, text): the smaller contexts inside each context by the anchors of another hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in parts_of(batches):
            joined = b"".join(texts)
            sizes = np.array([len(t) for t in texts], np.int64)
            starts = np.cumsum(sizes) - sizes
            row, first, last, key = anchors(np.frombuffer(joined, np.uint8), starts, sizes, least, seed)
            # windows of different first anchors stay apart
            key = (key ^ b["key"].to_numpy()[row]) * np.int64(2 * seed + 1)
            parts = [joined[i : j + least] for i, j in zip(first.tolist(), last.tolist(), strict=True)]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    b["ctx"].take(at), pa.array((first - starts[row]).astype(np.int32)), pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in parts], pa.binary()),
                    pa.array(key), b["m"].take(at), pa.array(parts, pa.binary()),
                ],
                names=["ctx", "at", "sub", "key", "m", "text"],
            )

    return contexts.select("ctx", "key", "m", "text").mapInArrow(run, "ctx binary, at int, sub binary, key long, m long, text binary")


def counted(one: DataFrame) -> DataFrame:
    """Contexts (ctx, key, m, ...) of anchors that occur more than once, with c, the number of contexts of the anchor."""
    one = stored(one)
    keys = one.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("m").alias("t")).where("t > 1")
    return one.join(stored(keys.select("key", "c")), "key")


def marks_of(contexts: DataFrame, least: int, level: int = 0) -> DataFrame:
    """(ctx, spans) of the repeated windows of contexts (ctx, key, m, c, text), by the number of contexts of an anchor."""
    whole = F.array(F.struct(F.lit(0).alias("s"), F.octet_length("text").cast("int").alias("e")))
    alone = contexts.where("c = 1").select("ctx", whole.alias("spans"))
    marks = alone.union(by_index(contexts.where((F.col("c") > 1) & (F.col("c") <= HOT)), least))
    hot = contexts.where(F.col("c") > HOT)
    if hot.isEmpty():
        return marks
    if level == LEVELS:
        return marks.union(by_windows(hot, least))
    parts = stored(cut_again(hot, least, level + 1))
    one = parts.groupBy(F.col("sub").alias("ctx")).agg(F.first("key").alias("key"), F.sum("m").alias("m"), F.first("text").alias("text"))
    found = stored(marks_of(stored(counted(one)), least, level + 1)).withColumnRenamed("ctx", "sub")
    moved = F.transform("spans", lambda x: F.struct((F.col("at") + x["s"]).alias("s"), (F.col("at") + x["e"]).alias("e")))
    back = parts.select("ctx", "at", "sub").join(found, "sub").select("ctx", moved.alias("spans"))
    return marks.union(back.groupBy("ctx").agg(F.flatten(F.collect_list("spans")).alias("spans")))  # a context has few parts


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of about SLICE_BYTES of context text, and the texts."""
    for b in batches:
        at = 0
        for texts in sliced(b["text"].to_pylist()):
            yield b.slice(at, len(texts)), texts
            at += len(texts)


def by_windows(contexts: DataFrame, least: int) -> DataFrame:
    """(ctx, spans) by counting each window of the contexts."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in parts_of(batches):
            raw = np.frombuffer(b"".join(texts), np.uint8)
            sizes = np.array([len(t) for t in texts], np.int64)
            n = sizes - least + 1
            row = np.repeat(np.arange(len(texts)), n)
            i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = i + (np.cumsum(sizes) - sizes)[row]
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b["ctx"].take(row), pa.array(i.astype(np.int16)), b["m"].take(row), *(pa.array(string_hashes(raw, least, s)[at].view(np.int64)) for s in (0, 1))],
                names=["ctx", "i", "m", "h0", "h1"],
            )

    windows = stored(contexts.select("ctx", "m", "text").mapInArrow(hashed, "ctx binary, i short, m long, h0 long, h1 long"))
    twice = stored(windows.groupBy("h0", "h1").agg(F.sum("m").alias("t")).where("t > 1").select("h0", "h1"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for places in b["at"].to_pylist():
                hit = np.zeros(max(places) + 1, bool)
                hit[places] = True
                spans.append(spans_of(hit, least))
            yield pa.RecordBatch.from_arrays([b["ctx"], pa.array(spans, SPANS_TYPE)], names=["ctx", "spans"])

    hits = windows.join(twice, ["h0", "h1"]).groupBy("ctx").agg(F.collect_list("i").alias("at"))  # a context has few windows
    return hits.mapInArrow(joined, f"ctx binary, spans {SPANS}")


def cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ctx, key, m, c, text) of wanted contexts (rid, start, n, ctx, key, m, c), from one row of each rid."""

    kinds = pa.schema([("ctx", pa.binary()), ("key", pa.int64()), ("m", pa.int64()), ("c", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # rows that repeat stand together
        for b in batches:
            out, held = {c: [] for c in kinds.names}, 0
            for rid, raw, places in zip(b["rid"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), b["places"], strict=True):
                if rid != before:
                    for p in places.as_py():
                        out["text"].append(raw[p["start"] : p["start"] + p["n"]])
                        held += p["n"]
                        for c in ("ctx", "key", "m", "c"):
                            out[c].append(p[c])
                before = rid
                if held > 16 * SLICE_BYTES:
                    yield pa.RecordBatch.from_pydict(out, kinds)
                    out, held = {c: [] for c in kinds.names}, 0
            yield pa.RecordBatch.from_pydict(out, kinds)

    lists = stored(wanted.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "ctx", "key", "m", "c")).alias("places")))
    rows = docs.where(F.octet_length("text") > 0).select(row_key(docs).alias("rid"), "text")
    return rows.join(lists, "rid").select("rid", "text", "places").mapInArrow(run, "ctx binary, key long, m long, c long, text binary")


def repeated_spans(docs: DataFrame, least: int = 400) -> DataFrame:
    """(rid, found): for each row with repeated strings, the places of its contexts and the spans inside them."""
    if least <= GRAM:
        raise ValueError(f"repeated strings have more than {GRAM} bytes")
    places = stored(anchored(docs, least))
    one = places.groupBy("ctx").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("m"), F.min(F.struct("rid", "start", "n")).alias("r"))
    contexts = stored(cut_out(docs, counted(one.select("ctx", "key", "m", "r.rid", "r.start", "r.n"))))
    marks = marks_of(contexts, least)
    hits = places.select("rid", "start", "ctx").join(stored(marks), "ctx").select("rid", "start", "spans")
    return hits.groupBy("rid").agg(F.collect_list(F.struct("start", "spans")).alias("found"))


def remove_repeats(docs: DataFrame, least: int = 400) -> DataFrame:
    """doc_id, n_bytes, removed (maximal spans of bytes, by start) and kept (the other bytes) of every row."""
    schema = "doc_id long, n_bytes long, removed array<struct<start: long, length: long>>, kept binary"

    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b["text"].cast(pa.binary())
            removed: list[list[dict[str, int]]] = [[]] * b.num_rows
            left: list[bytes | None] = [None] * b.num_rows
            for row in np.flatnonzero(b["found"].is_valid().to_numpy(zero_copy_only=False)).tolist():
                text, spans = raw[row].as_py(), []
                for s, e in sorted((f["start"] + x["s"], f["start"] + x["e"]) for f in b["found"][row].as_py() for x in f["spans"]):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(e, spans[-1][1])
                    else:
                        spans.append([s, e])
                cuts = [0, *(x for span in spans for x in span), len(text)]
                removed[row] = [{"start": s, "length": e - s} for s, e in spans]
                left[row] = b"".join(text[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True))
            # texts without marks pass as they are
            kept = pc.coalesce(pa.array(left, pa.binary()), raw)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pc.binary_length(raw).cast(pa.int64()), pa.array(removed, spans_type), kept], names=["doc_id", "n_bytes", "removed", "kept"]
            )

    found = stored(repeated_spans(docs, least))
    rows = docs.select(row_key(docs).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(found, "rid", "left").select("doc_id", "text", "found").mapInArrow(run, schema)
