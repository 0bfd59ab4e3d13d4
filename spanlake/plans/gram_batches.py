"""Weights of n-grams by document frequency, for texts that do not move gram by gram.

Rows are packed once, many to a batch: a batch holds each of its texts once, as numbers of the batch's own words. For a slice of the
hash range it asks for the frequencies of its distinct n-grams, which go as sorted hashes, gap by gap, to the group of their range;
the answers come back as bare numbers in the order of the question. Shuffle files of a slice are dropped before the next one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.plans.folds import whole_groups
from spanlake.session import cut_free, shuffle_width

#: Words of the different texts of one batch.
BATCH_WORDS = 1 << 20
#: Parts of the hash range that are asked for one after the other.
SLICES = 4
#: n-grams that one group of the hash range answers in a slice, at most and, if the groups are few, at least; about.
GROUP_GRAMS = 1 << 22
LEAST_GRAMS = 1 << 16
#: n-grams of short pairs that are compared at once, and those from which a pair counts as long.
PAIR_GRAMS = 1 << 20
LONG_PAIR = 256

#: White space of Java's (?U)\s; str.split also cuts at the four of _OTHER.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_OTHER = re.compile("[\x1c-\x1f]")


def words(text: str) -> list[str]:
    """The tokens of functions.text._words."""
    return [w for w in _SPACE.split(text) if w] if _OTHER.search(text) else text.split()


def strings(column: pa.Array) -> list[str | None]:
    """Values of a string column; bytes that are no UTF-8 become U+FFFD, as in the JVM."""
    return [None if v is None else v.decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist()]


# ---- numbers as bytes ----------------------------------------------------------------------


def to_planes(x: np.ndarray) -> bytes:
    """Numbers from 0 to 2^64 - 1, byte place by byte place; a place is compressed where that is shorter."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    parts = [min((p.tobytes(), pa.compress(p, "zstd", asbytes=True)), key=len) if p.any() else b"" for p in planes]
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def from_planes(data: bytes, n: int) -> np.ndarray:
    planes, at = np.zeros((8, n), np.uint8), 32
    for plane, size in zip(planes, np.frombuffer(data, "<u4", 8).tolist()):
        if size:
            part = data[at : at + size]
            plane[:] = np.frombuffer(part if size == n else pa.decompress(part, n, "zstd", asbytes=True), np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def to_gaps(x: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return to_planes(np.diff(x, prepend=np.uint64(0)))


def from_gaps(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(from_planes(data, n), dtype=np.uint64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for size[i] places, one i after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def ascending(x: np.ndarray) -> np.ndarray:
    """Places of hashes in ascending order: the upper bits are sorted with the place below them, which takes a third of an argsort."""
    bits = np.uint64(max(1, len(x) - 1).bit_length())
    packed = x >> bits << bits | np.arange(len(x), dtype=np.uint64)
    packed.sort()
    by = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    upper, found = packed >> bits, x[by]
    for t in np.unique(upper[1:][found[1:] < found[:-1]]):  # few share the upper bits and differ below
        lo, hi = np.searchsorted(upper, t, side="left"), np.searchsorted(upper, t, side="right")
        by[lo:hi] = by[lo:hi][np.argsort(found[lo:hi])]
    return by


# ---- batches -------------------------------------------------------------------------------


class _Packer:
    """Rows of a batch: documents are lists of texts, each kept once."""

    def __init__(self):
        self.names: dict[str, int] = defaultdict(count().__next__)
        self.seen: dict[tuple[str, ...], int] = {}
        self.of, self.size, self.words = [], [], []
        self.ident, self.hyp, self.ref = [], [], []
        self.load = 0

    def document(self, texts: list[str | None]) -> int:
        key = tuple(t or "" for t in texts)
        at = self.seen.setdefault(key, len(self.seen))
        if at == len(self.seen) - 1 and (not self.of or self.of[-1] < at):
            for t in key or ("",):
                own = words(t)
                self.of.append(at)
                self.size.append(len(own))
                self.words.append(np.fromiter(map(self.names.__getitem__, own), np.uint32, len(own)))
                self.load += len(own)
        return at

    def add(self, ident: pa.Array, hyp: list[str] | None, refs: list[list[str]]) -> None:
        self.ident.append(ident)
        self.hyp.append(None if hyp is None else self.document(hyp))
        self.ref.append([self.document(r) for r in refs])
        self.load += 8

    def row(self, batch: int, schema: pa.Schema) -> pa.RecordBatch:
        names = pd.util.hash_array(np.array(list(self.names), object), categorize=False).astype("<u8")
        values = {
            "batch": batch, "hyp": self.hyp, "ref": self.ref, "of": self.of, "size": self.size, "names": names.tobytes(),
            "words": to_planes(np.concatenate(self.words or [np.zeros(0, np.uint32)])), "n_words": sum(self.size),
            "n_sources": sum(bool(r) for r in self.ref),
        }
        ident = pa.concat_arrays(self.ident)
        columns = [pa.ListArray.from_arrays(pa.array([0, len(ident)], pa.int32()), ident) if f.name == "ident" else pa.array([values[f.name]], f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)


PACKED = "hyp array<int>, ref array<array<int>>, of array<int>, size array<int>, names binary, words binary, n_words long, n_sources long"


def pack(rows: DataFrame) -> DataFrame:
    """Batches of rows (ident, hyp, refs): hyp the hypothesis's texts or null, refs the texts of each reference of the source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = _Packer(), TaskContext.get().partitionId() << 32
        schema = None
        for b in batches:
            if schema is None:
                ints = pa.list_(pa.int32())
                schema = pa.schema([
                    ("batch", pa.int64()), ("ident", pa.list_(b.schema.field("ident").type)), ("hyp", ints), ("ref", pa.list_(ints)), ("of", ints), ("size", ints),
                    ("names", pa.binary()), ("words", pa.binary()), ("n_words", pa.int64()), ("n_sources", pa.int64()),
                ])
            hyp, refs, ident = b.column("hyp"), b.column("refs"), b.column("ident")
            one, several = strings(hyp.values), strings(refs.values.values)
            h_end, r_end, t_end = hyp.offsets.to_pylist(), refs.offsets.to_pylist(), refs.values.offsets.to_pylist()
            known, first = hyp.is_valid().to_pylist(), 0
            for i in range(b.num_rows):
                held.add(
                    ident.slice(i, 1), one[h_end[i] : h_end[i + 1]] if known[i] else None,
                    [several[t_end[j] : t_end[j + 1]] for j in range(r_end[i], r_end[i + 1])],
                )
                if held.load >= BATCH_WORDS:
                    yield held.row(number, schema)
                    held, number = _Packer(), number + 1
        if held.ident:
            yield held.row(number, schema)

    kind = rows.schema["ident"].dataType.simpleString()
    return rows.mapInArrow(run, f"batch long, ident array<{kind}>, {PACKED}")


class _Batch:
    """An unpacked batch with its n-grams."""

    def __init__(self, row: dict):
        self.hyp, self.ref = row["hyp"], row["ref"]
        self.of, self.size = np.array(row["of"], np.int64), np.array(row["size"], np.int64)
        names = np.frombuffer(row["names"], "<u8")
        self.words = names[from_planes(row["words"], int(self.size.sum())).astype(np.int64)]
        self.docs = int(self.of[-1]) + 1 if len(self.of) else 0

    def hashed(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(order, hashes, documents) of the n-grams as they occur."""
        end, doc = np.repeat(np.cumsum(self.size), self.size), np.repeat(self.of.astype(np.int32), self.size)
        gram = np.zeros(len(self.words), np.uint64)
        for k in range(1, n + 1):
            wide = max(0, len(self.words) - k + 1)
            gram = (gram[:wide] ^ self.words[k - 1 :]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            gram ^= gram >> np.uint64(29)
            own = np.arange(k, wide + k) <= end[:wide]
            yield k, gram[own], doc[:wide][own]

    def grams(self, n: int) -> Iterator[tuple[np.ndarray, ...]]:
        """For each slice the distinct hashes, ascending, with their orders, and (document, gram, count), ascending, of those that it holds."""
        return map(self._distinct, self._sliced(n))

    def slice_grams(self, n: int, part: int) -> tuple[np.ndarray, ...]:
        own = []
        for k, gram, doc in self.hashed(n):
            at = slice_of(gram) == part
            own.append((k, gram[at], doc[at]))
        return self._distinct(own)

    def _sliced(self, n: int) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
        flat = [(k, gram, doc, slice_of(gram)) for k, gram, doc in self.hashed(n)]
        for part in range(SLICES):
            yield [(k, gram[at], doc[at]) for k, gram, doc, own in flat for at in [own == part]]

    def _distinct(self, found: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        gram, doc = (np.concatenate([f[i] for f in found]) for i in (1, 2))
        by = ascending(gram)
        gram = gram[by]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = gram[1:] != gram[:-1]
        order = np.searchsorted(np.cumsum([len(g) for _, g, _ in found]), by[fresh], side="right") + 1
        gram = gram[fresh]
        number = np.empty(len(by), np.int64)
        number[by] = np.cumsum(fresh) - 1
        code = np.sort(doc * np.int64(len(gram)) + number)
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        tf, code = np.diff(starts, append=len(code)), code[starts]
        doc = code // max(len(gram), 1)
        return gram, order, doc, code - doc * len(gram), tf

    def sources(self, n_grams: int, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each distinct n-gram, rows with a reference that holds it."""
        single = np.bincount(np.array([r[0] for r in self.ref if len(r) == 1], np.int64), minlength=self.docs)
        held = np.bincount(at, single[doc], n_grams).astype(np.int64)
        several = [(i, d) for i, r in enumerate(self.ref) if len(r) > 1 for d in set(r)]
        if several:
            row, d = np.array(several, np.int64).T
            size = np.bincount(doc, minlength=self.docs)
            own = at[_ranges((np.cumsum(size) - size)[d], size[d])]
            held += np.bincount(np.unique(own * len(self.ref) + np.repeat(row, size[d])) // len(self.ref), minlength=n_grams)
        return held

    def scores(self, n: int, sigma: float | None, df: np.ndarray, n_sources: int) -> list[float | None]:
        """CIDEr of each row, null where it has no hypothesis; df in the order of the n-grams of all slices."""
        row = np.repeat(np.arange(len(self.ref)), [0 if h is None else len(r) for h, r in zip(self.hyp, self.ref)])
        h = np.array([self.hyp[i] for i in row], np.int64)
        r = np.array([d for x, own in zip(self.hyp, self.ref) if x is not None for d in own], np.int64)
        pairs, which = np.unique(h * self.docs + r, return_inverse=True)
        a, b = pairs // max(self.docs, 1), pairs % max(self.docs, 1)
        squares, dot, held = np.zeros(self.docs * n), np.zeros(len(pairs) * n), np.zeros(self.docs, np.int64)
        seen = 0
        for gram, order, doc, at, tf in self.grams(n):
            own = df[seen : seen + len(gram)]
            seen += len(gram)
            weight = np.log(float(max(n_sources, 1))) - np.log(own.astype(float))
            weight[own == n_sources] = 0.0
            squares += np.bincount(doc * n + order[at] - 1, (tf * weight[at]) ** 2, self.docs * n)
            size = np.bincount(doc, minlength=self.docs)
            held += size
            for pair, x, y in _shared(a, b, np.cumsum(size) - size, size, at, len(gram)):
                product = (tf[x] if sigma is None else np.minimum(tf[x], tf[y])) * tf[y] * weight[at[y]] ** 2
                dot += np.bincount(pair * n + order[at[y]] - 1, product, len(dot))
        norm = np.sqrt(squares).reshape(-1, n)
        norms, dot = norm[a] * norm[b], dot.reshape(-1, n)
        value = np.divide(dot, norms, out=dot.copy(), where=norms != 0).sum(1)
        if sigma is not None and n > 1:
            bigrams = np.bincount(self.of, np.maximum(self.size - 1, 0), self.docs)
            value *= np.exp(-((bigrams[a] - bigrams[b]) ** 2) / (2.0 * sigma * sigma))
        # a pair without n-grams on both sides does not count
        there = (held[a] + held[b] > 0).astype(float)
        total, refs = (np.bincount(row, v[which], len(self.ref)) for v in (value, there))
        mean = np.divide(total / n * 10, refs, out=np.zeros(len(self.ref)), where=refs > 0)
        return [None if x is None else m for x, m in zip(self.hyp, mean.tolist())]


def _shared(a: np.ndarray, b: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, n_grams: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, place in a, place in b) of the n-grams that both documents of a pair hold; a document's n-grams ascend from its start."""
    load = size[a] + size[b]
    place, found, rows = np.full(n_grams, -1, np.int64), [], 0
    for i in np.flatnonzero(load >= LONG_PAIR).tolist():
        x = slice(start[a[i]], start[a[i]] + size[a[i]])
        place[at[x]] = np.arange(x.start, x.stop)
        to = place[at[start[b[i]] : start[b[i]] + size[b[i]]]]
        y = np.flatnonzero(to >= 0)
        place[at[x]] = -1
        found.append((np.full(len(y), i), to[y], y + start[b[i]]))
        rows += len(y)
        if rows >= PAIR_GRAMS:
            yield tuple(np.concatenate(c) for c in zip(*found))
            found, rows = [], 0
    if found:
        yield tuple(np.concatenate(c) for c in zip(*found))
    short = np.flatnonzero(load < LONG_PAIR)
    for own in np.array_split(short, int(load[short].sum()) // PAIR_GRAMS + 1):
        x, y = (_ranges(start[d[own]], size[d[own]]) for d in (a, b))
        kx, ky = (np.repeat(np.arange(len(own)), size[d[own]]) * n_grams + at[places] for d, places in ((a, x), (b, y)))
        to = np.searchsorted(kx, ky)
        same = np.flatnonzero(to < len(kx))
        same = same[kx[to[same]] == ky[same]]
        yield own[ky[same] // max(n_grams, 1)], x[to[same]], y[same]


# ---- questions and answers -----------------------------------------------------------------


def _part(gram: np.ndarray, n: int) -> np.ndarray:
    """Which of n even parts of the hash range."""
    return ((gram >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def slice_of(gram: np.ndarray) -> np.ndarray:
    return _part(gram, SLICES)


def _ask(n: int, part: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                b = _Batch(row)
                gram, _, doc, at, _ = b.slice_grams(n, part)
                held = b.sources(len(gram), doc, at)
                own = _part(gram, SLICES * groups) - part * groups
                cuts = np.flatnonzero(np.diff(own, prepend=-1, append=groups))
                out = [(int(own[x]), row["batch"], int(y - x), to_gaps(gram[x:y]), to_planes(held[x:y])) for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "batch", "n", "gram", "held"]) if out else None

    return lambda batches: (b for b in run(batches) if b is not None)


def _answer(first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, ["part"]):
            n, gaps, counts = (rows.column(c).to_pylist() for c in ("n", "gram", "held"))
            out = []
            for lo, hi in zip(bounds.tolist(), [*bounds.tolist()[1:], rows.num_rows]):
                if lo == hi:
                    continue
                gram = np.concatenate([from_gaps(gaps[i], n[i]) for i in range(lo, hi)])
                held = np.concatenate([from_planes(counts[i], n[i]) for i in range(lo, hi)]).astype(np.int64)
                by = ascending(gram)
                fresh = np.ones(len(gram), bool)
                gram = gram[by]
                fresh[1:] = gram[1:] != gram[:-1]
                df = np.empty(len(gram), np.int64)
                df[by] = np.add.reduceat(held[by], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
                # most n-grams have one source, which is stored as 0
                out += [to_planes(np.maximum(x, 1) - 1) for x in np.split(df, np.cumsum(n[lo:hi])[:-1])]
            part = pc.add(rows.column("part"), pa.scalar(first, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column("batch"), part, rows.column("n"), pa.array(out, pa.binary())], names=["batch", "part", "n", "df"])

    return run


def _scored(n: int, sigma: float | None, n_sources: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        own, df = None, []

        def done() -> pa.RecordBatch:
            known = np.concatenate([from_planes(d, k) for k, d in df] or [np.zeros(0, np.uint64)]).astype(np.int64) + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(own["ident"], kind), pa.array(_Batch(own).scores(n, sigma, known, n_sources), pa.float64())], names=["ident", "cider"]
            )

        for rows in batches:
            kind = rows.schema.field("ident").type.value_type
            for part, size, answer, i in zip(*(rows.column(c).to_pylist() for c in ("part", "n", "df")), range(rows.num_rows)):
                if part >= 0:
                    df.append((size, answer))
                    continue
                if own:
                    yield done()
                own, df = rows.slice(i, 1).to_pylist()[0], []
        if own:
            yield done()

    return run


def cider_scores(rows: DataFrame, n: int, sigma: float | None) -> DataFrame:
    """(ident, cider) for rows (ident, hyp, refs), one a source; null where hyp is null."""
    spark = rows.sparkSession
    width = shuffle_width(spark)
    packed = cut_free(pack(rows))
    size = packed.agg(F.sum("n_words").alias("words"), F.sum("n_sources").alias("sources")).first()
    grams = n * (size.words or 0) // SLICES
    groups = max(grams // GROUP_GRAMS, min(2 * width, grams // LEAST_GRAMS)) + 1
    texts = packed.select("batch", "hyp", "ref", "of", "size", "names", "words")
    met = packed.withColumn("part", F.lit(-1)).withColumn("n", F.lit(0)).withColumn("df", F.lit(None).cast("binary"))
    for part in range(SLICES):
        asked = texts.mapInArrow(_ask(n, part, groups), "part int, batch long, n int, gram binary, held binary")
        asked = asked.repartition(width, "part").sortWithinPartitions("part")
        answered = cut_free(asked.mapInArrow(_answer(part * groups), "batch long, part int, n int, df binary"))
        met = met.unionByName(answered, allowMissingColumns=True)
    # a batch is met first, then its answers in the order of its n-grams
    met = met.repartitionByRange(width, "batch").sortWithinPartitions("batch", "part")
    kind = rows.schema["ident"].dataType.simpleString()
    return met.mapInArrow(_scored(n, sigma, size.sources or 0), f"ident {kind}, cider double")
