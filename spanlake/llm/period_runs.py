"""Runs of repeated words: every maximal stretch that repeats a period at least `fold` times, found by multi-scale minimizers.

The words of many documents form one array of numbers, with a number of its own between documents, so that no match crosses.
Periods up to SHORT are found by direct lag scans: neighbouring words that equal the word q places on form a stretch.
Longer periods go by scales. At scale c, for periods q in [c, 2c), every place gets the exact name of its 2c words, and
each window of c places selects the place of its least name. A run of period q and length >= 4q holds whole windows at some
j and at j + q; their minima lie q apart and have one name. Names of 2c > q words cannot repeat at less than q inside a run,
as q is its smallest period; so these two are neighbours among the selected places of that name, and
neighbouring places with equal minimizers are the only seeds. Each seed is extended to both sides by doubling over the
names of all scales. No run is missed, and seeds per scale number about two in c words.

Defined cases: a null, empty or blank text has no words and no runs; an empty table gives no rows; rows that repeat an id
are read one by one; a null id stays null; a text of any length is read whole, texts in batches of about BATCH_WORDS words;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Periods up to here are found by direct lag scans; a power of two.
SHORT = 8
BATCH_WORDS = 1 << 18
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def stretches(alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], alike, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Names of twice the size: equal where two neighbouring pieces of the given size are equal; -1 beyond the end."""
    after = np.full(len(names), -1, np.int64)
    after[: len(names) - size] = names[size:]
    whole = (names >= 0) & (after >= 0)
    found = np.full(len(names), -1, np.int64)
    found[whole] = np.unique(names[whole] << 32 | after[whole], return_inverse=True)[1]
    return found


def window_minima(names: np.ndarray, size: int) -> np.ndarray:
    """Places selected by the windows of `size` (a power of two) places: of each window the leftmost of the least value."""
    # mixed, so that no order of the words themselves makes minima crowd
    key = (names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) << np.uint64(31) | np.arange(len(names), dtype=np.uint64)
    width = 1
    while width < size:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    return np.unique((key & np.uint64((1 << 31) - 1)).astype(np.int64))


class Names:
    """Names of 1, 2, 4, ... consecutive words at every place; equal names mean equal words."""

    def __init__(self, words: np.ndarray):
        self.levels = [words]

    def level(self, k: int, most: int) -> np.ndarray:
        """Names of 2 ** k words at the first `most` places, as levels that are new now go no further."""
        while len(self.levels) <= k:
            self.levels.append(doubled(self.levels[-1][:most], 1 << len(self.levels) - 1))
        return self.levels[k][:most]

    def common(self, x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
        """Number of equal words from places x < y on, or before them."""
        total = np.zeros(len(x), np.int64)
        top = len(self.levels) - 1
        for k, again in [(top, True), *((k, False) for k in range(top - 1, -1, -1))]:
            names, size = self.levels[k], 1 << k
            open_ = np.arange(len(x))
            while len(open_):
                a, b = x[open_], y[open_]
                a, b = (a - total[open_] - size, b - total[open_] - size) if back else (a + total[open_], b + total[open_])
                inside = (a >= 0) & (b < len(names))
                open_, a, b = open_[inside], a[inside], b[inside]
                open_ = open_[(names[a] == names[b]) & (names[a] >= 0)]
                total[open_] += size
                if not again:
                    break
        return total


def smallest(words: np.ndarray, start: int, end: int, q: int) -> bool:
    """A stretch of period q with at least two periods has no smaller one: such a one would divide q."""
    rest, p = q, 2
    while rest > 1:
        if rest % p:
            p = p + 1 if p * p <= rest else rest
            continue
        lag = q // p
        if (words[start : end - lag] == words[start + lag : end]).all():
            return False
        while rest % p == 0:
            rest //= p
    return True


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int, fold: int) -> np.ndarray:
    """(start, length, period) of every run in an array of numbers >= 0, by start, then period.

    The array holds documents of the given falling sizes, each with one number of its own behind it. A long period looks at
    the documents that are long enough only.
    """
    found, longest, ends = [], int(sizes.max(initial=0)), np.cumsum(sizes + 1)
    for q in range(1, min(SHORT, longest // fold) + 1):
        start, end = stretches(words[:-q] == words[q:])
        size = end - start + q
        long = size >= max(least, fold * q)
        found.append(np.stack([start[long], size[long], np.full(long.sum(), q)], 1))
    names, scale = Names(words), SHORT
    while scale * fold <= longest:
        reach = int(ends[np.searchsorted(-sizes, -scale * fold, "right") - 1])
        own = names.level(scale.bit_length(), reach)  # names of 2 * scale words
        at = window_minima(np.where(own < 0, 0, own), scale)
        at = at[own[at] >= 0]
        at = at[np.lexsort((at, own[at]))]
        x, y = at[:-1], at[1:]
        seed = (own[x] == own[y]) & (y - x >= scale) & (y - x < 2 * scale)
        x, y = x[seed], y[seed]
        start = x - names.common(x, y, True)
        size = y + names.common(x, y, False) - start
        q = y - x
        long = size >= np.maximum(least, fold * q)
        found.append(np.stack([start[long], size[long], q[long]], 1))
        scale *= 2
    all_ = np.unique(np.concatenate([f for f in found if len(f)] or [np.empty((0, 3), np.int64)]), axis=0)
    good = [smallest(words, s, s + n, q) for s, n, q in all_.tolist()]
    all_ = all_[np.array(good, bool)]
    return all_[np.lexsort((all_[:, 2], all_[:, 0]))]


def batches(texts: Iterator[str | None]) -> Iterator[list[list[bytes]]]:
    """Lists of texts as words, of about BATCH_WORDS words together."""
    held, room = [], BATCH_WORDS
    for t in texts:
        held.append((t or "").encode().split())  # bytes are split at ASCII white space
        room -= len(held[-1]) + 1
        if room <= 0:
            yield held
            held, room = [], BATCH_WORDS
    if held:
        yield held


def runs_of(texts: list[list[bytes]], least: int, fold: int) -> list[np.ndarray]:
    """Runs of each text, as (start, length, period) rows."""
    # documents by falling length: a long period then only looks at the first ones
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    numbers = pd.factorize(np.array([w for i in order for w in texts[i]] or [b""], object))[0].astype(np.int64)
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order] + np.arange(len(order))  # with one place after each document
    line = np.empty(int(sizes.sum()) + len(order), np.int64)
    between = np.zeros(len(line), bool)
    between[starts + sizes[order]] = True
    line[~between] = numbers[: int(sizes.sum())]
    line[between] = numbers.max() + 1 + np.arange(len(order))
    found = find_runs(line, sizes[order], least, fold)
    owner = np.searchsorted(starts, found[:, 0], "right") - 1
    found[:, 0] -= starts[owner]
    cut = np.searchsorted(owner, np.arange(len(order) + 1))
    result = [found[:0]] * len(order)
    for place, i in enumerate(order.tolist()):
        result[i] = found[cut[place] : cut[place + 1]]
    return result


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run contains after its first period, joined by blanks."""
    if len(runs):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
    return b" ".join(words).decode()


def period_runs(docs: DataFrame, least: int = 6, fold: int = 4) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed text of every document.

    A run is a maximal stretch of words of smallest period q with at least max(least, fold * q) words; fold is 4 or more,
    which the search by minimizers needs.
    """
    if fold < 4:
        raise ValueError("runs repeat their period at least four times")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            at = 0
            for texts in batches(t.as_py() for t in b["text"]):
                runs = runs_of(texts, least, fold)
                flat = np.concatenate([*runs, np.empty((0, 3), np.int64)])
                part = pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], names=["start", "length", "period"])
                offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b["doc_id"].slice(at, len(texts)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), part),
                        pa.array([collapsed(t, r) for t, r in zip(texts, runs, strict=True)], pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
