"""Near-duplicate groups: MinHash bands, sequential Bayesian verification, exact check of the survivors.

A document is the set of its distinct word shingles (five words, lower-cased A-Z). Documents with one and the same set form
a class, and one row stands for it. BANDS x ROWS minima are cut into bands; classes that share a band are candidates. At similarity
0.75 a pair shares no band with probability (1 - 0.75 ** 4) ** 32 = 5e-6. Candidates are verified batch by batch: set sizes and one bit of each band minimum
inside the join of a band's members, then SKETCH further signature places of four bits each: those of the band minima, and the minima of BINS
bins that partition the hashes. After each batch a pair is dropped if the posterior probability that its
similarity reaches the threshold, given the agreements so far and a flat prior, is below MISS. Bins that are empty on both sides say nothing
and do not count. Survivors are compared on their full sets, and only those links count.

A band shared by very many documents does not give all their pairs. First each member is compared with two pivots of the band,
the one whose bands are fullest (the text that others were copied from) and a random one; what is linked becomes components. Bands whose
members lie in one component are done. Members of the other bands are compared by a prefix filter: shingles are
ordered by rarity, and a pair x, y of at most equal size |x| <= |y| at threshold t shares
one of the first |x| - ceil(2t / (1 + t) |x|) + 1 shingles of x and the first |y| - ceil(t |y|) + 1 of y: its overlap is at
least 2t / (1 + t) |x| and t |y|, and the rarest common shingle has at least so many common ones at or behind it on both sides. A text
that differs from all others in that many shingles of its own has no common one there and forms no
pair, so a large group around one passage costs its size. Every pair of different components that share a band and reach the
threshold meets in this filter; no link is lost.

Defined cases: a null or blank text has no shingles, is linked with nothing and stays; fewer than five words are one
shingle; rows that repeat a doc_id with other words are linked each by its own words, and a component goes by the smallest
doc_id among its rows; a row stays if that is its own doc_id; a null doc_id has a null component and stays; an empty table gives no rows; sets of any size are
read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import keep_rows, stored, text_key
from spanlake.llm.components import components

WORDS = 5
BANDS, ROWS = 32, 4
BINS = 384
MINIMA = BANDS * ROWS
#: Bytes of a signature that are compared, two places each, and how many of them make a batch.
SKETCH, BATCH = (MINIMA + BINS) // 2, 32
MISS = 1e-5

_draw = np.random.Generator(np.random.PCG64(20))
BYTE = _draw.integers(0, 1 << 64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = _draw.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _draw.integers(0, 1 << 32, (MINIMA, 1), np.uint32)
ODD = _draw.integers(0, 1 << 31, (MINIMA, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text, in linear time."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)  # bytes are lower-cased in A-Z only
    blank = np.concatenate(([True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    power = np.empty(len(raw), np.uint64)
    power[0], power[1:] = 1, BASE
    np.multiply.accumulate(power, out=power)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * power, dtype=np.uint64)))
    inverse = np.full(len(raw), BACK, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    word = mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    n = min(WORDS, len(word))
    total = sum(word[i : len(word) - n + 1 + i] * PLACE[i] for i in range(n))
    return np.unique(mixed(total + np.uint64(n)))


def signature(found: np.ndarray) -> np.ndarray:
    """The BANDS x ROWS minima of a set."""
    x = ((found >> np.uint64(32)) ^ found).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for part in range(0, len(x), 8192):
        least = np.minimum(least, ((x[None, part : part + 8192] ^ FLIP) * ODD).min(1))
    return least


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One key per band of each row of signatures; bands do not share keys."""
    rows = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), rows.shape[:2])
    for i in range(ROWS):
        key = mixed(key * BASE + rows[:, :, i])
    return key.view(np.int64)


def sketch(found: np.ndarray, minima: np.ndarray) -> bytes:
    """Four bits of each minimum, then of the least hash in each bin; an empty bin is 0, a full one 1 to 15."""
    places = np.zeros(MINIMA + BINS, np.uint8)
    places[:MINIMA] = (minima * np.uint32(0x9E3779B1)) >> np.uint32(28)
    # hashes come in order, so written from the last to the first the least one of a bin stays
    bins = ((found & np.uint64(0xFFFFFFFF)) * np.uint64(BINS)) >> np.uint64(32)
    places[MINIMA + bins[::-1].astype(np.int64)] = (mixed(found[::-1]) >> np.uint64(40)) % np.uint64(15) + np.uint64(1)
    return (places[::2] << 4 | places[1::2]).tobytes()


def least_agreements(threshold: float, miss: float) -> np.ndarray:
    """For n = 0, 1, ... compared places: the fewest agreements m with P(similarity >= threshold | m of n) >= miss under a flat prior.

    Places of four bits agree by chance in one case of sixteen.
    """
    agree = threshold + (1 - threshold) / 16
    found = []
    for n in range(2 * SKETCH + 1):
        tail, m = 0.0, 0
        while True:  # the posterior is Beta(m + 1, n - m + 1), its tail a binomial sum
            tail += comb(n + 1, m) * agree**m * (1 - agree) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        found.append(m)
    return np.array(found, np.int64)


def most_bits_apart(threshold: float, miss: float) -> int:
    """Most differing bits d of BANDS x ROWS with P(similarity >= threshold | d) >= miss: bits agree with (1 + similarity) / 2."""
    n, p = MINIMA, np.linspace(0.5, 1, 20_001)[:-1]
    for d in range(n):
        density = np.exp((n - d) * np.log(p) + d * np.log(1 - p))
        if density[p >= (1 + threshold) / 2].sum() < miss * density.sum():
            return d - 1
    return n


def bits(minima: np.ndarray) -> np.ndarray:
    """One mixed bit of each minimum, packed into two longs."""
    return np.packbits(((minima * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, _text, n, fp (fingerprint of the set, null if empty), band keys, sketch and bits of minima (s0, s1) of every row."""
    schema = "doc_id long, _text long, n long, fp binary, keys array<long>, sketch binary, s0 long, s1 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fp, keys, places, packed = [], [], [], [], np.zeros((b.num_rows, 2), np.int64)
            for i, t in enumerate(b["text"]):
                found = shingles(t.as_py())
                n.append(len(found))
                if not len(found):
                    fp.append(None), keys.append(None), places.append(None)
                    continue
                least = signature(found)
                fp.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(band_keys(least)[0])
                places.append(sketch(found, least))
                packed[i] = bits(least)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["_text"], pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.binary()), *map(pa.array, packed.T.copy())],
                names=["doc_id", "_text", "n", "fp", "keys", "sketch", "s0", "s1"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("_text"), "text")
    return rows.mapInArrow(run, schema)


def surviving(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of sketches no batch rules out."""
    alive = np.arange(len(x))
    same, seen = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, SKETCH, BATCH):
        a, b = x[alive, at : at + BATCH], y[alive, at : at + BATCH]
        for mask in (np.uint8(0xF0), np.uint8(0x0F)):
            told = ((a | b) & mask) != 0 if at >= MINIMA // 2 else np.ones(a.shape, bool)
            seen[alive] += told.sum(1)
            same[alive] += (told & (((a ^ b) & mask) == 0)).sum(1)
        alive = alive[same[alive] >= least[seen[alive]]]
    return alive


def agreeing(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) that no batch of their signatures rules out."""
    least = least_agreements(threshold, MISS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(b.num_rows, SKETCH) for c in ("a", "b"))
                kept = pa.array(surviving(x, y, least))
                yield pa.RecordBatch.from_arrays([b["u"].take(kept), b["v"].take(kept)], names=["u", "v"])

    own = classes.select("id", "sketch")
    return pairs.join(own.toDF("v", "b"), "v").join(own.toDF("u", "a"), "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def linked(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets reach the threshold."""
    left = agreeing(pairs, classes, percent / 100)
    both = left.join(sets.toDF("v", "b"), "v").join(sets.toDF("u", "a"), "u")
    shared = F.size(F.array_intersect("a", "b"))
    sized = both.select("u", "v", shared.alias("i"), (F.size("a") + F.size("b")).alias("t"))
    return sized.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("u", "v")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, s): the full set of each wanted id, from one row of its (doc_id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b["text"]]
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate(sets or [np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["id"], pa.ListArray.from_arrays(pa.array(at), pa.array(values))], names=["id", "s"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("_text"), "text")
    same = rows.join(wanted, ["doc_id", "_text"]).groupBy("doc_id", "_text").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    return same.select("id", "text").mapInArrow(run, "id long, s array<long>")


def alike(a: str, b: str, percent: int) -> Column:
    """Sizes and bits of two members (structs) do not rule the pair out."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    sizes = 100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))
    differing = F.bit_count(x("s0").bitwiseXOR(y("s0"))) + F.bit_count(x("s1").bitwiseXOR(y("s1")))
    return sizes & (differing <= most_bits_apart(percent / 100, MISS))


def pivot_pairs(members: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of each band member with the two pivots of its band; u is the pivot."""
    one = F.struct("id", "n", "s0", "s1")
    placed = members.select("key", "id").join(own, "id").select("key", one.alias("x"), "w")
    central = F.min(F.struct((-F.col("w")).alias("w"), F.col("x.id").alias("i"), F.col("x").alias("y")))
    random = F.min(F.struct(F.xxhash64("x.id").alias("w"), F.col("x.id").alias("i"), F.col("x").alias("y")))
    pivots = placed.groupBy("key").agg(central.alias("p"), random.alias("q")).select("key", F.array_distinct(F.array("p.y", "q.y")).alias("ys"))
    both = placed.join(pivots, "key").select("x", F.explode("ys").alias("y"))
    return both.where((F.col("x.id") != F.col("y.id")) & alike("x", "y", percent)).select(F.col("y.id").alias("u"), F.col("x.id").alias("v")).distinct()


def prefix_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components (open_: id, n, s0, s1, c) that share a shingle in their prefixes, u the larger one."""
    n = F.col("n")
    probe = n - F.ceil(n * percent / 100) + 1
    index = n - F.ceil(n * 2 * percent / (100 + percent)) + 1
    each = stored(sets.join(open_, "id").select("id", "n", "c", F.explode("s").alias("g")))
    # shingles of one text only come first in order and pair with nothing
    common = stored(each.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    by_text = Window.partitionBy("id")
    in_order = by_text.orderBy("m", "g")
    ranked = each.join(common, "g").select(
        "id", "n", "c", "g", F.row_number().over(in_order).alias("r"), F.lag("g").over(in_order).alias("before"), F.count(F.lit(1)).over(by_text).alias("k")
    )
    place = F.col("r") + n - F.col("k")
    prefixes = stored(ranked.withColumn("place", place).where(F.col("place") <= probe).select("g", "id", "c", "place", "before", (F.col("place") <= index).alias("short")))
    useful = prefixes.groupBy("g").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("g")
    here = prefixes.join(stored(useful), "g")
    one = open_.select("id", F.struct("id", "n", "s0", "s1").alias("o"))
    side = lambda rows, o: rows.join(one, "id").select("g", F.col("o").alias(o), F.struct("c", "place", "before").alias(f"{o}_at"))
    both = side(here.where("short"), "x").join(side(here, "y"), "g")
    apart = (F.col("x_at.c") != F.col("y_at.c")) & (F.struct("x.n", "x.id") < F.struct("y.n", "y.id"))
    # a pair counts at its first common shingle: not where the one before is common as well, nor where too few can follow
    first = ~F.coalesce(F.col("x_at.before") == F.col("y_at.before"), F.lit(False))
    needed = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    enough = F.least(F.col("x.n") - F.col("x_at.place"), F.col("y.n") - F.col("y_at.place")) + 1 >= needed
    return both.where(apart & first & enough & alike("x", "y", percent)).select(F.col("y.id").alias("u"), F.col("x.id").alias("v")).distinct()


def links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the classes that are linked with another one."""
    keys = classes.select("id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = stored(keys.join(shared, "key"))
    # the text that others were copied from shares its bands with most of them
    centre = members.groupBy("id").agg(F.sum("m").alias("w"))
    own = stored(classes.select("id", "doc_id", "_text", "n", "s0", "s1", "sketch").join(centre, "id"))
    sets = stored(full_sets(docs, own.select("id", "doc_id", "_text")))
    narrow = own.select("id", "n", "s0", "s1", "w")
    labels = stored(components(linked(pivot_pairs(members, narrow, percent), own, sets, percent)))
    known = narrow.join(labels, "id", "left").select("id", "n", "s0", "s1", F.coalesce("component", "id").alias("c"))
    placed = members.select("key", "id").join(known.select("id", "c"), "id")
    apart = placed.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("key")
    open_ = stored(known.join(members.join(stored(apart), "key").select("id").distinct(), "id", "left_semi"))
    if open_.isEmpty():
        return labels
    new = linked(prefix_pairs(open_, sets, percent), own, sets, percent)
    stars = labels.select(F.col("component").alias("u"), F.col("id").alias("v"))
    return stored(components(new.union(stars)))


def groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and _text of every row of docs."""
    rows = stored(signed(docs))
    real = rows.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    # rows of one class have one signature; the row of the smallest doc_id stands for them
    one = real.groupBy("fp").agg(F.min(F.struct("doc_id", "_text", "n", "s0", "s1", "keys", "sketch")).alias("k")).select("fp", "k.*")
    # a doc_id may have several classes, so they go by numbers of their own, written once
    classes = stored(one.withColumn("id", F.monotonically_increasing_id()))
    found = links(docs, classes, percent)
    own = classes.select("fp", "id", "doc_id").join(found, "id", "left").select("fp", "doc_id", F.coalesce("component", "id").alias("g"))
    least = own.groupBy("g").agg(F.min("doc_id").alias("c"))
    of_class = own.join(least, "g").select("fp", "c")
    told = rows.select("doc_id", "_text", "n", "fp").join(of_class, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return told.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        "_text",
    )


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that stand for their group, with all their columns; of repeated rows all stay."""
    kept = groups(docs, percent).where("kept").select(F.col("doc_id").alias("_id"), "_text").distinct()
    return keep_rows(docs, kept)
