"""Spelling variants: words one edit apart, found by partition-and-enumerate signatures of their letter multisets.

A word's letters with multiplicity form a binary vector: dimension (letter, k) is set if the letter occurs at least k times.
One inserted or deleted code point changes one dimension, a replaced one two, so near words have Hamming distance at most
two. The dimensions are dealt to PARTS parts by a fixed hash. Vectors at distance d differ in at most d parts and
agree on some choice of PARTS - d others; a word's signatures are its projections on each such choice. Words of one length
are compared with d = 2 (a replacement, or an anagram), words whose lengths differ by one with d = 1: the length and the kind of choice belong
to the signature, and the longer word of a pair of the second kind signs with the length of the shorter. Words that share a
signature are joined on equality, and the edit distance of the two whole words decides. No near pair is missed, whatever the letters.

Words are counted per text before they are shuffled, so a word that holds a third of all occurrences is one row a
task. Signatures hold distinct words only.

Defined cases: a null or empty text has no words; a null doc_id takes part like any other (letters are dropped by the query,
not here); repeated rows count again; letters outside the pattern end a word; words of any length are compared whole; a word
without near words has no form and is its own root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import ascii_lower, stored

#: Maximal runs of these code points are words.
LETTERS = r"[A-Za-zÀ-ÿ]+"
PARTS = 6


def lowered_runs(text: Column) -> Column:
    """Words of a text, lower-cased in A-Z only, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({LETTERS})"), F.lit(1)), ascii_lower)


def counted(words: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of the words (one row each, column `word`) that are long and frequent enough."""
    long = words.where(F.char_length("word") >= min_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def projections(word: Column) -> list[Column]:
    """For each part, a hash of the dimensions (letter, k) of the word that the part holds; equal multisets hash alike."""
    # linear in the word: there are few different letters, and the k of each run up to its count
    times = lambda c: F.char_length(word) - F.char_length(F.replace(word, c, F.lit("")))
    dims = F.flatten(F.transform(F.array_distinct(F.split(word, "")), lambda c: F.transform(F.sequence(F.lit(1), times(c)), lambda k: F.xxhash64(c, k))))
    of = lambda p: F.aggregate(F.filter(dims, lambda h: F.pmod(h, F.lit(PARTS)) == p), F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(F.xxhash64(h)))
    return [of(p) for p in range(PARTS)]


def signatures(words: DataFrame) -> DataFrame:
    """(sig, side, word): side 0 for pairs of one length; 1 and 2 for the shorter and the longer word of a pair."""
    parts = words.select("word", F.char_length("word").alias("len"), *[h.alias(f"p{i}") for i, h in enumerate(projections(F.col("word")))])

    def chosen(distance: int, side: int) -> list[Column]:
        """One signature for each choice of parts that may agree."""
        length = F.col("len") - (1 if side == 2 else 0)
        return [
            F.struct(
                F.xxhash64(F.lit(distance), F.lit(n), length, *[f"p{i}" for i in kept]).alias("sig"),
                F.lit(side).alias("side"),
            )
            for n, kept in enumerate(combinations(range(PARTS), PARTS - distance))
        ]

    every = [*chosen(2, 0), *chosen(1, 1), *chosen(1, 2)]
    return parts.select("word", F.explode(F.array(*every)).alias("s")).select("s.sig", "s.side", "word")


def near_words(words: DataFrame) -> DataFrame:
    """(u, v) with u < v: every pair of the words (column `word`, distinct) at edit distance one, once."""
    signed = stored(signatures(words))
    # a signature of one word, or of one side only, makes no pair: it leaves before the join
    shared = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min("side").alias("a"), F.max("side").alias("b")).where("m > 1 AND (b = 0 OR a < b)")
    members = stored(signed.join(shared.select("sig"), "sig"))
    x, y = members.select("sig", F.col("side").alias("sx"), F.col("word").alias("x")), members.select("sig", F.col("side").alias("sy"), F.col("word").alias("y"))
    paired = ((F.col("sx") == 0) & (F.col("sy") == 0) & (F.col("x") < F.col("y"))) | ((F.col("sx") == 1) & (F.col("sy") == 2))
    near = x.join(y, "sig").where(paired & (F.levenshtein("x", "y", 1) == 1))
    return near.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def forms(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root of counted words (word, n).

    A form has at least `ratio` times its word's n, so chains of forms are short; they are followed by pointer doubling.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent, or their chains would not end")
    counts = stored(counts.select("word", "n"))
    pairs = near_words(counts)
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("near")).union(pairs.select(F.col("v").alias("word"), F.col("u").alias("near")))
    sized = both.join(counts.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    # the largest n, then the smallest word: the minimum of (-n, word); strings compare by code point
    best = sized.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("w"))).alias("b"))
    taken = -F.col("b.m") >= ratio * F.col("n")
    told = counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, F.col("b.w")).alias("form"), F.when(taken, -F.col("b.m")).alias("form_n"),
    )
    told = stored(told)
    chain = told.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:
        onward = chain.select(F.col("word").alias("to"), F.col("to").alias("next"))
        chain = stored(chain.join(onward, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if chain.where("moved").isEmpty():
            break
    return told.join(chain.select("word", F.col("to").alias("root")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_forms(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """Forms of the words of whole texts."""
    words = docs.select(F.explode(lowered_runs(F.col("text"))).alias("word"))
    return forms(counted(words, min_length, min_count), ratio)
