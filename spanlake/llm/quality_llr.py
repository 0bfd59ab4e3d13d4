"""Quality rules by the log-likelihood ratio of hashed n-grams, as column functions only.

Words and pairs of neighbouring words are hashed into BUCKETS. Two multinomials over the buckets are estimated with
add-one smoothing: one from the trusted documents (label quality = 1), one from all documents. A document's score is the
mean over its n-grams of log p(trusted) - log p(raw). Every document whose score is at least the bound is kept; the bound
is the highest score that still keeps `trusted_share` of the trusted documents, so the verdict is the same in every run.
One in HELD_BACK trusted documents teaches the multinomial nothing and sets the bound: a document's own n-grams would lift
it above equally good documents without a label. The raw counts cover every document; what reaches the driver is BUCKETS
rows of counts and a histogram of scores.

Base rules come first: fewer than 50 words, or more than half of the words in repeated 3-word windows, fail a document.

Defined cases: a null, empty or blank text has no words, fails the base rules and is not kept; without any trusted
document all that pass the base rules are kept; an empty table gives no rows; repeated rows count and are judged one by
one; a null doc_id is never trusted; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import stored, text_key, words

BUCKETS = 1 << 13
MIN_WORDS = 50
HELD_BACK = 4
SYMBOLS = r"[^#*$%&|<>]+"
STEP = 1000


def bucket(c: Column) -> Column:
    return F.pmod(c, F.lit(BUCKETS)).cast("int")


def pair_buckets(hashed: Column) -> Column:
    """Buckets of each word with its next one; the last word is paired with the end."""
    return F.transform(hashed, lambda h, i: bucket(F.xxhash64(h, F.get(hashed, i + 1), F.lit(2))))


def grams(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The named columns and h, the hashed words of the text."""
    return docs.select(*keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, held) of the trusted documents, one row each."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_BACK)) == 0)


def counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, trusted) over all n-grams of all documents."""
    # both sides grow with the data, so they are shuffled at any size
    hashed = grams(docs.select("doc_id", "text").join(trusted.hint("merge"), "doc_id", "left"), ["held"])
    every = hashed.select("held", F.explode(F.concat(F.transform("h", bucket), pair_buckets(F.col("h")))).alias("bucket"))
    return every.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if(~F.col("held")).alias("trusted"))


def ratios(counted: DataFrame) -> list[float] | None:
    """log p(trusted) - log p(raw) of each bucket; None without trusted n-grams."""
    raw, trusted = [1] * BUCKETS, [1] * BUCKETS
    for r in counted.collect():  # at most BUCKETS rows
        raw[r["bucket"]] += r["raw"]
        trusted[r["bucket"]] += r["trusted"]
    a, b = sum(trusted), sum(raw)
    return [math.log(t / a) - math.log(r / b) for t, r in zip(trusted, raw, strict=True)] if a > BUCKETS else None


def constant(values: list, kind: str) -> Column:
    """Bounded values as one constant, folded before the query runs."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def score_of(h: Column, table: Column) -> Column:
    """Mean log ratio over the words and pairs of a text."""
    add = lambda a, b: a + F.get(table, b)
    one = F.aggregate(F.transform(h, bucket), F.lit(0.0), add)
    return (one + F.aggregate(pair_buckets(h), F.lit(0.0), add)) / F.greatest(2 * F.size(h), F.lit(1))


def measured(docs: DataFrame, found: list[float] | None, carry: bool = False) -> DataFrame:
    """doc_id, _text, the base columns, base_failed and the score of every whole text; with carry, _row holds the row itself."""
    table = constant(found or [0.0] * BUCKETS, "array<double>")
    whole = ["_row"] if carry else []
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", "text") if carry else docs
    rows = packed.select(*whole, "doc_id", "text", words(F.col("text")).alias("w"))
    hashed = rows.select(
        *whole,
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(F.col("text")).alias("_text"),
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "").alias("lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    h, g = F.col("h"), F.col("g")
    windows = F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("k"), i.alias("i")),
    )
    sortable = hashed.select(
        *whole,
        "doc_id",
        "_text",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("g"),
        score_of(h, table).alias("score"),
    )
    # windows found twice or more are neighbours after sorting; count the words that they cover
    twice = F.filter(g, lambda x, j: F.get(g, j - 1)["k"].eqNullSafe(x["k"]) | F.get(g, j + 1)["k"].eqNullSafe(x["k"]))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return sortable.select(
        *whole,
        "doc_id",
        "_text",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        covered.cast("long").alias("n_repeat_words"),
        "score",
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def score_bound(scored: DataFrame, trusted: DataFrame, trusted_share: float) -> float:
    """The highest step of scores that keeps the share of the trusted documents that were held back."""
    good = scored.where(F.col("n_words") >= MIN_WORDS).join(trusted.where("held"), "doc_id", "left_semi")
    steps = good.groupBy(F.floor(F.col("score") * STEP).alias("s")).count().orderBy("s").collect()  # logs have a bounded range
    room = int((1 - trusted_share) * sum(r["count"] for r in steps))
    for r in steps:
        if r["count"] > room:
            return r["s"] / STEP
        room -= r["count"]
    return -math.inf


def fitted(docs: DataFrame, labels: DataFrame, trusted_share: float) -> tuple[list[float] | None, DataFrame, float]:
    """Log ratios by bucket, the stored measures of all documents, and the score bound."""
    trusted = trusted_ids(labels)
    found = ratios(counts(docs, trusted))
    scored = stored(measured(docs, found))
    return found, scored, score_bound(scored, trusted, trusted_share) if found else -math.inf


def passes(bound: float) -> Column:
    return ~F.col("base_failed") & (F.col("score") >= F.lit(bound))


def judge(docs: DataFrame, labels: DataFrame, trusted_share: float = 0.999) -> DataFrame:
    """Base columns, score and kept of every document."""
    _, scored, bound = fitted(docs, labels, trusted_share)
    return scored.withColumn("kept", passes(bound))


def keep_good(docs: DataFrame, labels: DataFrame, trusted_share: float = 0.999) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    A text is measured again where it lies: the verdict hangs on the text alone, so no row moves to meet it.
    """
    found, _, bound = fitted(docs, labels, trusted_share)
    # not deterministic to the optimizer, or the filter would be pushed below the measures, each of them written out many times over
    once = F.monotonically_increasing_id() >= 0
    return measured(docs, found, carry=True).withColumn("_kept", passes(bound) & once).where("_kept").select("_row.*")
