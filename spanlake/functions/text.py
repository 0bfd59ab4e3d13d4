"""Scalar text expressions: labels, narrations, answers, captions, tokens."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.functions.vectors import bound

# fixed values: the ASCII punctuation characters
PUNCTUATION = string.punctuation


def _words(s: Column) -> Column:
    """Whitespace tokens without empty ones."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")


def squeeze(s: Column) -> Column:
    return F.array_join(_words(s), " ")


def drop_punctuation(s: Column) -> Column:
    return F.translate(s, PUNCTUATION, "")


# ---- labels and narrations -----------------------------------------------------------------


def clean_label(s: Column) -> Column:
    return F.translate(F.replace(s, F.lit("/"), F.lit("or")), "_", " ")


def clean_label_words(s: Column, mode: str = "short") -> Column:
    """Spaced label; long also drops brackets, quotes and commas and writes out abbreviations."""
    out = F.translate(F.replace(s, F.lit("/"), F.lit(" or ")), "_", " ")
    if mode == "short":
        return out
    if mode != "long":
        raise ValueError(f"unknown mode {mode}")
    out = F.translate(F.translate(out, "()", "  "), '",', "")
    # fixed values: the written-out forms
    for old, new in (("nail-gun", "nail gun"), ("e.g.", "for example"), ("eg.", "for example")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def clean_narration(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), r"(?i)^#c c", "The camera wearer")


def clock_seconds(s: Column) -> Column:
    """hh:mm:ss.ff as seconds."""
    p = F.split(s, ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def narration_time(stamp: Column, start: Column, stop: Column) -> Column:
    """Narration time if known, else the middle of start and stop, all as hh:mm:ss.ff."""
    return F.coalesce(clock_seconds(stamp), (clock_seconds(start) + clock_seconds(stop)) / 2)


def source_partition(video_id: Column) -> Column:
    """Which recording set a video belongs to: ids like P01_1xx form the 100 set, others the 55 set."""
    return F.when(video_id.rlike(r"^P\d\d_1\d\d"), "100").otherwise("55")


def participant(video_id: Column) -> Column:
    return F.split(video_id, "_")[0]


def frame_key(video: Column, idx: Column) -> Column:
    return F.concat_ws("|", video.cast("string"), idx.cast("string"))


def frame_key_parts(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, r"\|")
    return parts[0], parts[1].cast("int")


# ---- answers and captions ------------------------------------------------------------------


def normalize_answer(s: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    return squeeze(F.regexp_replace(drop_punctuation(F.lower(s)), r"(?U)\b(a|an|the)\b", " "))


def strip_punct_tokens(s: Column) -> Column:
    """Drop the space-separated tokens made of Unicode punctuation only; empty tokens count as such."""
    return F.array_join(F.filter(F.split(s, " "), lambda t: ~t.rlike(r"^\p{P}*$")), " ")


def char_tokens(s: Column) -> Column:
    """Characters separated by spaces, a space written as U+2581."""
    return F.array_join(F.filter(F.split(F.translate(s, " ", "▁"), ""), lambda c: c != ""), " ")


def parse_answers(s: Column) -> Column:
    """"score|!+answer&&score|!+answer" as a map answer -> score; of a repeated answer the last one counts."""
    pairs = F.transform(F.split(s, "&&"), lambda x: F.split(x, r"\|!\+"))
    size = F.size(pairs)
    last = F.filter(
        pairs,
        lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(size - i - 1, F.lit(0))), lambda y: y[1] == x[1]),
    )
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x[1].alias("k"), x[0].cast("double").alias("v"))))


def best_answer(s: Column) -> Column:
    """Answer with the largest score, ties to the larger text."""
    pairs = F.transform(F.split(s, "&&"), lambda x: F.split(x, r"\|!\+"))
    return F.array_max(F.transform(pairs, lambda x: F.struct(x[0].cast("double").alias("v"), x[1].alias("k"))))["k"]


def clean_caption(s: Column, n: int) -> Column:
    return F.array_join(F.slice(_words(drop_punctuation(s)), 1, n), " ")


def clean_references(s: Column) -> Column:
    """Several captions joined by &&, each without punctuation and trimmed."""
    return F.array_join(F.transform(F.split(squeeze(s), "&&"), lambda c: F.trim(drop_punctuation(c))), "&&")


def clean_question(s: Column, n: int, person: bool = False) -> Column:
    """Lower case without leading punctuation, - and / as spaces, single spaces, first n words."""
    out = F.regexp_replace(F.lower(s), r"^[,.!?*#:;~]+", "")
    out = F.translate(out, "-/", "  ")
    if person:
        out = F.replace(out, F.lit("<person>"), F.lit("person"))
    out = F.regexp_replace(out, r"(?U)\s{2,}", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\n+\z", ""), r"^ +| +\z", "")
    return F.array_join(F.slice(F.split(out, " "), 1, n), " ")


def clean_caption_lower(s: Column, n: int) -> Column:
    return clean_question(s, n, person=True)


def render_pair_prompt(s1: Column, s2: Column, max_words: int) -> Column:
    """Question whether the first text implies the second, both lower-cased and cut to max_words."""
    a, b = (F.array_join(F.slice(_words(F.lower(s)), 1, max_words), " ") for s in (s1, s2))
    return F.format_string(' can text1 " %s " imply text2 " %s "?', a, b)


def pair_label(label: Column) -> Column:
    """0, 1, 2 as maybe, yes, no; anything else is an error."""
    s = label.cast("string")
    return (
        F.when(s == "0", "maybe").when(s == "1", "yes").when(s == "2", "no")
        .otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(s, F.lit("null")))))
    )


def letters(s: Column) -> Column:
    """Words as letters: "ab c" becomes "a b | c |"."""
    chars = F.array_join(F.filter(F.split(F.translate(s, " ", "|"), ""), lambda c: c != ""), " ")
    return F.concat(chars, F.lit(" |"))


# ---- token arrays --------------------------------------------------------------------------


def append_token(tokens: Column, token) -> Column:
    return F.concat(tokens, F.array(F.lit(token)))


def prepend_token(tokens: Column, token) -> Column:
    return F.concat(F.array(F.lit(token)), tokens)


def strip_token(tokens: Column, token) -> Column:
    """Remove the token from both ends, as often as it occurs there."""

    def cut_ends(held: Column) -> Column:
        stays = F.transform(held, lambda x: x != F.lit(token))

        def between(b: Column) -> Column:
            first, after = F.array_position(b, True).cast("int"), F.array_position(F.reverse(b), True).cast("int")
            return F.slice(held, F.greatest(first, F.lit(1)), F.when(first == 0, 0).otherwise(F.size(b) - after - first + 2))

        return bound(stays, between)

    # the tokens are computed once and marked in one pass
    return bound(tokens, cut_ends)


def replace_tokens(tokens: Column, mapping: dict) -> Column:
    if not mapping:
        return tokens

    def one(x: Column) -> Column:
        out = None
        for k, v in mapping.items():
            out = F.when(x == F.lit(k), F.lit(v)) if out is None else out.when(x == F.lit(k), F.lit(v))
        return out.otherwise(x)

    return F.transform(tokens, one)


def offset_tokens(tokens: Column, by: int) -> Column:
    return F.transform(tokens, lambda x: x + by)


def roll_tokens(tokens: Column, by: int) -> Column:
    """Rotate right by `by` positions."""
    n = F.size(tokens)
    k = F.when(n > 0, F.pmod(F.lit(by), F.greatest(n, F.lit(1)))).otherwise(0)
    return F.concat(F.slice(tokens, n - k + 1, k), F.slice(tokens, 1, n - k))


def concat_sentences(*tokens: Column) -> Column:
    return F.concat(*tokens)


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """All n-grams of a token array as joined strings.

    Each order extends the one below by a shifted copy of the tokens, so the work is linear in the
    text; cutting out every n-gram by itself would copy the whole array each time.
    """
    grams = tokens
    size = F.size(tokens)
    for k in range(2, n + 1):
        keep = F.greatest(size - k + 1, F.lit(0))
        grams = F.zip_with(
            F.slice(grams, 1, keep), F.slice(tokens, k, keep), lambda a, b: F.concat(a, F.lit(sep), b)
        )
    return grams


def remap_label(label: Column, mode: str) -> Column:
    """Segmentation label under one of the fixed label tables."""
    keep = label.cast("int")

    def above(n: int) -> Column:
        return F.when(keep > n, 0).otherwise(keep)

    # fixed values: the label tables
    if mode == "allhands":
        return F.when(keep.isin(1, 2), 1).otherwise(0)
    if mode == "twohands":
        return above(2)
    if mode == "handobj1":
        return above(5)
    if mode == "obj1":
        return F.when(keep.between(3, 5), keep - 2).when((keep <= 2) & (keep >= 1), 0).otherwise(above(5))
    if mode == "obj2":
        return F.when(keep.between(3, 8), keep - 2).when(keep.between(1, 2), 0).otherwise(keep)
    if mode == "foreground":
        return F.when(keep > 0, 1).otherwise(keep)
    raise ValueError(f"unknown mode {mode}")
