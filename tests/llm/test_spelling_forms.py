import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from spanlake.llm import queries, spelling_forms
from tests.llm.helpers import clashing, no_docs, odd_docs


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        by = sorted((v for v in counts if near(w, v)), key=lambda v: (-counts[v], v))
        form = by[0] if by and counts[by[0]] >= 2 * n else None
        out[w] = [form, n, len(by), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return out


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def some_counts(seed=3):
    rnd = random.Random(seed)
    counts = {}
    for _ in range(60):
        w = "".join(rnd.choice("abcéÿ÷z") for _ in range(rnd.randint(5, 9)))
        for _ in range(rnd.randint(1, 8)):  # chains of edits
            counts[w] = rnd.choice([3, 3, 4, 6, 12, 24, 48, 100])
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "q" + w[i + 1 :]])
    for i in range(40):  # a common shape: letters of few parts
        counts["aaaaa" + "abc"[i % 3] * (i // 3)] = 3 + i
    return {w: n for w, n in counts.items() if len(w) >= 5}


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def collected(df):
    return {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in df.collect()}


@pytest.mark.parametrize("parts", [3, 6])
def test_forms_equal_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(spelling_forms, "PARTS", parts)
    counts = some_counts()
    assert collected(spelling_forms.forms(clashing(table(spark, counts)))) == brute(counts)


def test_every_near_pair_comes_once(spark):
    counts = some_counts(8)
    got = [(r.u, r.v) for r in spelling_forms.near_words(table(spark, counts)).collect()]
    assert sorted(got) == sorted((a, b) for a, b in itertools.combinations(sorted(counts), 2) if near(a, b))


def test_a_long_chain_and_very_long_words(spark):
    counts = {"a" * 5 + "b" * i: 3 * 2**i for i in range(40)}  # forms lead one letter on each time
    counts |= {"x" * 60_000: 3, "x" * 59_999 + "y": 6, "x" * 59_999: 50}
    got = collected(spelling_forms.forms(table(spark, counts)))
    assert all(got["a" * 5 + "b" * i][4] == "a" * 5 + "b" * 39 for i in range(40))
    assert got["x" * 60_000][4] == "x" * 59_999 == got["x" * 59_999 + "y"][0]


def test_odd_rows(spark):
    got = collected(spelling_forms.spelling_forms(odd_docs(spark), min_count=2))
    assert {w for w in got if "x" not in w} == {"quick", "brown", "jumps"} and got["quick"] == [None, 3, 0, None, "quick"]
    assert spelling_forms.spelling_forms(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        spelling_forms.forms(table(spark, {"aaaaa": 3}), ratio=1)


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    vocab = ["Planet", "plant", "garçon", "stone", "stoné", "ÀÉÎõü", "hot"]
    docs = [(d, " ".join(rnd.choice(vocab) for _ in range(120)) + "-tail") for d in range(60)] + [(99, None), (100, ""), (7, "stone " * 2000)]
    clashing(spark.createDataFrame(docs, "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    counts, dropped = Counter(), 0
    for d, t in docs:
        for w in map(lower, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{d}:{w}".encode())
            if h % 97 == 0:
                w, dropped = w[: h % len(w)] + w[h % len(w) + 1 :], dropped + 1
            if len(w) >= 5:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    assert dropped
    assert collected(queries.op13_spelling_forms(spark, str(tmp_path))) == brute(counts)
