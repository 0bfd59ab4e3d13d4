"""Operators over packed batches of texts: CIDEr against brute force, tokens, pairs of texts, disk."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.functions.text import _words
from spanlake.operators import corpus as C
from spanlake.operators import text_metrics as M
from spanlake.plans import gram_batches as G
from spanlake.plans import row_batches as R
from spanlake.sources.tables import Tables


def shuffle_bytes(spark):
    """Bytes of the shuffle files that lie on disk just now."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = [os.path.join(at, f) for d in dirs for at, _, own in os.walk(d) for f in own if f.startswith("shuffle_")]
    return sum(os.path.getsize(f) for f in files)


def grams(texts, n):
    found = Counter()
    for t in texts:
        w = t.split()
        found.update((k, *w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1))
    return found


def cider_by_hand(hyps, refs, n, sigma):
    """hyps: (id, text); refs: (id, ref_id, text)."""
    h, r = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for i, t in hyps:
        h[i].append(t)
    for i, j, t in refs:
        r[i][j].append(t)
    df = Counter(g for own in r.values() for g in {g for t in own.values() for g in grams(t, n)})
    out = {}
    for i in h:
        a, scores = grams(h[i], n), []
        for texts in r[i].values() if i in r else ():
            b = grams(texts, n)
            if not a and not b:
                continue
            w = {g: math.log(len(r)) - math.log(max(df[g], 1)) for g in a | b}
            total = 0
            for k in range(1, n + 1):
                dot = sum((a[g] if sigma is None else min(a[g], b[g])) * b[g] * w[g] ** 2 for g in a if len(g) == k + 1)
                na, nb = (math.sqrt(sum((x[g] * w[g]) ** 2 for g in x if len(g) == k + 1)) for x in (a, b))
                total += dot / (na * nb) if na and nb else dot
            if sigma is not None:
                total *= math.exp(-(sum(a[g] - b[g] for g in a | b if len(g) == 3) ** 2) / (2 * sigma**2))
            scores.append(total / n * 10)
        out[i] = sum(scores) / len(scores) if scores else 0.0
    return out


def caption_tables(spark, seed=3):
    rng = random.Random(seed)

    def text():
        return " ".join(rng.choices("abcdefgh", k=rng.choice([0, 1, 2, 5, 9, 30])))

    refs = [(i, j, text()) for i in range(40) for j in range(rng.randrange(4))] + [(1, 0, "a b a b"), (1, 0, "c d"), (99, 0, "a b c")]
    hyps = [(i, text()) for i in range(42)] + [(1, "a b c d"), (1, "a b")]
    return hyps, refs


@pytest.mark.parametrize("sigma", [None, 6.0, 1.0])
def test_cider_equals_brute_force(spark, sigma):
    hyps, refs = caption_tables(spark)
    out = M.cider(spark.createDataFrame(hyps, "id long, text string"), spark.createDataFrame(refs, "id long, ref_id int, text string"), 4, sigma)
    got = {r.id: r.cider for r in out.collect()}
    want = cider_by_hand(hyps, refs, 4, sigma)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("sigma", [None, 6.0])
def test_cider_batches_and_paired_rows(spark, sigma, monkeypatch):
    """References inside the row, in batches of few words and pairs compared both ways, give the same."""
    for name, value in (("BATCH_WORDS", 60), ("PAIR_GRAMS", 16), ("LONG_PAIR", 20), ("LEAST_GRAMS", 8)):
        monkeypatch.setattr(G, name, value)
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.choice([0, 1, 3, 8, 20]))) for _ in range(60)]
    rows = [(f"k{i}", rng.choice(texts), [rng.choice(texts) for _ in range(rng.randrange(4))]) for i in range(150)]
    out = M.cider(spark.createDataFrame(rows, "id string, text string, ref_id array<string>"), None, 3, sigma)
    got = {r.id: r.cider for r in out.collect()}
    want = cider_by_hand([(i, t) for i, t, _ in rows], [(i, j, t) for i, _, r in rows for j, t in enumerate(r)], 3, sigma)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("metric", [M.cider, M.cider_d])
def test_cider_leaves_few_shuffle_files(spark, metric):
    """n-grams do not move as rows: those took 40 times the bytes of the texts."""
    rng = np.random.default_rng(1)
    text = [" ".join(map(str, w)) for w in rng.integers(1000, 9000, (400, 500))]
    rows = spark.createDataFrame([(i, text[i], text[i + 1]) for i in range(399)], "id long, pred string, ref string").repartition(4)
    hyps, refs = rows.select("id", F.col("pred").alias("text")), rows.select("id", F.lit(0).alias("ref_id"), F.col("ref").alias("text"))
    before = shuffle_bytes(spark)
    out = metric(hyps, refs)
    assert out.agg(F.sum("cider")).first()[0] > 0
    assert shuffle_bytes(spark) - before < 5 * sum(map(len, text))


def test_words_equal_the_jvm(spark):
    points = [c for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"x{chr(c)}" for c in points) + "x  y\x1c z"
    assert G.words(text) == spark.createDataFrame([(text,)], "t string").select(_words(F.col("t"))).first()[0]
    for t in ("", "  ", " a\tb  ", "a　b ", "a\x1fb c"):
        assert G.words(t) == spark.createDataFrame([(t,)], "t string").select(_words(F.col("t"))).first()[0]


def test_numbers_come_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        for top in (0, 40, 60):
            x = rng.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(top)
            x[: n // 3] = x[n // 3 : 2 * (n // 3)]
            assert (x[G.ascending(x)] == np.sort(x)).all()
            assert (G.from_planes(G.to_planes(x), n) == x).all() and (G.from_gaps(G.to_gaps(np.sort(x)), n) == np.sort(x)).all()


def test_text_pairs_move_each_text_once(spark, tmp_path):
    rng = random.Random(7)
    docs = [(i * 3, rng.choice(["s1", "s2", "s3", None]) if i < 150 else "s1", f"text {i}" if i % 11 else None) for i in range(300)] + [(7, "alone", "t")]
    rng.shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    texts = Tables(spark, str(tmp_path)).texts()
    want = set()
    for s in {d[1] for d in docs}:
        own = sorted(d for d in docs if d[1] == s) if s is not None else sorted((d for d in docs if d[1] is None), key=lambda d: d[0])
        want |= {(a[0], a[2], b[2]) for a, b in zip(own, own[1:]) if b[2] is not None}
    rows = [tuple(r) for r in texts.collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = Tables(spark, str(tmp_path)).texts()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Exchange") == 1
    spark.createDataFrame([], "doc_id long, source string, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert Tables(spark, str(tmp_path / "none")).texts().collect() == []


def coded_by_hand(rows, vocab):
    for i, s, t in rows:
        first, s, t = {}, (s or "").split(), (t or "").split()
        for at, w in enumerate(s):
            if w not in vocab:
                first.setdefault(w, f"<unk-{at}>")
        yield i, " ".join(first.get(w, w) for w in s), " ".join(first.get(w, w) for w in t)


@pytest.mark.parametrize("batch_bytes", [1 << 20, 100])
def test_oov_in_batches(spark, monkeypatch, batch_bytes):
    """Batches of one row and of many, missing texts, kept columns, and the way back."""
    monkeypatch.setattr(R, "BATCH_BYTES", batch_bytes)
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "b", "x", "yy", "zzz", "w"], k=rng.choice([0, 1, 4, 30]))) for _ in range(30)] + ["  a\t x\nx ", None]
    rows = [(i, rng.choice(texts), rng.choice(texts)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, s string, t string").withColumn("plain", F.col("s"))
    vocab = spark.createDataFrame([("a",), ("b",), ("a",)], "symbol string")
    got = C.encode_oov(df, vocab, "id", "s", "t", keep=("plain",)).orderBy("id").collect()
    assert [(r.id, r.s, r.t) for r in got] == list(coded_by_hand(rows, {"a", "b"}))
    assert [r.plain for r in got] == [s for _, s, _ in rows]
    back = C.encode_oov(df, vocab, "id", "s", "t", keep=("plain",)).where("plain IS NOT NULL").select("id", C.decode_oov(F.col("plain"), F.col("t")).alias("o"))
    assert {r.id: r.o for r in back.collect()} == {i: " ".join((t or "").split()) for i, s, t in rows if s is not None}
    none = C.encode_oov(df.select("id", F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("t")), vocab, "id", "s", "t").collect()
    assert len(none) == 80 and {(r.s, r.t) for r in none} == {("", "")}


def test_oov_leaves_few_bytes(spark):
    """Stored rows and shuffle files together; whole texts were stored and then shuffled before."""
    rng = np.random.default_rng(1)
    text = [" ".join(map(str, w)) for w in rng.integers(1000, 9000, (400, 500))]
    df = spark.createDataFrame([(i, text[i], text[i + 1]) for i in range(399)], "id long, src string, tgt string").repartition(4)

    def used():
        at = spark.sparkContext.getCheckpointDir()
        return shuffle_bytes(spark) + sum(os.path.getsize(os.path.join(d, f)) for d, _, own in os.walk((at or "/none").removeprefix("file:")) for f in own)

    before = used()
    out = C.encode_oov(df, spark.range(1000, 9000, 2).select(F.col("id").cast("string").alias("symbol")))
    assert out.agg(F.sum(F.length("src") + F.length("tgt"))).first()[0] > 0
    assert used() - before < 2 * sum(map(len, text))
