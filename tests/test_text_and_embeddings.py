"""Text functions and metrics, embeddings and samplers against plain Python and numpy."""

import collections
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.functions import vectors as V
from spanlake.operators import corpus as C
from spanlake.operators import embeddings as E
from spanlake.operators import sampling as S
from spanlake.operators import sequence as Q
from spanlake.operators import text_metrics as M


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("o")).first().o


@pytest.mark.parametrize("s", ["#C C drops a plate", "#C C drops a plate ", "#c C drops a plate", "#C c drops a plate"])
def test_clean_narration(spark, s):
    assert one(spark, T.clean_narration, s) == "The camera wearer drops a plate"


def test_small_text_functions(spark):
    assert one(spark, T.normalize_answer, "The  Cat, a (big) an!") == "cat big"
    assert one(spark, T.letters, "ab c") == "a b | c |"
    assert one(spark, lambda c: T.clean_question(c, 3), "?? Is-it a  red/car\n") == "is it a"
    assert one(spark, T.parse_answers, "0.6|!+yes&&1.0|!+no") == {"yes": 0.6, "no": 1.0}
    assert one(spark, T.best_answer, "0.6|!+yes&&1.0|!+no") == "no"
    assert one(spark, T.strip_punct_tokens, "a , b ... c!") == "a b c!"
    assert one(spark, T.clock_seconds, "01:02:03.50") == 3723.5
    roll = spark.range(1).select(T.roll_tokens(F.array(F.lit(1), F.lit(2), F.lit(3)), 1).alias("o")).first().o
    assert roll == [3, 1, 2]


def test_pair_label_refuses_others(spark):
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([(7,)], "s int").select(T.pair_label(F.col("s"))).collect()


def test_oov_round_trip_and_error(spark):
    df = spark.createDataFrame([(1, "a x b x", "x c a")], "id long, src string, tgt string")
    vocab = spark.createDataFrame([("a",), ("b",)], "symbol string")
    enc = C.encode_oov(df, vocab).first()
    assert (enc.src, enc.tgt) == ("a <unk-1> b <unk-1>", "<unk-1> c a")
    back = spark.createDataFrame([("a x b x", "<unk-1> c a")], "s string, t string")
    assert back.select(C.decode_oov(F.col("s"), F.col("t")).alias("o")).first().o == "x c a"
    with pytest.raises(Exception, match="outside the source"):
        spark.createDataFrame([("a", "<unk-9>")], "s string, t string").select(C.decode_oov(F.col("s"), F.col("t"))).collect()


def test_vocabulary_order(spark):
    df = spark.createDataFrame([(l,) for l in ("A B C D", "B C D", "C D", "D")], "t string")
    rows = C.build_vocab(df, F.split("t", " "), 4).orderBy("symbol_id").collect()
    assert [(r.symbol, r.symbol_id) for r in rows] == [("D", 4), ("C", 5), ("B", 6), ("A", 7)]


def test_bitext_filter_refuses_empty_side(spark):
    df = spark.createDataFrame([("a b", "c"), ("", "c"), ("a b c d", "e")], "src string, tgt string")
    assert [r.src for r in C.filter_bitext(df, ratio=2.0).collect()] == ["a b"]


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], p + 1 if x == y else max(d[j], d[j - 1])
    return d[-1]


def test_edit_distance_and_lcs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randrange(0, 30))), " ".join(rng.choices("abcdf", k=rng.randrange(1, 30)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, pred string, ref string")
    got = {r.id: (r.distance, r.ref_len) for r in M.error_counts(df).collect()}
    assert got == {i: (edit(p.split(), r.split()), len(r.split())) for i, p, r in rows}
    rl = {r.id: r.recall for r in M.rouge(df).where("metric = 'rougeL'").collect()}
    assert all(abs(rl[i] - lcs(p.split(), r.split()) / len(r.split())) < 1e-12 for i, p, r in rows)


def test_bleu_of_identical_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "f g h i", "f g h i")], "id long, pred string, ref string")
    assert abs(M.corpus_bleu(df).first().bleu - 100) < 1e-9
    assert abs(M.chrf(df).first().chrf - 100) < 1e-9
    assert M.score("exact_match", df).first().em == 1.0


def test_pairwise_bleu_equals_pairs(spark):
    rng = random.Random(3)
    hyps = [(s, h, " ".join(rng.choices("abc", k=rng.randrange(5, 12)))) for s in range(4) for h in range(4)]
    df = spark.createDataFrame(hyps, "id long, hyp_id long, text string")
    got = M.pairwise_bleu(df).first().pairwise_bleu
    m, t = [0] * 4, [0] * 4
    for s, i, a in hyps:
        for s2, j, b in hyps:
            if s == s2 and i != j:
                for n in range(1, 5):
                    ga = collections.Counter(tuple(a.split()[k:k + n]) for k in range(len(a.split()) - n + 1))
                    gb = collections.Counter(tuple(b.split()[k:k + n]) for k in range(len(b.split()) - n + 1))
                    m[n - 1] += sum((ga & gb).values())
                    t[n - 1] += sum(ga.values())
    want = 100 * np.exp(np.mean([np.log(x / y) for x, y in zip(m, t)])) if min(m) else 0.0
    assert abs(got - want) < 1e-6


@pytest.mark.parametrize("pivots", [1, 6])
def test_knn_equals_brute_force(spark, pivots):
    rng = np.random.default_rng(pivots)
    x, y = rng.normal(size=(60, 8)), rng.normal(size=(150, 8))
    y[100:] = y[0] + rng.normal(size=(50, 8)) * 0.01  # a dense cell
    dx = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "x_id long, embedding array<double>")
    dy = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "y_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in E.knn_join(dx, dy, 5, block_rows=16, pivots=pivots).collect():
        got[r.x_id].append((-r.sim, r.y_id))
    sim = x @ y.T
    for i in range(60):
        want = sorted((-sim[i, j], j) for j in range(150))[:5]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_similar_partner_skips_equal_rows(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(v)], "id long, embedding array<double>")
    out = {r.id: r.partner for r in E.similar_partner(df, 1, 1).collect()}
    assert out[0] == 2 and out[1] == 2


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)) * np.array([10, 5, 1, 0.1, 0.01])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    fit = E.pca_fit(df)
    lam = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    cum = np.cumsum(lam) / lam.sum()
    assert fit.k == int(np.flatnonzero(cum >= 0.95)[0]) + 1
    assert np.allclose(fit.ratio, (lam / lam.sum())[: fit.k])
    w = np.array([r.reduced for r in E.pca_whiten(df, 3).collect()])
    assert np.allclose(np.cov(w.T), np.eye(3), atol=1e-6)
    km = E.kmeans_fit_assign(df.withColumn("clip_id", F.col("id") % 10), 3, 0.9, 1)
    assert km.count() == 300 and E.inertia(km).first().inertia < (x**2).sum(1).mean()


@pytest.mark.parametrize("batch_rows,steps", [(10_000, 15), (40, 30)])
def test_mini_batch_clusters(spark, batch_rows, steps):
    rng = np.random.default_rng(1)
    true = rng.normal(0, 10, (4, 6))
    x = np.concatenate([c + rng.normal(0, 0.3, (100, 6)) for c in true])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    centers = E.kmeans_fit(df, 4, 3, batch_rows=batch_rows, steps=steps)
    again = E.kmeans_fit(df.repartition(7), 4, 3, batch_rows=batch_rows, steps=steps)
    assert np.allclose(centers, again, atol=1e-9)  # by seed alone
    assert all(((centers - c) ** 2).sum(1).min() < 0.1 for c in true)
    got = {r.id: (r.cluster, r.sq_dist) for r in E.assign_centers(df, centers).collect()}
    d = ((x[:, None] - centers[None]) ** 2).sum(2)
    assert all(got[i][0] == d[i].argmin() and abs(got[i][1] - d[i].min()) < 1e-9 for i in range(len(x)))
    n, s, q = E.center_sums(df, centers[None], "embedding")
    assert np.allclose(s[0] / n[0][:, None], [x[d.argmin(1) == c].mean(0) for c in range(4)]) and np.allclose(q, d.min(1).sum())
    one = E.kmeans_fit(df.limit(1), 2, 0)
    assert np.allclose(one[0], one[1])


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(200).select(F.col("id").alias("video_uid"), (F.col("id") % 13 + 1).alias("n_actions"))
    a = {(r.video_uid, r.split) for r in S.three_way_split(df.repartition(2), 0.6, 0.2, 3).collect()}
    b = {(r.video_uid, r.split) for r in S.three_way_split(df.repartition(9), 0.6, 0.2, 3).collect()}
    assert a == b and len(a) == 200 and {s for _, s in a} == {"train", "val", "test"}
    r = S.reservoir_split(df, 30, 1, "video_uid").groupBy("part").count().collect()
    assert {x.part: x["count"] for x in r} == {"sample": 30, "remainder": 170}
    pos = [r.pos for k in range(7) for r in S.padded_shard(df, k, 7, 1, "video_uid").collect()]
    assert sorted(pos) == list(range(203))


def test_resampling_frequencies(spark):
    df = spark.createDataFrame([(0, 4.0), (1, 2.0), (2, 7.0), (3, 1.5)], "id long, w double")
    n = collections.Counter(r.id for r in S.resample(df, "id", "w", 1500.0, True, 1, 0).collect())
    total = sum(n.values())
    assert total == 6000
    for i, w in enumerate((4, 2, 7, 1.5)):
        assert abs(n[i] / total - w / 14.5) < 0.02
    assert {r.id for r in S.resample(df, "id", "w", 0.5, False, 1, 0).collect()} <= {0, 1, 2, 3}


def test_constraints_are_in_order_and_apart(spark):
    words = [f"w{i}" for i in range(30)]
    df = spark.createDataFrame([(i, " ".join(words)) for i in range(20)] + [(99, "a b")], "id long, tgt string")
    for r in S.sample_constraints(df, 3, 4, 5).collect():
        flat = [int(w[1:]) for c in r.constraints for w in c.split()] if r.id != 99 else []
        assert flat == sorted(set(flat))
        assert r.id != 99 or r.constraints == []


def test_edit_distance_equals_the_table_of_prefixes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 90))) for _ in range(240)]

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    a, b = texts[::2], texts[1::2]
    assert M.edit_distance.func(pd.Series(a), pd.Series(b)).tolist() == [slow(x, y) for x, y in zip(a, b)]


def test_array_functions_stay_linear(spark):
    def seconds(make):
        make().write.format("noop").mode("overwrite").save()
        t0 = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    def soft(n):
        a = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i + F.col("id")).cast("double") / n)
        return spark.range(200).select(V.softmax(a).alias("s"))

    def masked(n):
        tokens = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string"))
        return Q.mask_tokens(spark.range(20).select("id", tokens.alias("tokens")), "m", 0.2, 1, 0.0, 0.0, ident="id", tokens="tokens")

    for make, n in ((soft, 500), (masked, 1000)):
        assert seconds(lambda: make(4 * n)) < 1 + 8 * seconds(lambda: make(n))


def test_chrf_equals_counted_grams(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab cé\n\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(texts[::2], texts[1::2]))] + [(99, None, "abc")]
    p, r = [], []
    for k in range(1, 7):
        m = n_p = n_r = 0
        for _, a, b in pairs:
            x, y = ("".join(s for s in (t or "") if s not in " \n") for t in (a, b))
            g, h = (collections.Counter(z[i : i + k] for i in range(len(z) - k + 1)) for z in (x, y))
            m, n_p, n_r = m + sum((g & h).values()), n_p + sum(g.values()), n_r + sum(h.values())
        p.append(m / n_p)
        r.append(m / n_r)
    p, r = sum(p) / 6, sum(r) / 6
    got = M.chrf(spark.createDataFrame(pairs, "id long, pred string, ref string")).first().chrf
    assert abs(got - 100 * 5 * p * r / (4 * p + r)) < 1e-9


def _brute_multi_ref(turns):
    """refs_covered, best_ref_bleu and loo_bleu of even turns against odd ones, pair by pair."""
    from collections import Counter
    from math import exp, log

    grams = lambda w, o: Counter(tuple(w[i : i + o]) for i in range(len(w) - o + 1))
    clipped = lambda a, b: sum(min(c, b[g]) for g, c in a.items())

    def corpus(rows):  # (hypothesis, clip per order, reference length)
        m = [sum(clipped(grams(h, o), c[o - 1]) for h, c, _ in rows) for o in range(1, 5)]
        t = [sum(max(len(h) - o + 1, 0) for h, _, _ in rows) for o in range(1, 5)]
        return 0.0 if min(m) == 0 else 100 * exp(sum(log(x / y) for x, y in zip(m, t)) / 4) * min(1, exp(1 - sum(n for _, _, n in rows) / t[0]))

    def sentence(h, r):
        s = 0.0
        for o in range(1, 5):
            m, t = clipped(grams(h, o), grams(r, o)), max(len(h) - o + 1, 0)
            s += log((m + 1) / (t + 1)) if o > 1 else log((m or 0.5) / t)
        return exp(s / 4) * min(1, exp(1 - len(r) / len(h)))

    covered, best, held = [], [], {}
    for conv in turns.values():
        refs = {i: w for i, w in conv.items() if i % 2}
        taken = set()
        for h in (w for i, w in conv.items() if i % 2 == 0 and refs):
            r = max(refs, key=lambda r: (round(sentence(h, refs[r]), 9), -r))
            taken.add(r)
            best.append((h, [grams(refs[r], o) for o in range(1, 5)], len(refs[r])))
            for out in refs:
                rest = [w for i, w in refs.items() if i != out]
                if rest:
                    clip = [Counter() for _ in range(4)]
                    for w in rest:
                        for o in range(4):
                            clip[o] |= grams(w, o + 1)
                    held.setdefault(out, []).append((h, clip, min((abs(len(w) - len(h)), len(w)) for w in rest)[1]))
        covered += [len(taken)] if refs else []
    return sum(covered) / len(covered), corpus(best), sum(map(corpus, held.values())) / len(held)


def test_multi_ref_bleu_reads_every_turn(spark, tmp_path):
    import random

    import __spark_entry__ as entry

    rnd = random.Random(3)
    turns = {c: {i: [rnd.choice("abcd") for _ in range(rnd.randint(4, 14))] for i in range(n)} for c, n in enumerate((1, 2, 3, 5, 9, 12))}
    rows = [(c, i, "user", " ".join(w)) for c, conv in turns.items() for i, w in conv.items()]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = entry.queries()["multi_ref_bleu"](spark, str(tmp_path)).first()
    assert tuple(got[c] for c in ("refs_covered", "best_ref_bleu", "loo_bleu")) == pytest.approx(_brute_multi_ref(turns), abs=2e-6)
