import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import near_dedup, vp_search
from spanlake.llm.components import components
from tests.llm.helpers import clashing, no_docs, odd_docs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())


def shingle_set(text):
    w = words(text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    root = {d: d for d in texts}
    changed = True
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def family(seed=4):
    """Copies, near copies, chains and unrelated texts with shared passages."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    texts, n = {}, 0
    passage = " ".join(rnd.choice(vocab) for _ in range(25))
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(40, 120))]
        for _ in range(rnd.randint(1, 12)):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            texts[n] = " ".join(own)
            n += 1
        texts[n] = passage + "\n" + " ".join(rnd.choice(vocab) for _ in range(30))
        n += 1
    texts |= {n: "One two", n + 1: "ONE  two", n + 2: "", n + 3: None, n + 4: "A B C D E", n + 5: "a b c d e f"}
    return texts


def dedup(spark, texts, **options):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r for r in near_dedup.groups(clashing(df), **options).collect()}


def test_groups_equal_brute_force(spark):
    texts = family()
    got, want = dedup(spark, texts), brute_components(texts)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.kept == (r.component_id == d) and r.n_shingles == len(shingle_set(texts[d])) for d, r in got.items())


def test_hot_group_without_its_origin_is_linked(spark):
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for d in range(150):  # copies of a text that is not there, some of them linked only through others
        own = list(base)
        own[rnd.randrange(60)] = f"x{d}"
        texts[d] = " ".join(own)
    assert {d: r.component_id for d, r in dedup(spark, texts).items()} == brute_components(texts)


def test_a_group_around_one_passage_forms_no_pairs(spark):
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    texts = {d: " ".join([*passage, *(f"w{rnd.randrange(10**9)}" for _ in range(40))]) for d in range(300)}  # similarity 0.4
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = near_dedup.stored(near_dedup.full_sets(df, df.select("doc_id", near_dedup.text_key(F.col("text")).alias("_text"), F.col("doc_id").alias("id"))))
    rows = near_dedup.signed(df).select(F.col("doc_id").alias("id"), "n", "s0", "s1", F.col("doc_id").alias("c"))
    assert near_dedup.prefix_pairs(rows, sets, 75).count() == 0
    assert all(r.kept for r in dedup(spark, texts).values())


def test_prefixes_miss_no_pair(spark):
    texts = {d: t for d, t in family(8).items() if t}
    sets_of = {d: shingle_set(t) for d, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = near_dedup.stored(near_dedup.full_sets(df, df.select("doc_id", near_dedup.text_key(F.col("text")).alias("_text"), F.col("doc_id").alias("id"))))
    rows = near_dedup.signed(df).select(F.col("doc_id").alias("id"), "n", "s0", "s1", F.col("doc_id").alias("c"))
    got = {frozenset((r.u, r.v)) for r in near_dedup.prefix_pairs(rows, sets, 75).collect()}
    want = {frozenset(p) for p in itertools.combinations(texts, 2) if 100 * len(sets_of[p[0]] & sets_of[p[1]]) >= 75 * len(sets_of[p[0]] | sets_of[p[1]])}
    assert want <= got and len(got) < len(texts) ** 2 / 8


def test_links_of_real_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.component_id for r in near_dedup.groups(docs).collect()}
    sets = {d: shingle_set(t) for d, t in texts.items()}
    holders, root = {}, {d: d for d in texts}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    pairs = {p for h in holders.values() if len(h) > 1 for p in itertools.combinations(h, 2)}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(50):
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root and len(linked) > 50


def test_odd_rows_stay(spark):
    rows = near_dedup.groups(odd_docs(spark)).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert by[None].component_id is None and by[None].kept
    assert by[7].component_id == 1 and not by[7].kept
    assert all(by[d].kept and by[d].n_shingles == 0 for d in (2, 3, 4))
    assert near_dedup.groups(no_docs(spark)).count() == 0
    kept = near_dedup.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == 8


def test_copies_of_every_text_of_a_repeated_id_are_linked(spark):
    rnd = random.Random(6)
    base = [[f"t{k}_{rnd.randrange(10**6)}" for _ in range(60)] for k in range(3)]
    rows = [(5, " ".join(t)) for t in base] + [(7 + k, " ".join(t)) for k, t in enumerate(base)]
    rows += [(20 + k, " ".join([*t[:-1], "other"])) for k, t in enumerate(base)] + [(3, " ".join(["first", *base[0][1:]]))]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.groups(df).collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (20, 3, False), (5, 5, True)} | {(d, 5, False) for d in (8, 9, 21, 22)}
    texts = sorted(r.text for r in near_dedup.keep_one(df).collect())
    assert texts == sorted([rows[-1][1], rows[1][1], rows[2][1]])


def test_posterior_bound():
    least = near_dedup.least_agreements(0.75, 1e-5)
    assert (np.diff(least) >= 0).all() and 0 < least[64] < 0.75 * 64
    draw = np.random.default_rng(1)
    same = draw.random((100_000, 512)) < 0.75 + 0.25 / 16
    counts = same.cumsum(1)[:, 63::64]
    assert (counts < least[64::64]).any(1).mean() < 1e-3


@pytest.mark.parametrize("size", [20, 150, 3000])
def test_sketches_keep_similar_pairs_and_drop_others(size):
    draw = np.random.default_rng(size)
    least = near_dedup.least_agreements(0.75, near_dedup.MISS)

    def pair(similarity):
        shared = round(2 * size * similarity / (1 + similarity))
        x = draw.integers(0, 1 << 63, 2 * size - shared, np.uint64)
        return [np.unique(x[:size]), np.unique(np.concatenate([x[:shared], x[size:]]))]

    def kept(similarity, n=300):
        sides = [[near_dedup.sketch(s, near_dedup.signature(s)) for s in pair(similarity)] for _ in range(n)]
        x, y = (np.stack([np.frombuffer(p[i], np.uint8) for p in sides]) for i in (0, 1))
        return len(near_dedup.surviving(x, y, least)) / n

    assert kept(0.78) == 1.0 and kept(1.0) == 1.0
    assert kept(0.4) < 0.05
    assert size < 3000 or kept(0.6) < 0.02


@pytest.mark.parametrize("local", [True, False])
def test_components_of_paths_stars_and_rings(spark, local):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5000 + i, 5000 + (i + 1) % 50) for i in range(50)]
    edges += [(9000 + rnd.randrange(100), 9000 + rnd.randrange(100)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), local).collect()}
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "u long, v long"), local).count() == 0


def vectors(n=700, dim=12, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 3, (8, dim))
    x = centres[draw.integers(0, 8, n)] + draw.normal(0, 0.6, (n, dim))
    x[50:200] = x[50]  # a hot vector
    return {i: v for i, v in enumerate(x)}


def brute_nearest(x, k, every):
    ids = sorted(x)
    m = np.stack([x[i] for i in ids])
    out = {}
    for q in ids:
        if q % every == 0:
            d = vp_search.distances(x[q][None], m)[0]
            out[q] = sorted((float(s), i) for s, i in zip(d, ids, strict=True) if i != q)[:k]
    return out


def table(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("shard_rows,query_block", [(8192, 1024), (60, 5)])
def test_search_with_factor_one_is_exact(spark, shard_rows, query_block):
    x = vectors()
    rows = vp_search.nearest(table(spark, [(i, v.tolist()) for i, v in x.items()]), 10, 20, 1.0, shard_rows, query_block).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == brute_nearest(x, 10, 20)


def degenerate(kind, n=900):
    """Vectors whose distances tie or differ in their last digits."""
    draw = np.random.default_rng(4)
    if kind == "line":
        return draw.integers(1, 400, n)[:, None] * np.array([0.1, 0.7, 0.3])
    if kind == "sphere":  # all equally far from the first
        x = draw.normal(size=(n, 3))
        return np.concatenate([np.full((1, 3), 1e-9), x[1:] / np.sqrt((x[1:] ** 2).sum(1))[:, None]])
    return draw.integers(0, 3, (n, 3)) / 10 + 0.1  # few different ones, repeated


@pytest.mark.parametrize("kind", ["line", "sphere", "repeated"])
def test_search_finds_every_tie(spark, kind):
    x = degenerate(kind)
    want = brute_nearest(dict(enumerate(x)), 10, 1)
    at, near, _ = vp_search.VpTree(x).search(x, np.arange(len(x)), np.arange(len(x)), 10, 1.0, np.full(len(x), np.inf))
    assert all([(float(d), int(i)) for d, i in zip(near[q], at[q], strict=True)] == want[q] for q in want)
    rows = vp_search.nearest(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), 10, 9, 1.0, 100, 20).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == {q: w for q, w in want.items() if q % 9 == 0}


def test_relaxed_search_over_shards_keeps_recall(spark):
    x = vectors(3000, 6)
    rows = vp_search.nearest(table(spark, [(i, v.tolist()) for i, v in x.items()]), 10, 20, 1.5, 200, 50).collect()
    want = brute_nearest(x, 10, 20)
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in rows)
    assert len(rows) == 10 * len(want) and hits >= 0.9 * len(rows)


def test_relaxed_search_skips_and_keeps_recall():
    x = np.stack(list(vectors(6000, 6).values()))
    ids = np.arange(len(x))
    tree, q = vp_search.VpTree(x), np.arange(0, 6000, 100)
    exact, _, all_seen = tree.search(x[q], ids[q], ids, 10, 1.0, np.full(len(q), np.inf))
    found, _, seen = tree.search(x[q], ids[q], ids, 10, 1.5, np.full(len(q), np.inf))
    assert seen < all_seen < len(q) * len(x)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, found, strict=True)]) >= 0.9


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0])]
    rows += [(6, [1.0]), (7, []), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (8, [3.0, 0.0])]
    got = vp_search.nearest(table(spark, rows)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 100), (0, 2, 8), (100, 1, 0), (100, 2, 8)]
    assert vp_search.nearest(table(spark, [])).count() == 0


def test_no_pair_of_a_hot_vector_is_lost(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(120)] + [(1000 + i, [float(i), 1.0, 0.0]) for i in range(80)]
    got = vp_search.nearest(table(spark, rows), 10, 100, 1.0, 16, 1).where(F.col("query_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.0) for i in range(1, 11)]
