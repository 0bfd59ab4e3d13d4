import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from spanlake.llm import period_runs, queries
from tests.llm.helpers import LONG, clashing, no_docs, odd_docs


def brute(w, least=6, fold=4):
    """Every lag, every stretch, every smaller period."""
    found = []
    for q in range(1, len(w) // fold + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, fold * q) and not any(w[i : i + n - p] == w[i + p : i + n] for p in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_texts(n=250, seed=1):
    rnd, texts = random.Random(seed), []
    for _ in range(n):
        w = [str(rnd.randrange(rnd.choice([1, 2, 3, 60]))) for _ in range(rnd.randint(0, 150))]
        for _ in range(rnd.randint(0, 3)):
            unit = [str(rnd.randrange(rnd.choice([2, 3, 40]))) for _ in range(rnd.randint(1, 60))]
            at = rnd.randint(0, len(w))
            w[at:at] = (unit * 20)[: rnd.randint(len(unit), 6 * len(unit))]
        texts.append(w)
    return texts


@pytest.mark.parametrize("least,fold,short", [(6, 4, 8), (10, 5, 8), (4, 4, 2)])
def test_runs_equal_brute_force(monkeypatch, least, fold, short):
    monkeypatch.setattr(period_runs, "SHORT", short)
    texts = some_texts()
    for some in (texts[:1], texts[1:4], texts):  # alone and many in one array
        got = period_runs.runs_of([[x.encode() for x in t] for t in some], least, fold)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(t, least, fold) for t in some]


def test_a_long_period_is_found_in_a_long_text():
    rnd = random.Random(5)
    unit = [b"%d" % rnd.randrange(10**6) for _ in range(7001)]
    text = [b"x"] * 3 + (unit * 5)[: 4 * 7001 + 17] + [b"y"]
    got, other = period_runs.runs_of([text, [b"z"] * 6], 6, 4)
    assert got.tolist() == [[3, 4 * 7001 + 17, 7001]] and other.tolist() == [[0, 6, 1]]


def test_odd_rows(spark):
    rows = {(r.doc_id, r.n_words): r for r in period_runs.period_runs(odd_docs(spark)).collect()}
    assert sum(1 for _ in period_runs.period_runs(odd_docs(spark)).collect()) == 10
    assert all(rows[d, 0].runs == [] and rows[d, 0].collapsed == "" for d in (2, 3, 4))
    (run,) = rows[5, len(LONG.split())].runs
    assert (run.start, run.length, run.period) == (0, 12000, 3)
    assert rows[5, len(LONG.split())].collapsed == "the of and " + "x" * 30000
    assert rows[None, 4].runs == []
    assert period_runs.period_runs(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        period_runs.period_runs(odd_docs(spark), fold=3)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def test_query_equals_brute_force(spark, tmp_path):
    docs = [(d, " \n".join(w)) for d, w in enumerate(some_texts(400, 2))] + [(1000, None), (None, "a " * 9), (1001, "é é é é é é")]
    clashing(spark.createDataFrame(docs, "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.asDict() for r in queries.op12_period_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    changed = 0
    for doc_id, text in docs:
        plain = (text or "").split()
        w = planted(doc_id, plain)
        changed += w != plain
        runs = brute(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert got[doc_id] == {
            "doc_id": doc_id,
            "n_runs": len(runs),
            "start": best[0],
            "length": best[1],
            "period": best[2],
            "exponent_milli": None if best[0] is None else 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
        }
    assert changed > 10


def test_query_reads_the_whole_table(spark, sf):
    got = queries.op12_period_runs(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.where("n_runs > 0").agg(F.min(F.col("length") - 4 * F.col("period")).alias("m")).first().m >= 0
