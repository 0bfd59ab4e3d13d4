import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spanlake.llm import queries, repeat_index
from tests.llm.helpers import LONG, clashing, no_docs, odd_docs


def brute(texts, least):
    """Removed spans and kept bytes of each text by counting every window."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + least] for r in raw for i in range(len(r) - least + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                gone[i + 1 : i + 1 + least] = True
        edges = np.flatnonzero(np.diff(gone.view(np.int8)))
        out.append(([(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)], r and bytes(np.frombuffer(r, np.uint8)[~gone[1:-1]])))
    return out


def some_texts(least, seed=3, n=60):
    rnd = random.Random(seed)
    draw = lambda k, alphabet="abcdefgh é": "".join(rnd.choice(alphabet) for _ in range(k))
    line = draw(least // 2)  # shorter than a window, in every third text
    passage = draw(3 * least)
    texts = [None, "", "short", "a" * (3 * least), "ab" * 2 * least, passage, "é" * least]
    for i in range(n):
        t = draw(rnd.randint(0, 4 * least), "ab" if i % 9 == 0 else "abcdefgh é")
        if i % 3 == 0:
            t += line + draw(2 * least)
        if i % 3 == 1:  # pieces of the passage, long enough or not, also twice in a text
            for _ in range(rnd.randint(1, 2)):
                at = rnd.randint(0, 2 * least)
                t += passage[at : at + rnd.randint(least // 2, 2 * least)] + draw(rnd.randint(0, least))
        if i % 4 == 3 and texts[-1]:  # a near copy
            own = list(texts[-1])
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = "#"
            t = "".join(own)
        texts.append(t)
    return texts


def frame(spark, texts):
    return clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def removed(df):
    return {r.doc_id: ([tuple(s) for s in r.removed], bytes(r.kept)) for r in df.collect()}


@pytest.mark.parametrize("hot,levels,bucket", [(1024, 2, 1 << 20), (1024, 2, 500), (2, 0, 1 << 20), (2, 2, 1 << 20)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, hot, levels, bucket):
    monkeypatch.setattr(repeat_index, "HOT", hot)
    monkeypatch.setattr(repeat_index, "LEVELS", levels)
    monkeypatch.setattr(repeat_index, "BUCKET_BYTES", bucket)
    texts = some_texts(60)
    got = removed(repeat_index.remove_repeats(frame(spark, texts), 60))
    want = brute(texts, 60)
    assert {d: (s, k or b"") for d, (s, k) in enumerate(want)} == got
    assert sum(len(s) for s, _ in want) > 30


def test_index_marks_every_repeat():
    rnd = random.Random(2)
    for alphabet in ("a", "ab", "abc\x00ÿ", "abcdefghijkl"):
        for _ in range(40):
            base = "".join(rnd.choice(alphabet) for _ in range(300)).encode()
            names = list({base[(i := rnd.randint(0, 200)) : i + rnd.randint(40, 90)] + bytes([rnd.randrange(97, 99)]) * rnd.randint(0, 3) for _ in range(rnd.randint(1, 12))})
            names = [n for n in names if len(n) >= 33]
            seen = Counter(n[i : i + 33] for n in names for i in range(len(n) - 32))
            got = dict(zip(*repeat_index.marked({n: (n, 1) for n in names}, 33), strict=True))
            for n in names:
                hit = np.array([seen[n[i : i + 33]] > 1 for i in range(len(n) - 32)])
                assert got.get(n, []) == repeat_index.spans_of(hit, 33)


def test_runs_compress_repetitive_contexts():
    rnd = random.Random(7)
    base = bytes(rnd.randrange(97, 123) for _ in range(2000))
    near = [base[:i] + b"#" + base[i + 1 :] for i in range(100, 1900, 60)]
    index = repeat_index.RunIndex.build(near)
    assert len(index.symbols) < len(index.line) / 8
    assert (index.symbols == index.line[index.first - 1]).all() and (index.symbols == index.line[index.last - 1]).all()


def test_anchors_depend_on_the_window_alone():
    rnd = random.Random(1)
    passage = bytes(rnd.randrange(256) for _ in range(1500))
    found = []
    for before in (0, 1, 333, 2000):
        raw = bytes(rnd.randrange(256) for _ in range(before)) + passage
        text, first, last, key = repeat_index.anchors(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), 400)
        assert first[0] == 0 and last[-1] == len(raw) - 400 and (first[1:] == last[:-1] + 1).all()
        found.append([k for f, n, k in zip(first, last, key, strict=True) if n >= before])
    assert all(f[-len(found[0]) + 1 :] == found[0][1:] for f in found)


def test_odd_rows(spark):
    got = repeat_index.remove_repeats(odd_docs(spark)).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    want = brute([LONG], 400)[0]
    assert [tuple(s) for s in by[5].removed] == want[0] and bytes(by[5].kept) == want[1]
    assert all(r.removed == [] for r in got if r.doc_id != 5)
    assert repeat_index.remove_repeats(no_docs(spark)).count() == 0
    twice = clashing(spark.createDataFrame([(None, "xyz" * 20), (None, "xyz" * 20), (3, "ab" * 9)], "doc_id long, text string"))
    rows = repeat_index.remove_repeats(twice, 50).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, [tuple(s) for s in r.removed]) for r in rows) == [(0, 60, [(0, 60)]), (0, 60, [(0, 60)]), (3, 18, [])]
    with pytest.raises(ValueError):
        repeat_index.remove_repeats(twice, 32)


def test_query_equals_brute_force(spark, tmp_path):
    texts = some_texts(400, 5, 24)
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.asDict() for r in queries.op11_repeat_index(spark, str(tmp_path)).collect()}
    for d, (spans, kept) in enumerate(brute(texts, 400)):
        want = {"doc_id": d, "n_bytes": len((texts[d] or "").encode()), "n_removed": sum(n for _, n in spans), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept or b"").hexdigest()}
        assert got[d] == want
