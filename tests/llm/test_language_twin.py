"""The language model against the same steps in plain Python."""

import math
import random

import numpy as np
import pytest

from spanlake.llm import language_id as L

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs away from the other animals".split(),
    "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft dann vor allen Tieren weg".split(),
    "es": "el rápido zorro marrón salta sobre el perro perezoso y luego huye de los otros animales".split(),
}


def texts(n=36):
    rnd = random.Random(1)
    return [(lang, " ".join(rnd.choices(TEXTS[lang], k=rnd.randint(1, 25))) + rnd.choice(["", "!", " 42", "\n"])) for lang in sorted(TEXTS) for _ in range(n // 3)]


def runs(text, buckets):
    """Hashed character runs, one by one."""
    raw = [0x20 if b <= 0x40 else b for b in f" {text.lower()} ".encode()]
    plain = [b for i, b in enumerate(raw) if i == 0 or b != 0x20 or raw[i - 1] != 0x20]
    found = []
    for n in L.ORDERS:
        for i in range(len(plain) - n + 1):
            h = 0
            for b in plain[i : i + n]:
                h = (h * 257 + b) % 2**32
            found.append(((h + n) % 2**32 * 0x9E3779B1) % 2**32 >> (32 - int(math.log2(buckets))))
    return found


def share(text, buckets):
    found = runs(text, buckets)
    out = [0.0] * buckets
    for b in found:
        out[b] += 1 / len(found)
    return out


def soft(x):
    top = max(x)
    e = [math.exp(v - top) for v in x]
    return [v / sum(e) for v in e]


def taught(x, y, k, seed, rate=8.0, batch=32):
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 0.3, (L.BUCKETS, L.DIM)).tolist()
    layer = draw.normal(0, 0.3, (L.DIM, k)).tolist()
    bias, n = [0.0] * k, len(y)
    for epoch in range(L.EPOCHS):
        step = rate * (1 - epoch / L.EPOCHS)
        for rows in np.array_split(draw.permutation(n), max(1, n // batch)):
            hidden = [[sum(x[r][b] * embed[b][d] for b in range(L.BUCKETS)) for d in range(L.DIM)] for r in rows]
            errors = []
            for r, h in zip(rows, hidden, strict=True):
                p = soft([sum(h[d] * layer[d][c] for d in range(L.DIM)) + bias[c] for c in range(k)])
                p[y[r]] -= 1
                weight = n / (k * max(1, y.count(y[r]))) / len(rows)
                errors.append([v * weight for v in p])
            back = [[sum(e[c] * layer[d][c] for c in range(k)) for d in range(L.DIM)] for e in errors]
            for d in range(L.DIM):
                for c in range(k):
                    layer[d][c] -= step * 0.1 * sum(h[d] * e[c] for h, e in zip(hidden, errors, strict=True))
            for c in range(k):
                bias[c] -= step * 0.01 * sum(e[c] for e in errors)
            for b in range(L.BUCKETS):
                for d in range(L.DIM):
                    embed[b][d] -= step * sum(x[r][b] * g[d] for r, g in zip(rows, back, strict=True))
    return [[sum(embed[b][d] * layer[d][c] for d in range(L.DIM)) for c in range(k)] for b in range(L.BUCKETS)], bias


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BUCKETS", 64), ("DIM", 4), ("EPOCHS", 3)):
        monkeypatch.setattr(L, name, value)


def test_training_equals_plain_steps(small):
    rows = texts()
    x = [share(t, 64) for _, t in rows]
    y = [sorted(TEXTS).index(lang) for lang, _ in rows]
    at = [np.flatnonzero(L.profile(t)) for _, t in rows]
    for v, (_, t), i in zip(x, rows, at, strict=True):
        own = L.profile(t) / L.profile(t).sum()
        assert np.allclose(own, v) and set(i) == {b for b in range(64) if v[b]}
    sample = L.Sample(at, [np.array([v[b] for b in i], np.float32) for v, i in zip(x, at, strict=True)], np.array(y))
    table, bias = L.train(sample, 3, 7)
    want, want_bias = taught(x, y, 3, 7)
    assert np.allclose(table, want, atol=2e-3) and np.allclose(bias, want_bias, atol=1e-4)
    logits = np.array([[sum(v[b] * want[b][c] for b in range(64)) + want_bias[c] for c in range(3)] for v in x])
    temperature, bound = L.calibrate(logits, np.array(y), 0.2)
    losses = {float(t): sum(-math.log(max(soft([z / t for z in row])[c], 1e-12)) for row, c in zip(logits, y, strict=True)) for t in np.geomspace(0.5, 20, 60)}
    assert temperature == min(losses, key=losses.get)
    right = sorted(max(p) for row, c in zip(logits, y, strict=True) if (p := soft([z / temperature for z in row])).index(max(p)) == c)
    assert abs(bound - min(right[int(0.2 * len(right))], 0.5)) < 1e-12
    model = L.Model(sorted(TEXTS), np.array(want), np.array(want_bias), temperature, bound)
    for (_, t), row in zip(rows, logits, strict=True):
        p = soft([z / temperature for z in row])
        lang, score, rejected = model.predict(t)
        assert lang == sorted(TEXTS)[p.index(max(p))] and abs(score - max(p)) < 1e-9 and rejected == (score < bound)
