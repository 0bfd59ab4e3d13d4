"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its hashed character runs (bytes of the lower-cased text, of the lengths in
ORDERS, with marks at word borders); a linear layer and a softmax follow. Embeddings and layer are learnt by stochastic
gradient descent in numpy from a bounded sample: of each language the PER_LANGUAGE labelled texts whose hash is lowest.
A part of the sample is kept back: on it the softmax temperature is fitted, and the bound under which a prediction is
rejected is set so that at most `max_false_rejections` of the rightly told texts fall below it.

Only hashed counts of the sampled texts reach the driver: at most languages x PER_LANGUAGE rows of at most BUCKETS pairs.

Defined cases: a null text or one without any letter is `und` with score 0 and is rejected; ties go to the language
that sorts first; without labelled rows every text is `und`; an empty table gives no rows; texts of any length are read
whole; repeated rows are predicted one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 500
DIM = 16
EPOCHS = 8
LETTER = regex.compile(r"\p{L}")
#: An odd multiplier with well mixed bits, for hashing byte runs.
MIX = np.uint32(0x9E3779B1)


def bucket_ids(text: str) -> list[np.ndarray]:
    """Buckets of all character runs of a text, one array per order, in linear time."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    plain = np.where(raw <= 0x40, np.uint8(0x20), raw)  # digits, white space and most marks are borders alike
    plain = plain[np.concatenate(([True], (plain[1:] != 0x20) | (plain[:-1] != 0x20)))].astype(np.uint32)
    found, run = [], np.zeros(len(plain), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(plain) < n:
            break
        run = (run[: len(plain) - n + 1] * np.uint32(257) + plain[n - 1 :]).astype(np.uint32)
        if n in ORDERS:
            found.append(((run + np.uint32(n)) * MIX) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return found


def profile(text: str) -> np.ndarray:
    """How often each bucket occurs in the whole text."""
    ids = bucket_ids(text)
    return np.bincount(np.concatenate(ids), minlength=BUCKETS) if ids else np.zeros(BUCKETS, np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): embeddings times layer, since the mean is linear
    bias: np.ndarray
    temperature: float
    bound: float

    def logits(self, text: str) -> np.ndarray:
        total, n = self.bias.astype(np.float64), 0
        ids = bucket_ids(text)
        n = sum(map(len, ids))
        return total + sum(np.bincount(i, minlength=BUCKETS) for i in ids) @ self.table / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        score = float(min(p[best], 1.0))
        return self.languages[best], score, score < self.bound


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Sample:
    """Bucket shares of texts in sparse rows, and their languages; only a batch is ever laid out in full."""

    def __init__(self, at: list[np.ndarray], share: list[np.ndarray], y: np.ndarray):
        self.at, self.share, self.y = at, share, y

    def __len__(self) -> int:
        return len(self.y)

    def dense(self, rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            x[i, self.at[r]] = self.share[r]
        return x

    def part(self, rows: np.ndarray) -> Sample:
        return Sample([self.at[r] for r in rows], [self.share[r] for r in rows], self.y[rows])


def train(sample: Sample, n_languages: int, seed: int = 7, rate: float = 8.0, batch: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times layer, and bias, after EPOCHS of stochastic gradient descent."""
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    layer = draw.normal(0, 0.3, (DIM, n_languages)).astype(np.float32)
    bias, y = np.zeros(n_languages, np.float32), sample.y
    weight = (len(y) / (n_languages * np.bincount(y, minlength=n_languages).clip(1))).astype(np.float32)
    for epoch in range(EPOCHS):
        step = rate * (1 - epoch / EPOCHS)
        for rows in np.array_split(draw.permutation(len(y)), max(1, len(y) // batch)):
            mean = sample.dense(rows)
            hidden = mean @ embed
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error *= weight[y[rows]][:, None] / len(rows)
            back = error @ layer.T
            layer -= step * 0.1 * (hidden.T @ error)
            bias -= step * 0.01 * error.sum(0)
            embed -= step * (mean.T @ back)
    return embed @ layer, bias


def calibrate(logits: np.ndarray, y: np.ndarray, max_false_rejections: float) -> tuple[float, float]:
    """Temperature with the least log loss, and the score that the given share of right predictions falls below."""
    if not len(y):
        return 1.0, 0.0
    grid = np.geomspace(0.5, 20, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y].clip(1e-12)).mean() for t in grid]
    best = float(grid[int(np.argmin(loss))])
    p = softmax(logits / best)
    right = np.sort(p.max(1)[p.argmax(1) == y])
    bound = float(right[int(max_false_rejections * len(right))]) if len(right) else 0.0
    # never stricter than an even chance against all other languages together
    return best, min(bound, 0.5)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, max_false_rejections: float = 0.001, seed: int = 7) -> Model:
    """Learn from rows (doc_id, text, lang); rows without text or lang teach nothing."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.octet_length("text")), 1)
    # rows whose hash lies under a bound that a few times the wanted number of each language pass; one count per language
    bounds = {r["lang"]: min(1.0, 4 * per_language / r["count"]) for r in rows.groupBy("lang").count().collect()}
    bound = F.lit(None).cast("long")
    for lang, part in bounds.items():
        bound = F.when(F.col("lang") == lang, F.lit(min(int(part * 2**63), 2**63 - 1))).otherwise(bound)
    by_language = Window.partitionBy("lang").orderBy("_o", "doc_id", "text")
    few = rows.select("doc_id", "text", "lang", order.alias("_o")).where(F.col("_o") <= bound)
    drawn = few.withColumn("_n", F.row_number().over(by_language)).where(F.col("_n") <= per_language)

    @F.pandas_udf("struct<at:array<int>,n:array<int>>")
    def counted(texts: pd.Series) -> pd.DataFrame:
        found = [profile(t) for t in texts]
        at = [np.flatnonzero(p) for p in found]
        return pd.DataFrame({"at": at, "n": [p[i] for p, i in zip(found, at, strict=True)]})

    # arrays of numbers, at most languages x per_language rows
    counts = drawn.select("lang", "_n", counted("text").alias("c")).select("lang", "_n", "c.at", "c.n")
    rows = counts.toArrow().sort_by([("lang", "ascending"), ("_n", "ascending")])
    languages = sorted(set(rows["lang"].to_pylist()))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    at = [x.values.to_numpy() for x in rows["at"]]
    n = [x.values.to_numpy().astype(np.float32) for x in rows["n"]]
    y = np.array([languages.index(x) for x in rows["lang"].to_pylist()])
    sample = Sample(at, [x / max(1.0, float(x.sum())) for x in n], y)
    back = rows["_n"].to_numpy() % 5 == 0  # kept back for calibration
    taught, tried = sample.part(np.flatnonzero(~back)), sample.part(np.flatnonzero(back))
    weights, bias = train(taught, len(languages), seed)
    logits = np.array([s @ weights[i] + bias for i, s in zip(tried.at, tried.share, strict=True)], np.float64)
    temperature, bound = calibrate(logits, tried.y, max_false_rejections)
    return Model(languages, weights.astype(np.float64), bias, temperature, bound)


def predicted(model: Model, text: Column) -> Column:
    """struct(lang_pred, score, rejected) of a text column."""

    @F.pandas_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return told(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame, **options) -> Model:
    """A model from the rows of docs that are not held out."""
    return fit(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()), **options)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    told = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(model, F.col("text")).alias("t"))
    return told.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "t.lang_pred", "t.score", "t.rejected")
