"""Token counts by rank-synchronous merging of byte-pair symbols.

Texts are cut into pre-tokens as the tokenizer's file says. The distinct pre-tokens of a batch are held as one ragged
numpy array of symbol ids; in each round every sequence applies its lowest-ranked pair at all its places at once, until
no sequence has a pair left. The surviving symbols are counted and added up per text. A count once made is kept in a
table of bounded size in the Python worker.

Defined cases: a null text counts as empty, with zero bytes and tokens; an empty table gives no rows; repeated rows are
counted one by one; texts of any length are counted whole, in batches of bounded bytes; a pre-token longer than
LONG_SYMBOLS forms a batch of its own; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

NO_PAIR = np.int64(1 << 40)
KEPT_WORDS = 400_000
LONG_SYMBOLS = 4096
BATCH_SYMBOLS = 1 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as is, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class MergeTable:
    """A vocabulary file as arrays: first symbols of a byte, and rank and result of each pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        names = byte_symbols()
        self.inner = np.array([vocab[c] for c in names], np.int64)
        self.last = np.array([vocab[c + suffix] for c in names], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[self.rank_of], made
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_PAIR where there is no merge of it."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NO_PAIR)


def merged_sizes(table: MergeTable, words: list[bytes]) -> np.ndarray:
    """Number of symbols that each word keeps after all merges."""
    lengths = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbols = table.inner[raw]
    ends = np.cumsum(lengths)
    symbols[ends - 1] = table.last[raw[ends - 1]]
    result = np.empty(len(words), np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)  # which word a symbol belongs to
    rank = np.append(table.ranks(symbols[:-1], symbols[1:]), NO_PAIR)  # of a symbol with the next one
    rank[ends - 1] = NO_PAIR
    while len(symbols):
        heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        counts = np.diff(np.append(heads, len(symbols)))
        lowest = np.minimum.reduceat(rank, heads)
        live = lowest < NO_PAIR
        result[owner[heads[~live]]] = counts[~live]  # done: these words leave the batch
        at = np.flatnonzero((rank == np.repeat(lowest, counts)) & (rank < NO_PAIR))
        # in a run of touching places (a symbol paired with itself) every second one is applied, from the left
        fresh = np.concatenate(([True], np.diff(at) > 1))[: len(at)]
        nth = np.arange(len(at))
        at = at[(nth - np.maximum.accumulate(np.where(fresh, nth, 0))) % 2 == 0]
        symbols[at] = table.made[rank[at]]
        rank[at] = rank[at + 1]
        keep = np.repeat(live, counts)
        keep[at + 1] = False
        moved = np.cumsum(keep)[at] - 1
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        # only pairs that touch a merged symbol have a new rank
        left = np.concatenate([moved, moved[moved > 0] - 1])
        left = left[left + 1 < len(symbols)]
        left = left[owner[left] == owner[left + 1]]
        rank[left] = table.ranks(symbols[left], symbols[left + 1])
    return result


class TokenCounter:
    """Counts tokens of texts as the file's own library does."""

    def __init__(self, path: str):
        import regex
        import tokenizers

        self.table = MergeTable(path)
        self.library = tokenizers.Tokenizer.from_file(path)
        rest = r"'s|'t|'re|'ve|'m|'ll|'d|"
        self.ascii = re.compile(rest + r"[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
        self.unicode = regex.compile(rest + r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.split = re.compile("|".join(map(re.escape, self.table.special)))
        self.kept: dict[str, int] = {}
        self.assigned: set[str] = set()
        self.bytes = {c: b for b, c in enumerate(byte_symbols())}

    def pre_tokens(self, text: str) -> list[str] | list[bytes]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        new = set(text) - self.assigned
        if any(unicodedata.category(c) == "Cn" for c in new):  # newer than one of the two Unicode tables: ask the library
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(self.bytes[c] for c in w) for w, _ in found]
        self.assigned |= new
        # lower-cased character by character, so without the final form of sigma
        return self.unicode.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def learn(self, words: Iterable[str | bytes]) -> None:
        coded = [(w, w if isinstance(w, bytes) else w.encode()) for w in words]
        short = [x for x in coded if len(x[1]) <= LONG_SYMBOLS]
        room, batch = BATCH_SYMBOLS, []
        batches = [[x] for x in coded if len(x[1]) > LONG_SYMBOLS]
        for x in short:
            batch.append(x)
            room -= len(x[1])
            if room <= 0:
                batches.append(batch)
                room, batch = BATCH_SYMBOLS, []
        for b in [*batches, batch] if batch else batches:
            self.kept.update(zip([w for w, _ in b], merged_sizes(self.table, [c for _, c in b]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        fixed, cut = [], []
        for text in texts:
            parts = self.split.split(text) if "<|" in text else [text]
            fixed.append(len(parts) - 1)
            cut.append([w for p in parts for w in self.pre_tokens(p)] if len(parts) > 1 else self.pre_tokens(text))
        seen = set().union(*cut) if cut else set()
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        self.learn(seen - self.kept.keys())
        size = self.kept.__getitem__
        return [n + sum(map(size, words)) for n, words in zip(fixed, cut, strict=True)]


@cache
def counter(file: str) -> TokenCounter:
    import public_tokenizers

    return TokenCounter(public_tokenizers.path(file))


def slices(texts: Iterable[str | None], most_chars: int = 4 << 20) -> Iterator[list[str]]:
    """Lists of whole texts of about most_chars together; a longer text stands alone."""
    batch, room = [], most_chars
    for t in texts:
        batch.append(t or "")
        room -= len(batch[-1]) + 64
        if room <= 0:
            yield batch
            batch, room = [], most_chars
    if batch:
        yield batch


def token_counts(docs: DataFrame, file: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text."""

    @F.pandas_udf(LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(file)
        for texts in batches:
            yield pd.Series([n for part in slices(texts) for n in own.count(part)], dtype="int64")

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        counted("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
