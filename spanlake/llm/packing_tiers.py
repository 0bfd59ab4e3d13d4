"""Hierarchical packing of documents into windows of several lengths.

Every document is a run of token ids closed by one end id. Its whole windows stand alone. What is left is routed to the
shortest tier that holds it. Left-overs of the longest tier open a window each; their gaps are filled from the shorter
tiers, shortest first. What the gaps do not take is packed by tier into sequences of the tier's length; the rest of a
tier goes on to the next longer one, and the last rest is cut at powers of two. Sequences are dealt to step groups by
length, so that the groups of a step hold nearly the same number of tokens.

Documents are dealt to groups of bounded size by a hash of id and text, and each group is packed on its own: the result
does not depend on the partitioning, and nothing is ordered over the whole table.

Defined cases: a null or empty text is one end id; rows that repeat an id are packed one by one; an empty table gives
no pieces; a document of any length, with runs of white space of any length, is cut into whole windows, so a window's border may lie
inside it; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import groups_for
from spanlake.session import shuffle_width

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, step_group long"
)
#: Texts with a longer run of white space go to the library.
LONG_BLANKS = 20_000
BLANKS = re.compile(r"\s+")


@cache
def byte_encoder(ranks_file: str):
    """The vocabulary of byte_bpe_50k.json in its ranked form: the same ids, several times as fast."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks_file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
    )


@cache
def library(file: str):
    """The vocabulary's own library, which takes texts of any shape."""
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path(file))


def token_ids(text: str | None, ranks_file: str = "byte_bpe_50k.tiktoken", end_id: int = 0) -> np.ndarray:
    text = text or ""
    # the ranked form looks ahead over every run of blanks, and its stack ends within some hundred thousand of them
    if len(text) > LONG_BLANKS and any(m.end() - m.start() > LONG_BLANKS for m in BLANKS.finditer(text)):
        ids = library(ranks_file.replace(".tiktoken", ".json")).encode(text, add_special_tokens=False).ids
    else:
        ids = byte_encoder(ranks_file).encode(text, allowed_special="all")
    ids.append(end_id)
    return np.array(ids, "<u4")


def pour(stream: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut a stream of runs into slots of the same total: run, start in it, slot, start in it and length of each piece."""
    run_end, slot_end = np.cumsum(stream), np.cumsum(slots)
    ends = np.union1d(run_end, slot_end)
    ends = ends[ends > 0]
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)]
    run = np.searchsorted(run_end, begins, "right")
    slot = np.searchsorted(slot_end, begins, "right")
    return run, begins - (run_end - stream)[run], slot, begins - (slot_end - slots)[slot], ends - begins


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def plan(lengths: np.ndarray, tiers: tuple[int, ...]) -> np.ndarray:
    """Pieces (doc, start, length, sequence, offset) for documents of the given lengths; every sequence is full."""
    window = max(tiers)
    lengths = np.asarray(lengths, np.int64)
    whole, rest = lengths // window, lengths % window
    doc = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    full = np.stack([doc, nth * window, np.full(len(doc), window), np.arange(len(doc)), np.zeros(len(doc), np.int64)], 1)

    left = np.flatnonzero(rest)
    ladder = np.array(sorted(tiers))
    tier = np.searchsorted(ladder, rest[left])  # the shortest that holds it
    left = left[np.argsort(tier, kind="stable")]
    tier = np.sort(tier, kind="stable")
    long = left[tier == len(ladder) - 1]
    windows = min(len(long), int(rest.sum()) // window)
    bases = long[:windows]
    stream = np.concatenate([left[tier < len(ladder) - 1], long[windows:]])
    gaps = window - rest[bases]
    slots, held = list(gaps), int(gaps.sum())
    owner = list(range(windows))
    begin = list(rest[bases])
    carried, taken, n = 0, held, windows
    sizes = rest[stream]
    level = np.searchsorted(ladder, sizes)
    for k, width in enumerate(ladder):
        total = int(sizes[level == k].sum())
        skipped = min(taken, total)
        taken -= skipped
        carried += total - skipped
        count, carried = divmod(carried, int(width))
        for size in [int(width)] * count + (powers(carried) if k == len(ladder) - 1 else []):
            slots.append(size)
            owner.append(n)
            begin.append(0)
            n += 1
    first = len(full)
    parts = [full, np.stack([bases, whole[bases] * window, rest[bases], first + np.arange(windows), np.zeros(windows, np.int64)], 1)]
    if len(stream):
        keep = np.array(slots, np.int64) > 0
        owner, begin, slots = (np.array(x, np.int64)[keep] for x in (owner, begin, slots))
        run, at, slot, inside, size = pour(sizes, slots)
        source = stream[run]
        parts.append(np.stack([source, whole[source] * window + at, size, first + owner[slot], begin[slot] + inside], 1))
    return np.concatenate(parts).astype(np.int64)


def step_groups(sizes: np.ndarray, per_group: int) -> np.ndarray:
    """Deal sequences by falling length, forth and back, to groups of about per_group full windows."""
    n = max(1, round(len(sizes) / per_group))
    rank = np.empty(len(sizes), np.int64)
    rank[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))
    lap, seat = np.divmod(rank, n)
    return np.where(lap % 2, n - 1 - seat, seat)


def pack(
    docs: DataFrame,
    tiers: tuple[int, ...] = (128, 256, 512, 1024),
    ranks_file: str = "byte_bpe_50k.tiktoken",
    end_id: int = 0,
    group_bytes: int = 6 << 20,
    per_step: int = 64,
) -> DataFrame:
    """Pieces of packed sequences, one row per piece (see SCHEMA).

    group_bytes bounds what one task holds: documents are packed in groups of about that much text, or one document.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(groups_for(rows, F.octet_length("text") + 64, group_bytes), shuffle_width(docs.sparkSession))

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = [token_ids(t.as_py(), ranks_file, end_id) for t in group["text"]]
        lengths = np.array([len(x) for x in ids], np.int64)
        p = plan(lengths, tiers)
        sizes = np.bincount(p[:, 3], p[:, 2]).astype(np.int64)
        high = group["_group"][0].as_py() << 32
        crc = [zlib.crc32(ids[d][s : s + k].tobytes()) for d, s, k in p[:, :3].tolist()]
        return pa.table(
            {
                "doc_id": group["doc_id"].take(pa.array(p[:, 0])),
                "start": p[:, 1],
                "length": p[:, 2],
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": lengths[p[:, 0]],
                "sequence_id": high + p[:, 3],
                "offset": p[:, 4],
                "sequence_tokens": sizes[p[:, 3]],
                "step_group": high + step_groups(sizes, per_step)[p[:, 3]],
            }
        )

    grouped = rows.withColumn("_group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))
    return grouped.groupBy("_group").applyInArrow(packed, SCHEMA)
