"""Greedy packing of an ordered table into consecutive blocks, exactly and in parallel.

A greedy packer forgets everything when it opens a block: where a block ends depends only on where it starts. So every row first gets
a pointer to the row at which the next block would open if one opened here. With limits on sums these pointers are a join of each
row's running sum plus the limit with the running sums themselves, done by one ordered scan; with a limit on longest times count they are
read off tables of range maxima. The starts that are really reached are then found in two steps: pointers are shortened to
the first row beyond their chunk of bounded size, and the few rows near chunk borders are followed by pointer doubling. Nothing looks
ahead beyond a chunk, so a block may be longer than any of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.plans.scan import ordered_scan
from spanlake.session import cut

CHUNK_ROWS = 50_000


def sum_pointers(rows: DataFrame, limits: dict[str, int], idx: str = "idx", group: str | None = None) -> DataFrame:
    """(i, nxt): where the next block opens if one opens at i; blocks grow while the sum of every column stays within its limit.

    A first row always fits. A change of group, which follows the order of idx, ends the block as well.
    """
    keys = [group] if group else []
    cols = list(limits)
    narrow = rows.select(*keys, F.col(idx).cast("long").alias("i"), *[F.col(c).cast("long").alias(c) for c in cols])
    placed = cut(ordered_scan(narrow, keys, [F.col("i")], {f"_before_{c}": ("sum", F.col(c), False) for c in cols}))
    ends = placed.groupBy(*keys).agg(F.max("i").alias("last"), *[F.sum(c).alias(c) for c in cols])
    found = None
    for c in cols:
        # at one sum starts come before the questions that they may answer
        start = placed.select(*keys, F.col(f"_before_{c}").alias("x"), F.lit(0).alias("asks"), "i")
        close = ends.select(*keys, F.col(c).alias("x"), F.lit(0).alias("asks"), (F.col("last") + 1).alias("i"))
        ask = placed.select(*keys, (F.col(f"_before_{c}") + limits[c]).alias("x"), F.lit(1).alias("asks"), "i")
        seen = F.when(F.col("asks") == 0, F.col("i"))
        run = ordered_scan(start.unionByName(close).unionByName(ask), keys, [F.col("x"), F.col("asks"), F.col("i")], {"nxt": ("max", seen, True)})
        one = run.where("asks = 1").select("i", F.greatest(F.col("nxt"), F.col("i") + 1).alias("nxt"))
        found = one if found is None else found.join(one.withColumnRenamed("nxt", "_n"), "i").select("i", F.least("nxt", "_n").alias("nxt"))
    return found


def longest_reach(sizes: np.ndarray, count: int, max_tokens: int, max_rows: int) -> np.ndarray:
    """For each of the first count rows the most rows whose longest size times number stays within the limits (0: none).

    The limit grows with the rows, so the end is found bit by bit, from tables of the maxima of 1, 2, 4, ... rows.
    """
    n = len(sizes)
    tables = [sizes]
    while 2 << len(tables) - 1 <= n:
        half, last = 1 << len(tables) - 1, tables[-1]
        tables.append(np.maximum(last[: len(last) - half], last[half:]))
    start = np.arange(count)
    end, top = start.copy(), np.zeros(count, np.int64)
    for k in range(len(tables) - 1, -1, -1):
        fits = end + (1 << k) <= n
        peak = np.maximum(top, tables[k][np.minimum(end, len(tables[k]) - 1)])
        rows = end + (1 << k) - start
        if max_tokens > 0:
            fits &= peak * rows <= max_tokens
        if max_rows > 0:
            fits &= rows <= max_rows
        end, top = np.where(fits, end + (1 << k), end), np.where(fits, peak, top)
    return np.maximum(end - start, 1)


def batch_pointers(rows: DataFrame, size: str, max_tokens: int, max_rows: int, multiple: int, idx: str = "idx", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(i, nxt) of batches whose longest size times row count stays within max_tokens; counts are cut to a multiple.

    A task holds one chunk and the rows that a batch opened there could take at most.
    """
    narrow = rows.select(F.col(idx).cast("long").alias("i"), F.col(size).cast("long").alias("v"))
    head = narrow.agg(F.count("*").alias("n"), F.min("v").alias("low")).first()
    n_total = head["n"]
    ahead = min([n_total, *([max_rows] if max_rows > 0 else []), *([max_tokens // head["low"] + 1] if max_tokens > 0 and head["low"] else [])])
    chunk = F.sequence(F.greatest(F.floor((F.col("i") - ahead) / chunk_rows), F.lit(0)), F.floor(F.col("i") / chunk_rows))

    def point(part: pa.Table) -> pa.Table:
        part = part.sort_by("i")
        i, v = part["i"].to_numpy(), part["v"].to_numpy()
        count = int(np.searchsorted(i, (part["chunk"][0].as_py() + 1) * chunk_rows))
        taken = longest_reach(v, count, max_tokens, max_rows)
        taken = np.where(taken > multiple, taken - taken % multiple, taken)
        return pa.table({"i": i[:count], "nxt": i[:count] + taken})

    return narrow.select("i", "v", F.explode(chunk).alias("chunk")).groupBy("chunk").applyInArrow(point, "i long, nxt long")


def greedy_blocks(pointers: DataFrame, idx: str = "idx", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(idx, block_start): for each row of the dense order the position at which its block opens, from pointers (i, nxt)."""
    chunked = pointers.select("i", "nxt", F.floor(F.col("i") / chunk_rows).alias("chunk"))

    def shorten(part: pa.Table) -> pa.Table:
        part = part.sort_by("i")
        i = part["i"].to_numpy()
        base, n = int(i[0]), len(i)
        leave = part["nxt"].to_numpy() - base
        while (leave < n).any():
            inside = leave < n
            leave = np.where(inside, leave[np.where(inside, leave, 0)], leave)
        return pa.table({"i": i, "nxt": part["nxt"], "leave": leave + base, "chunk": part["chunk"]})

    jumps = cut(chunked.groupBy("chunk").applyInArrow(shorten, "i long, nxt long, leave long, chunk long"))
    stats = jumps.agg(F.max(F.col("nxt") - F.col("i")).alias("span"), F.count("*").alias("n")).first()
    if not stats["n"]:
        return jumps.select(F.col("i").alias(idx), F.col("i").alias("block_start"))
    # starts can enter a chunk only within one block length behind its border
    near = F.col("i") - F.col("chunk") * chunk_rows < int(stats["span"])
    jump = cut(jumps.where(near).select("i", F.col("leave").alias("to")))
    reach, known = jump.where("i = 0").select("i"), 1
    while True:
        reach = cut(reach.union(reach.join(jump, "i").select(F.col("to").alias("i"))).distinct().where(F.col("i") < stats["n"]))
        size = reach.count()
        if size == known:
            break
        known = size
        far = jump.select(F.col("i").alias("to"), F.col("to").alias("_far"))
        jump = cut(jump.join(far, "to", "left").select("i", F.coalesce("_far", "to").alias("to")))
    entered = jumps.select("i", "nxt", "chunk").join(reach.withColumn("entry", F.lit(True)), "i", "left")

    def follow(part: pa.Table) -> pa.Table:
        """Starts that the chunk's entries lead to: each round follows twice as many pointers at once."""
        part = part.sort_by("i")
        i = part["i"].to_numpy()
        base, n = int(i[0]), len(i)
        to = np.append(np.minimum(part["nxt"].to_numpy() - base, n), n)
        opens = np.append(part["entry"].is_valid().to_numpy(zero_copy_only=False), False)
        while (to[:n] < n).any():
            opens[to[np.flatnonzero(opens)]] = True
            to = to[to]
        opens[n] = False
        return pa.table({"i": i, "opens": opens[:n]})

    starts = entered.groupBy("chunk").applyInArrow(follow, "i long, opens boolean")
    laid = ordered_scan(starts, [], [F.col("i")], {"block_start": ("last", F.when(F.col("opens"), F.col("i")), True)})
    return laid.select(F.col("i").alias(idx), "block_start")
