"""Mixing sources to target weights through a tree of domains, languages and sources.

The token budget is handed down level by level. Among siblings it is shared by weight, and a node never gets more than
its documents hold in `max_epochs` passes; what a full node leaves is shared among its siblings by weight, and only what
the siblings cannot take goes to the parent's siblings (a parent's bound is the sum of its children's). Each leaf then
takes whole passes over its documents and, of one more pass, the longest prefix in a seeded order that fits.

Siblings are few rows, so shares are window sums over one row per node. A leaf's order is never sorted as a whole: a
document's place is the hash of (seed, pass, id); documents fall into buckets by leading digits, bucket totals tell which
buckets are in or out, and only the one bucket in which a leaf's budget ends is ordered.

Defined cases: a null lang or source is the leaf `unknown`; a null text has no tokens; a document without tokens costs
nothing; names without a weight weigh 1; rows that repeat an id are taken one by one; ties in the order go to the
smaller doc_id, then to fewer tokens; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import keep_rows, stored, text_key, words

LEVELS = ["domain", "lang", "source"]
DOMAINS = ["web", "books", "news", "forum"]
#: Target weights by level and name.
WEIGHTS = {
    "domain": {"web": 4, "books": 3, "news": 2, "forum": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 1, "src1": 2},
}
UNKNOWN = "unknown"
WIDE = "decimal(38,0)"
BUCKET_ROWS = 20_000


def domain_of(source: Column) -> Column:
    """Domain of a numbered source: sources are dealt to DOMAINS by number, others are unknown."""
    number = source.substr(4, 9).try_cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, DOMAINS)), F.pmod(number, F.lit(len(DOMAINS)))), F.lit(UNKNOWN))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, _text, the levels and n_tokens (words) of every document."""
    name = lambda c: F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(F.col("text")).alias("_text"),
        domain_of(F.col("source")).alias("domain"),
        name("lang"),
        name("source"),
        F.size(words(F.col("text"))).cast("long").alias("n_tokens"),
    )


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    known = weights.get(level) or {}
    if min(known.values(), default=1) <= 0:
        raise ValueError("weights are positive")
    named = F.lit(None).cast("long")
    for name, w in known.items():
        named = F.when(F.col(level) == name, F.lit(w)).otherwise(named)
    return F.coalesce(named, F.lit(1)).cast(WIDE)


def quotient(a: Column, b: Column) -> Column:
    """Integer part of a / b, exact."""
    return F.call_function("div", a.cast(WIDE), b.cast(WIDE))


def shared_out(leaves: DataFrame, budget: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves (levels, size, cap) with each leaf's budget."""
    above: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        node, parent = LEVELS[: depth + 1], LEVELS[:depth]
        rows = leaves.groupBy(*node).agg(F.sum("cap").cast(WIDE).alias("cap")).withColumn("w", weight_of(level, weights))
        rows = rows.withColumn("b", F.lit(budget).cast(WIDE)) if above is None else rows.join(above, parent)
        siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        rising = siblings.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), level)
        less = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
        # a node is full if its bound is within its share of what the nodes before it, all full, have left
        filled = rows.withColumn("full", F.col("cap") * rest.cast(WIDE) <= F.col("w") * (F.col("b") - less))
        spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0))
        open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(siblings)
        share = quotient((F.col("b") - spent) * F.col("w"), open_weight)
        above = filled.select(*node, F.when(F.col("full"), F.col("cap")).otherwise(share).cast(WIDE).alias("b"))
    return leaves.join(above.withColumnRenamed("b", "budget"), LEVELS).withColumn("budget", F.col("budget").cast("long"))


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(
    docs: DataFrame,
    share: tuple[int, int] = (1, 2),
    max_epochs: int = 2,
    weights: dict[str, dict[str, int]] | None = None,
    seed: int = 11,
) -> DataFrame:
    """doc_id, _text, levels, n_tokens, epoch and leaf_budget: a row for each time a document is taken.

    The budget is share (as a fraction) of all tokens.
    """
    rows = stored(measured(docs))
    leaves = stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n")).withColumn("cap", F.col("size") * max_epochs))
    whole = leaves.agg(F.sum("size").alias("size"), F.sum("n").alias("n")).first()
    budget = (whole["size"] or 0) * share[0] // share[1]
    digits = 1
    while (whole["n"] or 0) > BUCKET_ROWS * 16**digits:
        digits += 1
    given = shared_out(leaves, budget, weights or WEIGHTS)
    passes = F.when(F.col("size") > 0, quotient(F.col("budget"), F.col("size"))).otherwise(F.lit(0)).cast("int")
    plan = stored(given.withColumn("passes", passes).withColumn("rest", F.col("budget") - F.col("size") * F.col("passes")).drop("cap", "n", "size"))

    placed = rows.join(plan, LEVELS).withColumn("at", place(seed, F.col("passes"), F.col("doc_id")))
    placed = stored(placed.withColumn("bucket", F.substring("at", 1, digits)))
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("t"))
    so_far = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("end", F.sum("t").over(so_far)).select(*LEVELS, "bucket", "end", (F.col("end") - F.col("t")).alias("begin"))
    known = placed.join(ends, [*LEVELS, "bucket"])
    within = F.col("end") <= F.col("rest")
    sure = known.where(within | (F.col("begin") > F.col("rest"))).withColumn("more", within)
    in_order = Window.partitionBy(*LEVELS, "bucket").orderBy("at", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = known.where(~within & (F.col("begin") <= F.col("rest")))
    edge = edge.withColumn("more", F.col("begin") + F.sum("n_tokens").over(in_order) <= F.col("rest"))
    taken = sure.unionByName(edge)
    whole_passes = F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>"))
    epochs = F.when(F.col("more") & (F.col("passes") < max_epochs), F.concat(whole_passes, F.array("passes"))).otherwise(whole_passes)
    return taken.select("doc_id", "_text", *LEVELS, "n_tokens", F.explode(epochs).alias("epoch"), F.col("budget").alias("leaf_budget"))


def keep_mixed(docs: DataFrame, share: tuple[int, int], weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """The rows of docs that are taken in one pass at most, with all their columns."""
    taken = mix(docs, share, max_epochs=1, weights=weights).select(F.col("doc_id").alias("_id"), "_text").distinct()
    return keep_rows(docs, taken)
