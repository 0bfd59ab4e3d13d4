"""Corpus filters, statistics, vocabularies, out-of-vocabulary coding, label sequence statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import _words
from spanlake.functions.vectors import bound
from spanlake.plans.gram_batches import strings, words
from spanlake.plans.row_batches import pack_rows, unpack_rows
from spanlake.plans.scan import global_index
from spanlake.session import cut_free, shuffle_width

NONE, MAX, MIN, COUNT, SUM, AVERAGE = range(6)


# ---- filters -------------------------------------------------------------------------------


def filter_bitext(df: DataFrame, minlen: int | None = None, maxlen: int | None = None, ratio: float | None = None, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Pairs whose space-separated token counts lie in bounds and whose length ratio is at most ratio.

    An empty side has no ratio and is refused when a ratio is given.
    """
    a, b = (F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, " "))) for c in (src, tgt))
    keep = F.lit(True)
    if minlen is not None:
        keep = keep & (F.least(a, b) >= minlen)
    if maxlen is not None:
        keep = keep & (F.greatest(a, b) <= maxlen)
    if ratio is not None:
        keep = keep & F.coalesce(F.try_divide(F.greatest(a, b), F.least(a, b)) <= ratio, F.lit(False))
    return df.where(keep)


def first_hypothesis(df: DataFrame, src: str = "src_id", order: str = "hyp_id") -> DataFrame:
    w = Window.partitionBy(src).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def select_examples(df: DataFrame, metric: str, threshold: float, verb: str = "verb", noun: str = "noun") -> DataFrame:
    return df.where((F.col(metric) >= threshold) & (F.coalesce(verb, F.lit("")) != "") & (F.coalesce(noun, F.lit("")) != ""))


def _side_lengths(cols: list[str]) -> list[Column]:
    return [F.size(_words(F.col(c))) for c in cols]


def filter_token_length(df: DataFrame, lo: int, hi: int, cols: list[str]) -> DataFrame:
    """Aligned rows of which every side has lo to hi tokens and is not blank."""
    keep = F.lit(True)
    for n in _side_lengths(cols):
        keep = keep & (n > 0) & n.between(lo, hi)
    return df.where(keep)


def token_length_report(df: DataFrame, lo: int, hi: int, cols: list[str]) -> DataFrame:
    """Numbers of rows with a blank side, of rows out of bounds and of rows kept."""
    lens = F.array(*_side_lengths(cols))
    empty = F.array_min(lens) == 0
    out = ~empty & ((F.array_min(lens) < lo) | (F.array_max(lens) > hi))
    return df.agg(
        F.count(F.when(empty, 1)).alias("n_empty"), F.count(F.when(out, 1)).alias("n_filtered"),
        F.count(F.when(~empty & ~out, 1)).alias("n_kept"),
    )


def filter_narrations(df: DataFrame) -> DataFrame:
    """Accepted and valid actions of the camera wearer."""
    return df.where(~F.col("is_rejected") & F.col("is_valid_action") & F.col("narration_text").rlike(r"(?i)^#C C"))


def first_structured_noun(frames: Column) -> Column:
    """First noun of an object_of_change box in the first pnr frame, else null."""
    pnr = F.get(F.filter(frames, lambda f: f["frame_type"] == "pnr_frame"), F.lit(0))
    boxes = F.filter(
        pnr["boxes"], lambda b: (b["object_type"] == "object_of_change") & b["structured_noun"].isNotNull()
    )
    return F.get(boxes, F.lit(0))["structured_noun"]


def structured_query(df: DataFrame, agg: int, sel: str, conds: list[tuple[str, str, object]]) -> DataFrame:
    """Declarative select: AND of (column, =|>|<, value) conditions, then NONE, MAX, MIN, COUNT, SUM or AVERAGE.

    Texts compare by their lower-cased word and symbol tokens, numbers as doubles. COUNT of nothing
    is 0, every other aggregate of nothing is null, NONE gives the matching values.
    """

    def tokens(c: Column) -> Column:
        return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+|[^\w\s]+)"), 1)

    keep = F.lit(True)
    for name, op, value in conds:
        if isinstance(value, str):
            left, right = tokens(F.col(name)), tokens(F.lit(value))
        else:
            left, right = F.col(name).cast("double"), F.lit(float(value))
        keep = keep & {"=": left == right, ">": left > right, "<": left < right}[op]
    rows = df.where(keep)
    col = F.col(sel)
    if agg == NONE:
        return rows.select(col.alias("answer"))
    value = {
        MAX: F.max(col), MIN: F.min(col), COUNT: F.count(F.lit(1)).cast("double"),
        SUM: F.sum(col.cast("double")) if agg == SUM else None,
        AVERAGE: F.avg(col.cast("double")) if agg == AVERAGE else None,
    }[agg]
    return rows.agg(value.alias("answer"))


# ---- statistics ----------------------------------------------------------------------------


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents, mean of their non-blank lines and mean of their whitespace tokens."""
    lines = F.size(F.filter(F.split(text, "\n"), lambda s: F.trim(s) != ""))
    return docs.agg(
        F.count("*").alias("n_docs"), F.avg(lines).alias("mean_lines"), F.avg(F.size(_words(F.col(text)))).alias("mean_tokens")
    )


def build_vocab(df: DataFrame, tokens: Column, specials: int = 4, min_count: int = 1) -> DataFrame:
    """(symbol, n, symbol_id): symbols by count, then text; ids are dense after the specials."""
    counts = df.select(F.explode(tokens).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))
    idx = global_index(counts.where(F.col("n") >= min_count), [F.col("n").desc(), F.col("symbol")], "_i")
    return idx.select("symbol", "n", (F.col("_i") + specials).alias("symbol_id"))


def vector_mean(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Element-wise mean of the arrays of a key; positions aggregate separately, so combining precedes the shuffle."""
    pos = df.select(*keys, F.posexplode(vec).alias("_p", "_x"))
    means = pos.groupBy(*keys, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    lists = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_p", "_m"))).alias("_l"))
    return lists.select(*keys, F.transform("_l", lambda x: x["_m"]).alias(vec))


def joint_label_stats(refs: DataFrame, hyps: DataFrame, key: str = "uid", pos: str = "pos", label: str = "label") -> DataFrame:
    """Purity both ways, mutual information, its share of either entropy, and the entropies.

    Sequences are rows (key, pos, label) with pos from 0; those of one key are aligned from the start and cut to the shorter. A
    long sequence is spread, as each position is joined on its own.
    """
    r = refs.select(key, pos, F.col(label).alias("r"))
    cells = r.join(hyps.select(key, pos, F.col(label).alias("h")), [key, pos]).groupBy("r", "h").agg(F.count("*").alias("c"))
    total = cells.agg(F.sum("c").alias("tot"))
    p = cells.join(F.broadcast(total)).select("r", "h", (F.col("c") / F.col("tot")).alias("p"))  # total is one row
    px = p.groupBy("r").agg(F.sum("p").alias("px"), F.max("p").alias("mx"))
    py = p.groupBy("h").agg(F.sum("p").alias("py"), F.max("p").alias("my"))
    mi = p.join(px, "r").join(py, "h").agg(
        F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")) + 1e-8)).alias("mi")
    )
    hx = px.agg((-F.sum(F.col("px") * F.log(F.col("px") + 1e-8))).alias("h_ref"), F.sum("mx").alias("ref_purity"))
    hy = py.agg((-F.sum(F.col("py") * F.log(F.col("py") + 1e-8))).alias("h_hyp"), F.sum("my").alias("hyp_purity"))
    return mi.join(F.broadcast(hx)).join(F.broadcast(hy)).select(  # three one-row tables
        "ref_purity", "hyp_purity", "mi", F.try_divide("mi", "h_ref").alias("mi_by_ref"),
        F.try_divide("mi", "h_hyp").alias("mi_by_hyp"), "h_ref", "h_hyp",
    )


def inception_score(preds: DataFrame, splits: int, order: list[str], probs: str = "probs") -> DataFrame:
    """Mean and deviation over contiguous splits of exp(mean KL(p(y|x) || p(y)))."""
    idx = global_index(preds.select(*order, probs), [F.col(c) for c in order], "_i")
    size = preds.agg(F.floor(F.count("*") / splits).alias("_m"))
    part = (
        idx.join(F.broadcast(size))  # one row
        .withColumn("split", F.floor(F.col("_i") / F.col("_m")).cast("int"))
        .where(F.col("split") < splits)
        .select("split", probs)
    )
    mean = vector_mean(part, ["split"], probs).withColumnRenamed(probs, "_q")

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    sp, sq = total(F.transform(probs, lambda x: x.cast("double"))), total(F.col("_q"))
    kl = total(
        F.zip_with(
            probs, "_q",
            lambda a, b: F.when(a > 0, a / F.col("_sp") * F.log((a / F.col("_sp")) / (b / F.col("_sq")))).otherwise(0.0),
        )
    )
    per = (
        part.join(F.broadcast(mean), "split")  # one row per split
        .withColumn("_sp", sp).withColumn("_sq", sq)
        .groupBy("split").agg(F.exp(F.avg(kl)).alias("s"))
    )
    return per.agg(F.avg("s").alias("mean_score"), F.stddev_pop("s").alias("std_score"))


# ---- out-of-vocabulary words ---------------------------------------------------------------


def encode_oov(df: DataFrame, vocab: DataFrame, ident: str = "id", src: str = "src", tgt: str = "tgt", symbol: str = "symbol", keep: tuple[str, ...] = ()) -> DataFrame:
    """Unknown source words become <unk-N>, N their first position; target words follow their source word. Columns of keep stay as they are.

    Rows are packed into compressed batches. Each different word of a batch's sources moves once to meet the vocabulary, and the
    unknown ones come back as one list a batch.
    """
    cols = [F.col(ident).alias("_id"), F.col(src).cast("string").alias("_s"), F.col(tgt).cast("string").alias("_t"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]]
    flat = df.select(*cols)
    width = shuffle_width(df.sparkSession)
    packed = cut_free(pack_rows(flat))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                texts, own = unpack_rows(rows.column("texts")[i].as_py(), rows.column("rows")[i].as_py())
                found = set()
                for s in strings(texts.take(own.column("_s").drop_null().unique())):
                    found.update(words(s))
                tok = pa.array(sorted(found), pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(rows.column("batch")[i], len(tok)), tok], names=["batch", "tok"])

    known = vocab.select(F.col(symbol).alias("tok")).distinct()
    unknown = packed.mapInArrow(met, "batch long, tok string").join(known, "tok", "left_anti")
    lost = cut_free(unknown.groupBy("batch").agg(F.array_join(F.collect_list("tok"), " ").alias("lost")))
    names = ["_id", "_s", "_t", *[f"_k{i}" for i in range(len(keep))]]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(source: str | None, target: str | None, unknown: set[str]) -> tuple[str, str]:
            # a batch holds texts; their words are cut row by row
            s, t = (words(x) if x else [] for x in (source, target))
            first = {}
            for i, w in enumerate(s):
                if w in unknown and w not in first:
                    first[w] = f"<unk-{i}>"
            return " ".join([first.get(w, w) for w in s]), " ".join([first.get(w, w) for w in t])

        for rows in batches:
            for i in range(rows.num_rows):
                texts, own = unpack_rows(rows.column("texts")[i].as_py(), rows.column("rows")[i].as_py())
                absent = set((rows.column("lost")[i].as_py() or "").split(" "))
                pairs = (strings(texts.take(own.column(c))) for c in ("_s", "_t"))
                out = list(zip(*[one(s, t, absent) for s, t in zip(*pairs)]))
                columns = {"_s": pa.array(out[0], pa.string()), "_t": pa.array(out[1], pa.string())}
                for c in names:
                    if c not in columns:
                        columns[c] = texts.take(own.column(c)) if c in text else own.column(c)
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    kind = {f.name: f.dataType.simpleString() for f in flat.schema}
    text = {c for c in names if kind[c] == "string"}
    # a merge join: batches are far larger than their estimate
    rows = packed.repartition(width, "batch").join(lost.hint("merge"), "batch", "left").select("texts", "rows", "lost")
    done = rows.mapInArrow(coded, ", ".join(f"`{c}` {kind[c]}" for c in names))
    return done.select(F.col("_id").alias(ident), F.col("_s").alias(src), F.col("_t").alias(tgt), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def decode_oov(src: Column, tgt: Column) -> Column:
    """<unk-N> in the target becomes source word N; a position beyond the source is an error."""

    def filled(known: Column) -> Column:
        def one(t: Column) -> Column:
            pos = F.regexp_extract(t, r"^<unk-([0-9]+)>$", 1)
            at = F.when(pos != "", pos.cast("int"))
            bad = F.raise_error(F.concat(F.lit("position outside the source: "), t))
            return F.when(at.isNull(), t).when(at >= F.size(known), bad).otherwise(F.get(known, at))

        return F.array_join(F.transform(_words(tgt), one), " ")

    # the source is cut into words once
    return bound(_words(src), filled)
