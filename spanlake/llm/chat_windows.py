"""Chat formatting in budgeted windows, as column functions and joins only.

Running sums of turn tokens cut a conversation into spans of whole turns: a turn belongs to the span in whose stretch of
budget / 2 tokens it begins. Each span becomes a window that repeats the conversation's first system turn and as many of the
last HISTORY turns before the span as the rest of the budget allows. Every assistant turn is a target in the one window that
brings it first; repeated turns are masked. A window exceeds the budget only by a turn of more than half of it.

Template: <turn role="ROLE">TEXT</turn> and a line break for each turn. In roles and texts & < " are written as &amp; &lt;
&quot; so no control string of the template can occur inside, and reading back is exact. The loss mask is a list of spans
(start, length) in code points of the formatted text.

Running sums are taken by the library's ordered scan, so a conversation of any length is spread over tasks; a window holds a
bounded number of turns, since each costs some tokens at least. Only `digests` joins all windows of a conversation, which
its hashes over whole conversations ask for.

Defined cases: a null text or role is empty; rows that repeat a turn are all kept, ordered by turn, role and text; a null
turn comes first; rows with a null conv_id form one conversation; a conversation without system turn repeats none; an
empty table gives no rows; texts of any length are kept whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.plans.scan import ordered_scan

BUDGET = 512
HISTORY = 2
TURN_COST = 4
TAIL = "</turn>\n"
TURN = r'<turn role="([^<"]*)">([^<]*)</turn>\n'


def escaped(c: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(name))
    return c


def unescaped(c: Column) -> Column:
    for plain, name in (('"', "&quot;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(name), F.lit(plain))
    return c


def tokens(text: Column) -> Column:
    """A turn's cost: four bytes a token, and the marks."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + TURN_COST


def head(role: Column) -> Column:
    return F.concat(F.lit('<turn role="'), escaped(role), F.lit('">'))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, n_repeated, n_new, n_tokens, formatted and loss (array of start, length), one row per window."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_c"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("n", tokens(F.col("text")))
    outputs = {"pos": ("sum", F.lit(1).cast("long"), False), "before": ("sum", F.col("n"), False)}
    placed = ordered_scan(rows, ["_c"], [F.col("turn"), F.col("role"), F.col("text")], outputs)
    placed = placed.withColumn("window", F.floor(F.col("before") / (budget // 2)).cast("long"))
    turn = F.struct("pos", "role", "text", "n")
    spans = placed.groupBy("_c", "window").agg(
        F.first("conv_id").alias("conv_id"), F.min("pos").alias("first"), F.sum("n").alias("cost"), F.sort_array(F.collect_list(turn)).alias("new")
    )
    system = placed.where(F.col("role") == "system").groupBy("_c").agg(F.min(turn).alias("system"))
    started = spans.join(system, "_c", "left").withColumn("system", F.when(F.col("system.pos") < F.col("first"), F.col("system")))
    # the turns right before a span, found by their positions
    wanted = started.where(F.col("first") > 0).select("_c", "window", "system", F.explode(F.sequence(F.greatest(F.lit(0), F.col("first") - history), F.col("first") - 1)).alias("pos"))
    wanted = wanted.where(~F.coalesce(F.col("system.pos") == F.col("pos"), F.lit(False))).select("_c", "window", "pos")
    past = wanted.join(placed.select("_c", "pos", "role", "text", "n"), ["_c", "pos"]).groupBy("_c", "window")
    with_past = started.join(past.agg(F.sort_array(F.collect_list(turn), asc=False).alias("past")), ["_c", "window"], "left")

    room = F.lit(budget) - F.col("cost") - F.coalesce("system.n", F.lit(0))
    kind = "array<struct<pos:bigint,role:string,text:string,n:bigint>>"
    fits = F.aggregate(
        F.coalesce("past", F.array().cast(kind)),
        F.struct(room.cast("long").alias("room"), F.array().cast(kind).alias("kept")),
        lambda a, t: F.struct(
            (a["room"] - t["n"]).alias("room"), F.when(a["room"] >= t["n"], F.concat(F.array(t), a["kept"])).otherwise(a["kept"]).alias("kept")
        ),
        lambda a: a["kept"],
    )
    none = F.array().cast(kind)
    parts = with_past.select(
        "conv_id",
        "window",
        F.concat(F.when(F.col("system").isNotNull(), F.array("system")).otherwise(none), fits).alias("old"),
        "new",
    )
    drawn = lambda c, target: F.transform(
        c, lambda t: F.struct(head(t["role"]).alias("head"), escaped(t["text"]).alias("body"), ((t["role"] == "assistant") & F.lit(target)).alias("mine"))
    )
    pieces = parts.select(
        "conv_id",
        "window",
        F.size("old").alias("n_repeated"),
        F.size("new").alias("n_new"),
        F.aggregate(F.concat("old", "new"), F.lit(0).cast("long"), lambda a, t: a + t["n"]).alias("n_tokens"),
        F.concat(drawn(F.col("old"), False), drawn(F.col("new"), True)).alias("p"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def mark(a: Column, p: Column) -> Column:
        begin, size = a["at"] + F.char_length(p["head"]), F.char_length(p["body"])
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct((begin + size + len(TAIL)).alias("at"), F.when(p["mine"], F.concat(a["loss"], span)).otherwise(a["loss"]).alias("loss"))

    return pieces.select(
        "conv_id",
        "window",
        "n_repeated",
        "n_new",
        "n_tokens",
        F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), "").alias("formatted"),
        F.aggregate("p", start, mark, lambda a: a["loss"]).alias("loss"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What reads back from the windows of each conversation, as counts and hashes."""
    found = lambda group: F.regexp_extract_all("formatted", F.lit(TURN), F.lit(group))
    new = lambda group: F.slice(found(group), F.col("n_repeated") + 1, F.col("n_new"))
    read = formatted.select(
        "conv_id",
        "window",
        F.char_length("formatted").alias("chars"),
        F.zip_with(new(1), new(2), lambda r, t: F.concat(unescaped(r), F.lit("\n"), unescaped(t), F.lit("\n"))).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["length"]))), "").alias("loss"),
    )
    joined = read.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", F.array_join("turns", "").alias("t"), "loss"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    whole = lambda field: F.array_join(F.transform("w", lambda w: w[field]), "")
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(whole("t").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(whole("loss")).cast("long").alias("loss_chars"),
        F.sha2(whole("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
