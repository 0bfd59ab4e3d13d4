"""Registered queries of the training-data operators and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import (
    chat_windows,
    language_id,
    license_rules,
    mixture_tree,
    near_dedup,
    packing_tiers,
    period_runs,
    quality_llr,
    repeat_index,
    spelling_forms,
    token_counts,
    url_equivalence,
    vp_search,
)
from spanlake.llm.common import table, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn

#: Word shingles of op5 and their links, components by reachability.
ORACLES["op5_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM words),
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sets x ON x.doc_id = a.doc_id JOIN sets y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * (any_value(len(x.s)) + any_value(len(y.s)) - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
least AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM sets JOIN least ON u = doc_id
"""


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_tiers.pack(table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.language_model(docs))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(table(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("_text")


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents")).drop("_text")


@query
def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_tree.mix(table(spark, sf_dir, "documents")).drop("_text")


def _shares(level: str, node: str, parent: str | None) -> str:
    """CTE that shares the budget of a level's parents among its nodes, as mixture_tree.shared_out does."""
    weights = "".join(f" WHEN '{k}' THEN {w}" for k, w in mixture_tree.WEIGHTS[level].items())
    by = f"PARTITION BY {parent}" if parent else ""
    above, on = (f"JOIN {parent.split(', ')[-1]}_given USING ({parent})", "b") if parent else ("", "(SELECT sum(size) // 2 FROM leaves)")
    return f"""
{level}_nodes AS (
  SELECT {node}, sum(cap)::HUGEINT AS cap, (CASE {level}{weights} ELSE 1 END)::HUGEINT AS w FROM leaves GROUP BY {node}),
{level}_full AS (
  SELECT *, {on}::HUGEINT AS whole,
    cap * sum(w) OVER ({by} ORDER BY cap::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= w * ({on}::HUGEINT
      - coalesce(sum(cap) OVER ({by} ORDER BY cap::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled
  FROM {level}_nodes {above}),
{level}_given AS (
  SELECT {node}, CASE WHEN filled THEN cap ELSE (whole - coalesce(sum(cap) FILTER (filled) OVER ({by}), 0)) * w
    // sum(w) FILTER (NOT filled) OVER ({by}) END AS b FROM {level}_full)"""


_DOMAIN = "coalesce(CASE TRY_CAST(substr(source, 4, 9) AS INT) % 4" + "".join(f" WHEN {i} THEN '{d}'" for i, d in enumerate(mixture_tree.DOMAINS)) + " END, 'unknown')"
ORACLES["op8_mixture"] = rf"""
WITH rows AS (
  SELECT doc_id, {_DOMAIN} AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS size, 2 * sum(n_tokens) AS cap FROM rows GROUP BY ALL),
{_shares("domain", "domain", None)},
{_shares("lang", "domain, lang", "domain")},
{_shares("source", "domain, lang, source", "domain, lang")},
plan AS (
  SELECT domain, lang, source, b::BIGINT AS leaf_budget, CASE WHEN size > 0 THEN b // size ELSE 0 END AS passes, size
  FROM leaves JOIN source_given USING (domain, lang, source)),
runs AS (
  SELECT rows.*, leaf_budget, passes, unnest(range(2)) AS epoch, size FROM rows JOIN plan USING (domain, lang, source)),
placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('11:' || epoch || ':' || doc_id), doc_id
    ROWS UNBOUNDED PRECEDING) AS so_far FROM runs)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS INT) AS epoch, leaf_budget FROM placed
WHERE epoch < passes OR (epoch = passes AND so_far <= leaf_budget - size * passes)
"""


@query
def op6_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_equivalence.judge(table(spark, sf_dir, "pages"))


@query
def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    return chat_windows.digests(chat_windows.windows(turns.union(odd)))


#: Windows from running sums, repeated turns from the rows before them; BUDGET, HISTORY and TURN_COST as in chat_windows.
ORACLES["op9_chat_windows"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
sized AS (
  SELECT *, (octet_length(encode(text)) + 3) // 4 + {chat_windows.TURN_COST} AS n,
    {len('<turn role="">')} + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'))
      + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) + {len(chat_windows.TAIL)} AS chars FROM turns),
placed AS (
  SELECT *, row_number() OVER o - 1 AS pos, sum(n) OVER o - n AS before FROM sized
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
spans AS (
  SELECT conv_id, before // {chat_windows.BUDGET // 2} AS win, min(pos) AS f, sum(n) AS cost, sum(chars) AS chars FROM placed GROUP BY ALL),
system AS (SELECT conv_id, min(pos) AS spos, arg_min(n, pos) AS sn, arg_min(chars, pos) AS schars FROM placed WHERE role = 'system' GROUP BY conv_id),
started AS (
  SELECT spans.*, spos, coalesce(sn, 0) AS sn, coalesce(schars, 0) AS schars FROM spans LEFT JOIN system ON spans.conv_id = system.conv_id AND spos < f),
past AS (
  SELECT s.conv_id, win, p.chars, sum(p.n) OVER (PARTITION BY s.conv_id, win ORDER BY p.pos DESC) AS upto, {chat_windows.BUDGET} - cost - sn AS room
  FROM started s JOIN placed p ON p.conv_id = s.conv_id AND p.pos BETWEEN f - {chat_windows.HISTORY} AND f - 1 AND p.pos IS DISTINCT FROM spos),
formatted AS (
  SELECT conv_id, sum(chars + schars) + coalesce((SELECT sum(chars) FROM past WHERE past.conv_id = started.conv_id AND upto <= room), 0) AS c
  FROM started GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(any_value(c) AS BIGINT) AS formatted_chars
FROM placed JOIN formatted USING (conv_id) GROUP BY conv_id
"""


def _fits(verdict_or_rule: int) -> str:
    """CASE over the rules, the longest first."""
    arms = ""
    for pair in sorted(url_equivalence.RULES, key=lambda r: -len(r[1])):
        name, slash, rest = pair[1].partition("/")
        arms += f" WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}') THEN '{pair[verdict_or_rule]}'"
    return f"CASE{arms} END"


_HOST = "translate(regexp_extract(coalesce({u}, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce({u}, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
#: References, canonical forms, components by reachability, and block decisions carried over them.
ORACLES["op6_url_equivalence"] = rf"""
WITH RECURSIVE judged AS (
  SELECT *, {_fits(1)} AS rule, {_fits(0)} AS own FROM (
    SELECT page_id, url, html, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path FROM pages)),
tags AS (
  SELECT page_id, host, path, unnest(regexp_extract_all(coalesce(html, ''), '<(?:link|meta)\b[^>]*>', 0, 'is')) AS tag FROM judged),
named AS (
  SELECT page_id, host, path, replace(trim(CASE
    WHEN regexp_matches(tag, '^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b', 'is')
      THEN regexp_extract(tag, '\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is')
    WHEN regexp_matches(tag, '^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b', 'is')
      THEN regexp_extract(tag, '\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is')
    ELSE '' END), '&amp;', '&') AS t FROM tags),
urls AS (
  SELECT page_id, url AS u FROM judged
  UNION ALL
  SELECT page_id, CASE WHEN regexp_matches(t, '^https?://', 'i') THEN t
    WHEN starts_with(t, '//') THEN 'http:' || t
    WHEN starts_with(t, '/') AND host <> '' THEN 'http://' || host || t
    WHEN NOT regexp_matches(t, '^(?:$|#|[A-Za-z][A-Za-z0-9+.-]*:)') AND host <> ''
      THEN 'http://' || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || t END FROM named),
seen AS (
  SELECT DISTINCT page_id, own, name || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key FROM (
    SELECT page_id, path, {_fits(0)} AS own, regexp_replace(host, ':(?:80|443)?$', '') AS name,
      array_to_string(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1, 's'), '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '^{url_equivalence.TRACKING}(?:=|$)', 'i')), '&') AS q
    FROM (SELECT page_id, u, {_HOST.format(u="u")} AS host, {_PATH.format(u="u")} AS path FROM urls)) WHERE name <> ''),
links AS (SELECT DISTINCT a.page_id AS u, b.page_id AS v FROM seen a JOIN seen b USING (key) WHERE a.page_id <> b.page_id),
reach AS (
  SELECT DISTINCT u, u AS v FROM links
  UNION
  SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
least AS (SELECT u AS page_id, min(v) AS component_id FROM reach GROUP BY u),
hit AS (
  SELECT DISTINCT coalesce(component_id, page_id) AS c FROM (SELECT page_id FROM seen WHERE own = 'block') LEFT JOIN least USING (page_id))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN c IS NOT NULL THEN 'block' END, 'allow') AS verdict, component_id
FROM judged LEFT JOIN least USING (page_id) LEFT JOIN hit ON c = coalesce(component_id, page_id)
"""


@query
def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.nearest(table(spark, sf_dir, "embeddings"))


#: Every usable vector against every query, nearest first.
ORACLES["op1_nearest_vectors"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """One document in ten, by the crc32 h of its id, repeats its words with a period from a place on that h gives."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n = F.size("w").cast("long")
    g = F.floor(h / 10).cast("long")
    a = F.when(n > 0, F.pmod(g, n))
    period = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
    drawn = docs.select("doc_id", "text", words(F.col("text")).alias("w")).select("doc_id", "text", "w", a.alias("a"), period.alias("p"), (h % 10 == 0).alias("hit"))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return drawn.select("doc_id", F.when(F.col("hit") & (F.size("w") > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.period_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    # exact comparison of length / period; runs come by start, then period, and the first of equal ones stays
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda m, x: F.when(x["length"] * m["period"] > m["length"] * x["period"], x).otherwise(m))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    one = found.select("*", best.alias("b"))
    return one.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"b.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op13_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("d"), F.explode(spelling_forms.lowered_runs(F.col("text"))).alias("w"))
    h = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary"))
    at = F.pmod(h, F.char_length("w")).cast("int")
    less = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
    words = docs.select(F.when(h % 97 == 0, less).otherwise(F.col("w")).alias("word"))
    return spelling_forms.forms(spelling_forms.counted(words)).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 bit by bit, words without one code point as the join key of near words, chains of forms by recursion.
ORACLES["op13_spelling_forms"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) r(b))),
drawn AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS k FROM drawn GROUP BY ALL),
hashed AS (
  SELECT w, k, xor(4294967295, list_reduce(
    list_transform(range(octet_length(encode(s))::BIGINT), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295)) AS h
  FROM (SELECT w, k, doc_id || ':' || w AS s FROM each), crc_table),
formed AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
counts AS (SELECT word, sum(k)::BIGINT AS n FROM formed WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM counts)),
pairs AS (
  SELECT a.word AS u, b.word AS v FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, c.word FROM cut a JOIN counts c ON a.rest = c.word
  UNION
  SELECT c.word, a.word FROM cut a JOIN counts c ON a.rest = c.word),
best AS (
  SELECT u AS word, count(*) AS n_near, arg_min(v, (-c.n, v)) AS w, max(c.n) AS m FROM pairs JOIN counts c ON c.word = v GROUP BY u),
told AS (
  SELECT counts.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN w END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM counts LEFT JOIN best USING (word)),
chain AS (
  SELECT word, coalesce(form, word) AS up, 0 AS d FROM told
  UNION ALL
  SELECT chain.word, told.form, d + 1 FROM chain JOIN told ON told.word = up WHERE told.form IS NOT NULL AND told.form <> up)
SELECT word, form, root, n, n_near, form_n
FROM told JOIN (SELECT word, arg_max(up, d) AS root FROM chain GROUP BY word) USING (word)
"""


@query
def op11_repeat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeat_index.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.reduce("removed", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
