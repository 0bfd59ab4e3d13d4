"""URL filters with redirect equivalence, as column functions and joins only.

A rule names a host and a path prefix and blocks or allows; it fits the host and its subdomains, and the longest rule that
fits a URL decides. Pages are aliases of each other if they share a canonical form, be it their own URL's or that of a
canonical link or a meta refresh in their HTML: connected components over these references. If a page or a referred URL
of a component is blocked by rule, the block holds for all its pages that no rule names. A page's own allow rule always
comes before a block that only reached it through aliases.

References are resolved against the page or its base element, with . and .. folded; comments and scripts hold none.

The canonical form of a URL drops the scheme, the default port, the fragment, tracking parameters and closing slashes.

Each canonical form stands for the smallest page_id that has or names it, so edges are stars of long ids; a form that a
third of all pages refer to is folded by min() before the shuffle and joined as a skewed key.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and takes part only through its
HTML; a null html refers to nothing; rows that repeat a page_id count as one page for equivalence and are judged one by
one; a null page_id is judged by its own rules only; references that are not http(s) or paths are ignored; an empty table
gives no rows; URLs and pages of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import ascii_lower, stored
from spanlake.llm.components import components

#: (verdict, host and path)
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
TRACKING = r"(?:utm_[a-z]+|fbclid|gclid|msclkid|mc_eid)"


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def decide(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):  # the last one that fits wins
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def canonical(url: Column) -> Column:
    """host[:port]/path[?query] without what does not tell pages apart; null where there is no host."""
    name = F.regexp_replace(host(url), r":(?:80|443)?$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.rlike(p, F.lit(rf"(?i)^{TRACKING}(?:=|$)")) & (p != "")), "&")
    whole = F.concat(name, F.regexp_replace(path(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(name != "", whole)


def unquoted(value: Column) -> Column:
    """An attribute's value without the character references that URLs need."""
    value = F.trim(value)
    for name, plain in ((r"(?i)&(?:quot|#34|#x22);", '"'), (r"(?i)&(?:apos|#39|#x27);", "'"), (r"(?i)&(?:amp|#38|#x26);", "&")):
        value = F.regexp_replace(value, name, plain)
    return value


def without_dots(whole: Column) -> Column:
    """A path (with its query) whose segments . and .. are resolved, as browsers do; .. at the top is dropped."""
    path, rest = F.regexp_extract(whole, r"(?s)^[^?#]*", 0), F.regexp_extract(whole, r"(?s)^[^?#]*(.*)$", 1)
    parts = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when(p == ".", a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))),
    )
    folder = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise("")
    dotted = F.rlike(path, F.lit(r"/\.{1,2}(?:/|$)"))
    return F.when(dotted, F.concat(F.lit("/"), F.array_join(kept, "/"), folder, rest)).otherwise(whole)


def resolved(found: Column, base: Column) -> Column:
    """The absolute http(s) URL of a reference from a base URL; null if it is empty, a fragment, or of another scheme."""
    u, site, own = unquoted(found), F.concat(F.lit("http://"), host(base)), path(base)
    folder = F.coalesce(F.nullif(F.regexp_replace(own, "[^/]*$", ""), F.lit("")), F.lit("/"))
    here = host(base) != ""
    site_of, path_of = F.regexp_extract(u, r"(?is)^https?://[^/?#]*", 0), F.regexp_extract(u, r"(?is)^https?://[^/?#]*(.*)$", 1)
    return (
        F.when(F.rlike(u, F.lit("(?i)^https?://")), F.concat(site_of, without_dots(path_of)))
        .when(F.startswith(u, F.lit("//")), F.concat(F.lit("http:"), u))
        .when(F.startswith(u, F.lit("/")) & here, F.concat(site, without_dots(u)))
        .when(F.startswith(u, F.lit("?")) & here, F.concat(site, own, u))
        .when(~F.rlike(u, F.lit("^(?:$|#|[A-Za-z][A-Za-z0-9+.-]*:)")) & here, F.concat(site, without_dots(F.concat(folder, u))))
    )


def references(html: Column, url: Column) -> Column:
    """Absolute URLs of the canonical links and meta refreshes in a page, outside comments and scripts; a base element counts."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)", "")
    tags = F.regexp_extract_all(seen, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    href = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
    refresh = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""

    def target(tag: Column) -> Column:
        link = F.rlike(tag, F.lit(r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""))
        meta = F.rlike(tag, F.lit(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""))
        return F.when(link, F.regexp_extract(tag, href, 1)).when(meta, F.regexp_extract(tag, refresh, 1)).otherwise("")

    named = F.regexp_extract(F.regexp_extract(seen, r"(?is)<base\b[^>]*>", 0), href, 1)
    base = F.coalesce(resolved(named, url), url)
    return F.filter(F.transform(F.transform(tags, target), lambda t: resolved(t, base)), lambda u: u.isNotNull())


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and component_id (null for a page without aliases) of every page."""
    rules = RULES if rules is None else rules
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    known = rows.where(F.col("page_id").isNotNull())
    named = known.select("page_id", F.explode(F.concat(F.array("url"), references(F.col("html"), F.col("url")))).alias("u"))
    seen = stored(
        named.select("page_id", canonical(F.col("u")).alias("key"), decide(rules, host(F.col("u")), path(F.col("u")))["verdict"].alias("v"))
        .where(F.col("key").isNotNull())
        .distinct()
    )
    standing = seen.groupBy("key").agg(F.min("page_id").alias("v"), F.max("page_id").alias("_last")).where(F.col("v") < F.col("_last"))
    edges = seen.select(F.col("page_id").alias("u"), "key").join(standing.select("key", "v"), "key").select("u", "v")
    member = components(edges, local=False)
    blocked = seen.where(F.col("v") == "block").select("page_id").distinct()
    # a page without aliases is its own component
    own = blocked.join(member.toDF("page_id", "c"), "page_id", "left").select(F.coalesce("c", "page_id").alias("c")).distinct()
    judged = rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("d", decide(rules, F.col("host"), F.col("path")))
    placed = judged.join(member.toDF("page_id", "component_id"), "page_id", "left")
    placed = placed.withColumn("c", F.coalesce("component_id", "page_id")).join(own.withColumn("hit", F.lit(True)), "c", "left")
    return placed.select(
        "page_id",
        "host",
        "path",
        F.col("d.rule").alias("rule"),
        F.coalesce("d.verdict", F.when(F.col("hit"), F.lit("block")), F.lit("allow")).alias("verdict"),
        "component_id",
    )
