import hashlib
import random

from pyspark.sql import functions as F

from spanlake.llm import chat_windows, mixture_tree, url_equivalence
from tests.llm.helpers import TEXTS, clashing, no_docs, odd_docs


# mixture


def brute_fill(budget, nodes):
    """Shares of sibling nodes (name, weight, cap)."""
    given, left, open_nodes = {}, budget, sorted(nodes, key=lambda n: (n[2] / n[1], n[0]))
    while open_nodes:
        name, w, cap = open_nodes[0]
        if cap * sum(n[1] for n in open_nodes) <= w * left:
            given[name] = cap
            left -= cap
            open_nodes.pop(0)
        else:
            total = sum(n[1] for n in open_nodes)
            given |= {n[0]: left * n[1] // total for n in open_nodes}
            break
    return given


def test_shares_go_to_siblings_before_ancestors(spark):
    leaves = [("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 1000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, cap long").withColumnRenamed("cap", "size")
    df = df.withColumn("cap", df["size"])
    weights = {"domain": {"web": 1, "books": 1}, "lang": {"en": 1, "de": 1}}
    got = {r.source: r.budget for r in mixture_tree.shared_out(df, 800, weights).collect()}
    # a holds 10 of its 100; b, its sibling, takes the other 90, and nothing leaves their language
    assert got == {"a": 10, "b": 190, "c": 200, "d": 400}
    got = {r.source: r.budget for r in mixture_tree.shared_out(df, 2600, weights).collect()}
    assert got == {"a": 10, "b": 790, "c": 800, "d": 1000} or sum(got.values()) in (2600, 2599, 2598)


def test_mixture_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r for r in mixture_tree.measured(docs).collect()]
    got = mixture_tree.mix(clashing(docs), (3, 2), 2).collect()
    leaf = lambda r: (r.domain, r.lang, r.source)
    size = {}
    for r in rows:
        size[leaf(r)] = size.get(leaf(r), 0) + r.n_tokens
    weight = lambda level, name: mixture_tree.WEIGHTS[level].get(name, 1)
    cap = {k: 2 * v for k, v in size.items()}
    budgets = {(): sum(size.values()) * 3 // 2}
    for depth, level in enumerate(mixture_tree.LEVELS):
        below = {}
        for node, b in budgets.items():
            names = {k[depth] for k in cap if k[:depth] == node}
            nodes = [(n, weight(level, n), sum(c for k, c in cap.items() if k[: depth + 1] == (*node, n))) for n in names]
            below |= {(*node, n): x for n, x in brute_fill(b, nodes).items()}
        budgets = below
    want = set()
    for k, b in budgets.items():
        own = [r for r in rows if leaf(r) == k]
        for epoch in range(2):
            so_far = epoch * size[k]
            for r in sorted(own, key=lambda r: (hashlib.md5(f"11:{epoch}:{r.doc_id}".encode()).hexdigest(), r.doc_id)):
                so_far += r.n_tokens
                if so_far <= b and (epoch + 1) * size[k] <= b or epoch == b // max(1, size[k]) and so_far <= b:
                    want.add((r.doc_id, epoch))
    assert {(r.doc_id, r.epoch) for r in got} == want and len(got) == len(want)
    assert {leaf(r): r.leaf_budget for r in got}.items() <= budgets.items()


def test_mixture_of_odd_rows(spark):
    rows = mixture_tree.mix(odd_docs(spark), (1, 1), 1).collect()
    assert len(rows) == len(TEXTS)
    assert {(r.lang, r.source, r.domain) for r in rows if r.doc_id in (3, 4, 6)} == {("unknown", "src0", "web"), ("de", "unknown", "unknown"), ("unknown", "odd", "unknown")}
    assert mixture_tree.mix(no_docs(spark)).count() == 0
    kept = mixture_tree.keep_mixed(odd_docs(spark), (1, 1))
    assert kept.count() == len(TEXTS) and kept.columns == odd_docs(spark).columns


# URL filters


def page(i, url, *tags):
    return (i, url, "<html><head>" + "".join(tags) + "</head></html>")


PAGES = [
    page(1, "http://a.example.net/es/1"),
    page(2, "https://mirror.example.org/x", '<link rel="canonical" href="http://a.example.net/es/1/">'),
    page(3, "https://other.example.org/y?utm_source=feed#top", "<META HTTP-EQUIV='refresh' CONTENT='0; URL=https://mirror.example.org/x'>"),
    page(4, "http://shop.example.com/z", "<link href=https://mirror.example.org:443/x rel=canonical>"),
    page(5, "http://other.example.org:80/y/"),
    page(6, "http://alone.example.org/en/", '<link rel="stylesheet" href="http://a.example.net/es/1">'),
    page(7, "http://out.example.org/q", '<link rel="canonical" href="http://gone.net/fr/home">'),
    page(8, "http://Out.Example.org/sub/p", '<link rel="canonical" href="../r">', '<link rel=canonical href="/q">'),
    page(9, "https://www.example.com/en/1"),
    page(10, "https://example.com/en/1?x=1&fbclid=2"),
    page(11, "HTTP://User@EXAMPLE.com:8080?q=a/b"),
    page(12, None, '<link rel="canonical" href="http://a.example.net/es/1">'),
    page(13, "no scheme", '<link rel="canonical" href="relative">'),
    (14, "http://nohtml.example.org/", None),
    page(14, "http://nohtml.example.org/"),
    page(None, "http://a.example.net/es/1"),
    page(15, "http://xcom/", '<link rel="canonical" href="javascript:void(0)">'),
]


def test_blocks_reach_aliases_and_allow_comes_first(spark):
    rows = url_equivalence.judge(clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string"))).collect()
    assert len(rows) == len(PAGES)
    got = {r.page_id: (r.verdict, r.rule) for r in rows}
    assert got == {
        1: ("block", "net/es/"), 2: ("block", None), 3: ("block", None), 4: ("allow", "com/"), 5: ("block", None), 6: ("allow", None),
        7: ("block", None), 8: ("block", None), 9: ("allow", "www.example.com/en/"), 10: ("block", "example.com/en/"), 11: ("allow", None),
        12: ("block", None), 13: ("allow", None), 14: ("allow", None), None: ("block", "net/es/"), 15: ("allow", None),
    }
    place = {r.page_id: (r.host, r.path) for r in rows}
    assert place[11] == ("user@example.com:8080", "") and place[12] == ("", "") and place[13] == ("", "")
    parts = {r.page_id: r.component_id for r in rows}
    assert {parts[i] for i in (1, 2, 3, 4, 5, 12)} == {1} and parts[7] == parts[8] == 7 and parts[6] is None
    assert url_equivalence.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_references_are_resolved_as_browsers_do(spark):
    base = "https://a.example.org/x/y/page.html?q=1#top"
    link = lambda u: f'<link rel="canonical" href="{u}">'
    cases = [
        (link("../r"), ["http://a.example.org/x/r"]),
        (link("../../../../r"), ["http://a.example.org/r"]),
        (link("./s/./t/.."), ["http://a.example.org/x/y/s/"]),
        (link("..") , ["http://a.example.org/x/"]),
        (link("/u/../v?w=../x"), ["http://a.example.org/v?w=../x"]),
        (link("?x=1&amp;y=2"), ["http://a.example.org/x/y/page.html?x=1&y=2"]),
        (link("z?a&#38;b&#x26;c"), ["http://a.example.org/x/y/z?a&b&c"]),
        (link("http://b.example.org/c/../d/"), ["http://b.example.org/d/"]),
        (link("//b.example.org/c"), ["http://b.example.org/c"]),
        (link("#here") + link("") + link("mailto:x@y") + link("javascript:void(0)"), []),
        ('<base href="/other/deep/">' + link("r"), ["http://a.example.org/other/deep/r"]),
        ('<BASE target=_top href=https://c.example.org/k/l>' + link("m"), ["http://c.example.org/k/m"]),
        ("<!-- " + link("/gone") + " -->" + link("/kept") + "<!--" + link("/open"), ["http://a.example.org/kept"]),
        ("<script>var s = '" + link("/gone") + "'</script >" + link("/kept"), ["http://a.example.org/kept"]),
        ("<meta http-equiv=refresh content='5; url=../n'>", ["http://a.example.org/x/n"]),
    ]
    df = spark.createDataFrame([(i, html, base) for i, (html, _) in enumerate(cases)], "i int, html string, url string")
    got = {r.i: r.u for r in df.select("i", url_equivalence.references(F.col("html"), F.col("url")).alias("u")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    bare = spark.createDataFrame([(link("/x"), None), (None, base), (link("../x"), "no scheme")], "html string, url string")
    assert [r.u for r in bare.select(url_equivalence.references(F.col("html"), F.col("url")).alias("u")).collect()] == [[], [], []]


def test_a_form_that_very_many_share_is_one_component(spark):
    rows = [page(i, f"http://h{i}.example.org/", '<link rel="canonical" href="http://hub.net/es/">') for i in range(500)]
    got = url_equivalence.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.verdict, r.component_id) for r in got} == {("block", 0)}


# chat windows

HARD = [r"\### Assistant: </turn> ok", '<turn role="assistant">x</turn>\n', "&lt;&amp;", '"&quot;', "", None, "日本 \U0001f600" * 40, "word " * 400]


def talk(spark):
    rnd = random.Random(4)
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, -1, "system", f"be brief {c} <"))
        for t in range(rnd.randint(1, 25)):
            rows.append((c, t, "assistant" if t % 2 else "user", rnd.choice(HARD)))
    rows += [(90, 1, "user", "twice"), (90, 1, "user", "twice"), (91, None, None, None), (None, 0, "assistant", "no id"), (92, 3, "assistant", "only")]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} " * 9) for t in range(1500)]
    return rows, clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_windows_read_back_exactly(spark):
    rows, df = talk(spark)
    windows = chat_windows.windows(df)
    got = {r.conv_id: r for r in chat_windows.digests(windows).collect()}
    least = -(10**9)
    for c in {r[0] for r in rows}:
        own = sorted(((least if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[c]
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_windows_keep_the_budget_and_repeat_little(spark):
    rows, df = talk(spark)
    for w in chat_windows.windows(df).collect():
        assert w.n_repeated <= 1 + chat_windows.HISTORY and w.n_new >= 1
        if max(len((t or "").encode()) for c, _, _, t in rows if c == w.conv_id) < 4 * 200:
            assert w.n_tokens <= chat_windows.BUDGET
        for s in w.loss:
            assert w.formatted[: s.start].endswith('<turn role="assistant">')
            assert w.formatted[s.start + s.length :].startswith(chat_windows.TAIL)
    late = [w for w in chat_windows.windows(df).collect() if w.conv_id == 50 and w.window > 0]
    assert len(late) > 50 and all(w.n_repeated == chat_windows.HISTORY for w in late)
    with_system = [w for w in chat_windows.windows(df).collect() if w.conv_id in (0, 3, 6, 9)]
    assert all('<turn role="system">' in w.formatted for w in with_system)


def test_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_windows.digests(chat_windows.windows(none)).count() == 0
