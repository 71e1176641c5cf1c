import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palaver.llm import sitetree as H


def text(html, gone=()):
    return H.extracted(html, frozenset(gone))


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a &amp; b&nbsp;c &lt;i&gt; &eacute;&#233;&hellip;", "a & b c <i> éé…"),
        ("<p><b>one<br>two</b><p>th<i>re</i>e", "one two\nthree"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "a\nb\nc\nd\ne"),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", "a\nb\nc\nd"),
        ("<script>var t='</p><p>x';</script><p>y</p><style>p{}</style>", "y"),
        ("<!-- <p>a</p> --><p>b<!----->c<!-- d", "bc"),
        ("<head><title>t</title><body><p>x", "x"),
        ("<head><meta charset=utf-8><link rel=x><p>x", "x"),
        ("<p>a < b and 3<4 <p>c", "a < b and 3<4\nc"),
        ("<p title='a > b' class=\"x\">y</p>", "y"),
        ("<p>whole</p><p>cut <foo", "whole\ncut"),
        ("<nav><p>menu</nav><div>body</div><footer>foot</footer>", "body"),
        ("<div class='ad'>buy</div><div id='sideBar'>s</div><div class='no-sidebar'>in</div>", "in"),
        ("<div id='side-bar'>s</div><div class='site-footer'>f</div><div class='comment-list'>c</div><p>x", "x"),
        ("<form id=aspnet><div>menu</div><article>whole page</article></form>", "whole page"),
        ("<form><label>name</label><button>go</form><p>after", "after"),
        ("<header>site</header><main><header><h1>T</h1></header><p>x</p><aside>more</aside></main>", "T\nx"),
        ("<div>odd</div><article><p>long enough</p></article>", "long enough"),
        ("<article><p>x</p></article><div>much more than the card above</div>", "x\nmuch more than the card above"),
        ("<article class='post-1 post comments-open'>a</article><section class=comments><article>b</article></section><article class=comment>c</article>", "a"),
        ("<p hidden>a</p><p style='display: none'>b</p><p>c</p>", "c"),
        ("</p></div>x<select><option>a<option>b</select>y", "xy"),
        ("<h2>a<h3>b</h3><p>c<div>d</div>e<hr>f", "a\nb\nc\nd\ne\nf"),
        ("<P CLASS=AD>x</P><DIV>y</DIV>", "y"),
    ],
)
def test_pages(html, want):
    assert text(html) == want


def test_hostile_pages_stay_cheap():
    for html in ("<div>" * 50_000 + "x", "<b>" * 200_000 + "x", "<a " * 200_000, "<!--" * 200_000, "</i>" * 200_000, "<p>" * 50_000 + "x", "<" * 500_000, "&" * 300_000, "<li>" * 50_000, "<div>" * 20_000 + "</x>" * 20_000 + "</p>" * 20_000):
        text(html)


def made(n=40, seed=2):
    """A host whose constant parts have no telling names, another of one page."""
    rng = random.Random(seed)
    words = lambda k: " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(9)) + rng.choice("xyzuvw") for _ in range(k))
    rows = []
    for i in range(n):
        body = "".join(f"<p>{words(12)}</p>" for _ in range(rng.randrange(1, 6)))
        rows.append((i, "http://h.org/x", f"<body><div class=top><span>All you need, since 19{i % 90 + 10}</span></div><div class=c>{body}<p>same in all</p></div><div class=low><div>Made by us</div></div></body>"))
    return [*rows, (900, "http://one.org/", "<div class=top>All you need, since 1990</div><div class=c>x</div>"), (901, None, "<p>null host</p>"), (902, "http://h.org/n", None), (None, "http://h.org/", "<div class=c>no id</div>")]


def by_hand(pages, damping=H.DAMPING, smoothing=H.SMOOTHING):
    """The importance of every node of one host, by recursion over the merged tree."""
    m, seqs, said, parents = defaultdict(int), defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(lambda: [0, 0])), {}
    for html in pages:
        page, texts = H.Page(html), defaultdict(lambda: defaultdict(int))
        for node, t in page.blocks:
            texts[node][H._DIGITS.sub("0", t)] += 1
        for node in {x for n in texts for x in (*page.parents[n], n)}:
            m[node] += 1
            parents[node] = page.parents[node]
            for s in page.sequences.get(node, ()):
                seqs[node][s] += 1
            for t, b in texts.get(node, {}).items():
                said[node][t][0] += 1
                said[node][t][1] += b
    smooth = lambda n, x: (m[n] * x + smoothing) / (m[n] + smoothing)
    shown, content = {}, {}
    for n in m:
        total = sum(seqs[n].values())
        entropy = -sum(c / total * math.log(c / total) for c in seqs[n].values()) if total else 0
        shown[n] = smooth(n, min(1, entropy / math.log(m[n])) if m[n] > 1 else 1)
        own = sum(b for _, b in said[n].values())
        if own:
            content[n] = own, smooth(n, max(0, 1 - sum(b * math.log(c) for c, b in said[n].values()) / own / math.log(m[n])) if m[n] > 1 else 1)

    def summed(n):
        got, of = (1 - damping) * m[n] * shown[n], (1 - damping) * m[n]
        if n in content:
            got, of = got + damping * content[n][0] * content[n][1], of + damping * content[n][0]
        for child in m:
            if parents[child][-1:] == (n,):
                g, o = summed(child)
                got, of = got + damping * g, of + damping * o
        return got, of

    return {n: summed(n)[0] / summed(n)[1] for n in m}


def test_importance_equals_the_recursion(spark):
    rows = made()
    pages = spark.createDataFrame([("h.org", h or "") for _, u, h in rows if u and "h.org" in u], "host string, html string").repartition(3)
    got = {r.node: r.importance for r in H.importance(H.tree_counts(pages)).collect()}
    want = by_hand([h or "" for _, u, h in rows if u and "h.org" in u])
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in got)


def test_constant_branches_go_and_repeated_paragraphs_stay(spark):
    rows = made()
    got = {(r.page_id, r.url): r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, url, html in rows[:40]:
        want = [x.split("</p>")[0] for x in html.split("<p>")[1:]]
        assert got[i, url] == "\n".join(want) and got[i, url].endswith("same in all")
    assert got[900, "http://one.org/"] == "All you need, since 1990\nx" and got[901, None] == "null host" and got[902, "http://h.org/n"] == "" and got[None, "http://h.org/"] == "no id"


def test_long_lists_of_nodes_are_joined_alike(spark, monkeypatch):
    df = spark.createDataFrame(made(), "page_id long, url string, html string")
    want = sorted(map(tuple, H.main_text(df).collect()), key=repr)
    monkeypatch.setattr(H, "SMALL_ROWS", 0)
    assert sorted(map(tuple, H.main_text(df).collect()), key=repr) == want


def test_copies_of_a_page_do_not_make_it_a_template(spark):
    page = "<body><div class=c><p>An article that was crawled again and again.</p></div></body>"
    rows = [(i, "http://h.org/", page) for i in range(60)] + [(60, "http://h.org/", page.replace("again", "once"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(r.text for r in H.main_text(df.union(df)).collect())


def test_clashing_columns_empty_tables_and_query(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "<p>x", "old", 7, "h")], "page_id long, url string, html string, text string, n_chars int, host string")
    assert [tuple(r) for r in H.main_text(df).select("page_id", "text", "n_chars", "host").collect()] == [(1, "x", 1, "h")]
    assert H.main_text(df.limit(0)).count() == 0
    spark.createDataFrame([(1, "http://a/", "<p>😀x</p>" * 2), (1, "http://a/", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = H.op12_html_extraction(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(tuple(r)[2:] for r in got.collect()) == [("", 0), ("😀x\n😀x", 5)]


def test_articles_of_the_shipped_pages(spark):
    """Whatever stands in <article> and nothing else, page by page."""
    import html as entities
    import re

    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in H.op12_html_extraction(spark, d).where(F.col("n_chars") == F.length("text")).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " "))
        want = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts]
        assert got[i] == "\n".join(x for x in want if x)
