"""Main text of pages by a site style tree.

The element trees of a host's pages are merged into one: an element node is a tag with its class and
id words, and what these say of it, under its parent's node. Of every node two things are counted over the pages that have it.
Its presentation is the sequence of its children; its content are the texts of its own blocks.
What many pages show alike tells little: the importance of presentation is the entropy of the
sequences, and that of content is one less the mean entropy of the texts, both in units of the
logarithm of the number of pages. An inner node's importance joins its own presentation with its
descendants' importance, each weighted by its blocks and damped by its distance, as in Yi, Liu and Li
(2003). The recursion of that sum is unrolled: every node gives its share to each of its ancestors in
one aggregation, so the number of jobs doesn't follow the depth. Whole copies of a page count once.

Branches of low importance go. Menus and adverts that change from page to page look important by
entropy alone, so the names that authors give to elements count as well: a node that HTML or its
class words call a menu, an advert, a form, comments and so on has no importance, and one that they
call the article keeps what it shares with other pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import small_batches, stored, table
from palaver.llm.urls import host_of

#: Importance below which a branch goes.
LEAST = 0.3
#: What a step down the tree leaves of a descendant's importance.
DAMPING = 0.9
#: Pages that an unseen node counts for, as if each had shown something of its own.
SMOOTHING = 8.0
#: Rows up to which a list of nodes or pages is broadcast, at some tens of bytes each.
SMALL_ROWS = 200_000
#: Parts that the rows of a host are dealt to where its list of nodes is too long to be broadcast.
SALTS = 64
#: Levels of the tree below which elements count as their ancestor there.
DEEPEST = 64

# Fixed values of HTML: elements whose content is no text of the page.
UNSEEN = frozenset("head script style title noscript template textarea select option button svg math iframe object audio video canvas datalist".split())
RAW = frozenset("script style title textarea iframe noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
_SECTIONS = {"table", "td", "th", "article", "section", "nav", "aside", "main", "header", "footer", "form", "blockquote"}
#: What the start of these ends: the first that is open within the nearest element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"} | _SECTIONS),
    "dt": ({"dt", "dd"}, {"dl"} | _SECTIONS),
    "dd": ({"dt", "dd"}, {"dl"} | _SECTIONS),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr"}, {"table"}),
}
#: Sections that an open paragraph doesn't reach beyond.
SCOPES = frozenset("html body table td th caption article aside section main div nav header footer form blockquote li dd dt figure details fieldset".split())

# What authors call parts that are not the article.
MARGIN_TAGS = frozenset("nav aside footer menu dialog".split())
MARGIN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
MARGIN_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner billboard breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus "
    "dropdown feedback footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted promotion rail "
    "related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar widget widgets".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article articlebody entry mainbody maincontent post story".split())
#: Words of names for what lies around the article and the margin together, such as with-sidebar.
FRAME_WORDS = frozenset("with has no layout grid".split())

#: A form may be around a whole page, and then counts as margin without its article.
FORM, MARGIN, PLAIN, ARTICLE = -2, -1, 0, 1
_WORD = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: A comment, a tag with its attributes, whose quoted values may hold anything, or a declaration.
_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|[!?/][^>]*>)""", re.S)
_CUT_OFF = re.compile(r"<[a-zA-Z/!?].*\Z", re.S)
#: The end of an element in whose text tags mean nothing.
_ENDS_OF = {tag: re.compile(rf"<(?P<end>/)(?P<tag>{tag})(?P<attrs>(?=[\s/>])[^>]*)>", re.I) for tag in sorted(RAW)}


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - 2**63


def _names(value: str) -> list[str]:
    """The words of class and id values, parted by camel case, signs and digits, and neighbours as one."""
    words = [w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value))]
    return words + ["".join(x) for x in zip(words, words[1:], strict=False)]


def role_of(tag: str, attrs: dict[str, str], inside_article: bool) -> int:
    """FORM, MARGIN, PLAIN or ARTICLE by what the element is called.

    A header counts as margin outside the article only, as the title may stand in one within. Names
    with a word of the frame say nothing. An article that is called a comment is one.
    """
    if tag in ("html", "body"):
        return PLAIN
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    if tag in MARGIN_TAGS or hidden or attrs.get("role", "").strip().lower() in MARGIN_ROLES or tag == "header" and not inside_article:
        return MARGIN
    names = [w for v in [*attrs.get("class", "").split(), attrs.get("id", "")] if not (w := set(_names(v))) & FRAME_WORDS]
    article = attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody" or any(len(w) <= 3 and w & ARTICLE_WORDS and not w & MARGIN_WORDS for w in names)
    margin = any(w & MARGIN_WORDS - ({"header"} if inside_article else set()) for w in names)
    if tag in ARTICLE_TAGS:
        return MARGIN if margin and not article else ARTICLE
    if margin:
        return MARGIN
    return FORM if tag == "form" else ARTICLE if article else PLAIN


@lru_cache(4096)
def _element(tag: str, attrs: str, inside_article: bool) -> tuple[str, int]:
    """The key of an element among its parent's children, and its role."""
    named = {}
    for m in _ATTRIBUTE.finditer(attrs):
        named.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    words = {_DIGITS.sub("0", x) for x in [*named.get("class", "").split(), *(f"#{x}" for x in named.get("id", "").split())]}
    role = role_of(tag, named, inside_article)
    return " ".join([tag, str(role), *sorted(words)]), role


@lru_cache(65_536)
def _node(parent: int, key: str) -> int:
    return _hash(f"{parent} {key}")


class Page:
    """The blocks of a page in order, as (node, text), and of each node its ancestors, role and children.

    Character references are decoded. Elements are closed as browsers close them: by their end, by the
    end of an element around them, and paragraphs, headings, list items and cells by the next one.
    Markup within a block, such as emphasis and line breaks, is part of it; the elements in UNSEEN and
    comments are skipped. Whatever is left open at the end is closed there.
    """

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[int, str]] = []
        self.parents: dict[int, tuple[int, ...]] = {0: ()}
        self.roles: dict[int, int] = {0: PLAIN}
        self.sequences: dict[int, set[int]] = {}
        #: Open block elements: tag, node, whether within an article, keys of children so far.
        self._open: list[tuple[str, int, bool, list[str]]] = [("", 0, False, [])]
        self._counts: dict[str, int] = {}
        self._text: list[str] = []
        #: Open elements from the first that is unseen on.
        self._unseen: list[str] = []
        self._read(html)
        self._close(1)

    def _read(self, html: str) -> None:
        at, raw, last = 0, "", html.rfind(">") + 1
        while m := (_ENDS_OF[raw] if raw else _TAG).search(html, at, last):
            if m.start() > at and not self._unseen:
                self._text.append(html[at : m.start()])
            at, raw = m.end(), ""
            end, tag = m["end"], m["tag"]
            if not tag:
                continue  # a comment, a declaration or an instruction
            tag = tag.lower()
            if end:
                self._ended(tag)
            else:
                self._started(tag, m["attrs"])
                raw = tag if tag in RAW else ""
        if not self._unseen:  # a tag that the page's end cuts off is none of its text
            self._text.append(_CUT_OFF.sub("", html[at:]))

    def _flush(self) -> None:
        if self._text:
            text = "".join(self._text)
            self._text.clear()
            if text := " ".join((unescape(text) if "&" in text else text).split()):
                self.blocks.append((self._open[-1][1], text))

    def _close(self, k: int) -> None:
        """Close all elements from the k-th on."""
        self._flush()
        for tag, node, _, children in self._open[k:]:
            self._counts[tag] -= 1
            self.sequences.setdefault(node, set()).add(_hash("/".join(children)))
        del self._open[k:]

    def _implied(self, tag: str) -> None:
        """Close what the start of a block ends: a cell or an item by its like, and a paragraph or a heading."""
        if tag in ENDS:
            ends, scope = ENDS[tag]
            first = None
            for k in range(len(self._open) - 1, 0, -1):
                if self._open[k][0] in scope:
                    break
                first = k if self._open[k][0] in ends else first
            if first:
                return self._close(first)
        for k in range(len(self._open) - 1, 0, -1):
            is_open = self._open[k][0]
            if is_open == "p" or is_open in HEADINGS and tag in HEADINGS:
                return self._close(k)
            if is_open in SCOPES:
                return None
        return None

    def _started(self, tag: str, attrs: str) -> None:
        if self._unseen and self._unseen[0] == "head" and (tag == "body" or self._unseen == ["head"] and tag in BLOCKS):
            self._unseen.clear()  # a head without an end
        if self._unseen or tag in UNSEEN:
            if tag not in VOID:
                self._unseen.append(tag)
            return
        if tag not in BLOCKS:
            if tag in VOID:
                self._text.append(" ")
            return
        if tag in ("html", "body") and self._counts.get(tag):
            return
        self._implied(tag)
        self._flush()
        if tag == "hr":
            return
        _, parent, inside, siblings = self._open[-1]
        key, role = _element(tag, attrs, inside)
        siblings.append(key)
        if len(self.parents[parent]) < DEEPEST:
            node = _node(parent, key)
            if node not in self.parents:
                self.parents[node] = (*self.parents[parent], parent)
                self.roles[node] = role
        else:
            node, role = parent, PLAIN
        self._open.append((tag, node, inside or role == ARTICLE, []))
        self._counts[tag] = self._counts.get(tag, 0) + 1

    def _ended(self, tag: str) -> None:
        if tag in self._unseen:
            del self._unseen[len(self._unseen) - 1 - self._unseen[::-1].index(tag) :]
            return
        if not self._counts.get(tag):
            if tag == "br":
                self._text.append(" ")
            return
        self._unseen.clear()  # an unseen element ends with what it stands in
        k = len(self._open) - 1
        while self._open[k][0] != tag:
            k -= 1
        self._close(k)


OWN, SHOWN, SAID = 0, 1, 2
#: Rows a task holds back to merge equal ones.
HELD = 100_000


def _rows(host: str, page: Page) -> Iterator[tuple[tuple, int]]:
    """Of a page's nodes: that it has them, how they present their children, what their blocks say."""
    seen = {n for n, _ in page.blocks}
    used = seen | {p for n in seen for p in page.parents[n]}
    for node in used:
        yield (host, node, page.parents[node], page.roles[node], OWN, 0), 0
        for sequence in page.sequences.get(node, ()):
            yield (host, node, (), 0, SHOWN, sequence), 0
    said: dict[tuple[int, int], int] = {}
    for node, text in page.blocks:
        key = node, _hash(_DIGITS.sub("0", text))
        said[key] = said.get(key, 0) + 1
    for (node, value), blocks in said.items():
        yield (host, node, (), 0, SAID, value), blocks


def tree_counts(pages: DataFrame) -> DataFrame:
    """host, node, parents, role, kind, value, pages, blocks: what the pages show, counted by node.

    Tasks merge equal rows before they are dealt out, so a host that has most pages sends little more
    than its distinct texts. Those are dealt by their hash; no task has a host.
    """

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[int]] = {}

        def out() -> pd.DataFrame:
            rows = [(*k[:2], list(k[2]), *k[3:], n, b) for k, (n, b) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["host", "node", "parents", "role", "kind", "value", "pages", "blocks"])

        for pdf in batches:
            for host, html in zip(pdf.host, pdf.html, strict=True):
                for key, blocks in _rows(host, Page(html or "")):
                    sums = held.setdefault(key, [0, 0])
                    sums[0] += 1
                    sums[1] += blocks
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    small_batches(pages.sparkSession)
    rows = pages.select("host", "html").mapInPandas(emitted, "host string, node long, parents array<long>, role int, kind int, value long, pages long, blocks long")
    return rows.groupBy("host", "node", "parents", "kind", "value").agg(F.min("role").alias("role"), F.sum("pages").alias("pages"), F.sum("blocks").alias("blocks"))


def importance(counts: DataFrame, damping: float = DAMPING, smoothing: float = SMOOTHING) -> DataFrame:
    """host, node, role, pages, presentation, content, importance, of every node of every host.

    presentation and content are between 0 and 1, and 1 for a node of a single page. Each is averaged
    with ``smoothing`` pages of importance 1, so few pages condemn nothing. importance of a node is the
    sum over it and its descendants at distance t of damping^t (1 - damping) times their presentation,
    for each of their pages, and damping^(t + 1) times their content, for each of their blocks, over the
    sum of the same weights.
    """
    n = F.col("pages").cast("double")
    nlogn = F.sum(F.when(F.col("kind") == SHOWN, n * F.log(n))).alias("shown_log")
    said = F.when(F.col("kind") == SAID, F.col("blocks"))
    shown, own = F.when(F.col("kind") == SHOWN, n), F.when(F.col("kind") == OWN, F.col("pages"))
    nodes = counts.groupBy("host", "node").agg(
        F.max("parents").alias("parents"),
        F.min(F.when(F.col("kind") == OWN, F.col("role"))).alias("role"),
        F.max(own).alias("m"),
        nlogn,
        F.sum(shown).alias("shown"),
        F.coalesce(F.sum(said), F.lit(0)).alias("own"),
        F.sum(said * F.log(n)).alias("said_log"),
    )
    log_m = F.log(F.col("m").cast("double"))
    smooth = lambda x: (F.col("m") * x + smoothing) / (F.col("m") + smoothing)
    entropy = F.log("shown") - F.col("shown_log") / F.col("shown")
    nodes = nodes.withColumn("presentation", smooth(F.when(F.col("m") > 1, F.least(F.coalesce(entropy / log_m, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)))
    nodes = nodes.withColumn("content", F.when(F.col("own") > 0, smooth(F.when(F.col("m") > 1, F.greatest(1.0 - F.col("said_log") / F.col("own") / log_m, F.lit(0.0))).otherwise(1.0))))
    nodes = stored(nodes, "html-tree")  # it is read twice below, and made from all pages
    # Every node reaches itself and its ancestors; its parents are listed from the top.
    up = nodes.withColumn("to", F.concat("parents", F.array("node")))
    up = up.select("host", "node", "m", "own", "presentation", "content", F.size("to").alias("depth"), F.posexplode("to").alias("at", "up"))
    far = F.pow(F.lit(damping), F.col("depth") - 1 - F.col("at"))
    said_part, shown_part = far * damping * F.col("own"), far * (1 - damping) * F.col("m")
    sums = up.groupBy("host", "up").agg(
        F.sum(F.coalesce(said_part * F.col("content"), F.lit(0.0)) + shown_part * F.col("presentation")).alias("got"),
        F.sum(said_part + shown_part).alias("of"),
    )
    found = nodes.join(sums.withColumnRenamed("up", "node"), ["host", "node"])
    return found.select("host", "node", "role", F.col("m").alias("pages"), "presentation", "content", (F.col("got") / F.col("of")).alias("importance"))


def style_tree(pages: DataFrame, **options) -> DataFrame:
    """importance() of the pages' hosts; pages has host and html."""
    return importance(tree_counts(_once(pages)), **options)


def _once(pages: DataFrame) -> DataFrame:
    """pages without whole copies of a page on the same host; of copies the smallest page_id stays.

    A row without a page_id stays as well.
    """
    keyed = pages.select("page_id", "host", F.xxhash64("html").alias("copy"))
    first = keyed.groupBy("host", "copy").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups, size = first.agg(F.count("*"), F.sum("n")).first()
    if not groups:
        return pages
    copies = keyed.join(F.broadcast(first) if groups <= SMALL_ROWS else first, ["host", "copy"]).where("page_id > first").select("page_id").distinct()
    return pages.join(F.broadcast(copies) if size <= SMALL_ROWS else copies, "page_id", "left_anti")


def extracted(html: str | None, gone: frozenset[int]) -> str:
    """The text of a page without its margin and without the branches whose nodes are in gone.

    Where the rest lies for the most part in what the page calls its article, only that is taken.
    """
    page = Page(html or "")
    texts: dict[bool, list[str]] = {True: [], False: []}
    found: list[tuple[bool, str]] = []
    line_of: dict[int, bool | None] = {}
    for node, text in page.blocks:
        if node not in line_of:
            line = [*page.parents[node], node]
            roles = [page.roles[n] for n in line]
            inside = len(roles) - roles[::-1].index(ARTICLE) if ARTICLE in roles else 0
            lost = MARGIN in roles or FORM in roles[inside:] or not gone.isdisjoint(line[inside:])
            line_of[node] = None if lost else inside > 0
        if line_of[node] is not None:
            found.append((line_of[node], text))
            texts[line_of[node]].append(text)
    main = sum(map(len, texts[True])) >= sum(map(len, texts[False]))
    return "\n".join(texts[True] if main and texts[True] else [t for _, t in found])


def main_text(pages: DataFrame, least: float = LEAST, damping: float = DAMPING, smoothing: float = SMOOTHING) -> DataFrame:
    """pages (page_id, url, html) with text and n_chars; columns of these names are replaced.

    A null or empty html has an empty text; a null url, or one without ://, belongs to the host with
    the empty name. A host of few pages loses only what its elements' names exclude. Whole pages are
    read; repeated rows have equal texts; an empty table gives none.
    """
    spark = pages.sparkSession
    rows = pages.withColumn("__host", host_of(F.col("url")))
    tree = style_tree(rows.select(F.col("__host").alias("host"), "page_id", F.coalesce("html", F.lit("")).alias("html")), damping=damping, smoothing=smoothing)
    low = stored(tree.where((F.col("importance") < least) & (F.col("role") == PLAIN)).select("host", "node"), "html-nodes")
    lists = low.groupBy("host").agg(F.array_sort(F.collect_list("node")).alias("__gone")).withColumnRenamed("host", "__of")
    if low.count() <= SMALL_ROWS:
        rows = rows.join(F.broadcast(lists), F.col("__host") == F.col("__of"), "left")
    else:
        lists = lists.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
        rows = rows.join(lists, (F.col("__host") == F.col("__of")) & (F.coalesce("__salt", F.lit(0)) == F.col("__part")), "left").drop("__salt", "__part")

    @F.pandas_udf("string")
    def text(html: pd.Series, gone: pd.Series) -> pd.Series:
        sets: dict[bytes, frozenset[int]] = {}
        none = frozenset()
        out = []
        for h, g in zip(html, gone, strict=True):
            if g is None:
                out.append(extracted(h, none))
                continue
            key = np.asarray(g, np.int64).tobytes()
            if key not in sets:
                sets[key] = frozenset(int(x) for x in g)
            out.append(extracted(h, sets[key]))
        return pd.Series(out, dtype=object)

    small_batches(spark)
    rows = rows.withColumn("text", text(F.col("html"), F.col("__gone")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).drop("__host", "__of", "__gone")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
