"""Web page tables: links, metadata, text, stitched pages, addresses, rule-driven extraction, source lists.

Pages are processed row by row on the JVM side. Only joins with rule tables, stitching and ordering leave the row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusloom.functions import html as H
from corpusloom.functions.arrays import let
from corpusloom.functions.keyed import bound, position, top_per_key
from corpusloom.functions.text import contains_any, elements, replace_first, source_id, squeeze, strip, url_unquote
from corpusloom.operators.corpus import chapter_index
from corpusloom.session import checkpointed

# --- fixed values ---------------------------------------------------------------------------------------------
BLOCK_MARKERS = (
    "Just a moment", "cf-mitigated", "challenge-platform", "Enable JavaScript and cookies", "正在进行安全验证",
    "Cloudflare", "Attention Required!",
)
CHAPTER_MARKERS = ("第", "章", "卷", "集", "篇", "回")
NAVIGATION_WORDS = ("首页", "上一页", "下一页", "尾页", "目录")
NAVIGATION_PART = "直达"
BOOK_STOP_WORDS = (
    "首页", "排行", "书架", "分类", "全本", "完本", "记录", "登录", "注册", "书库", "男生", "女生", "历史", "玄幻",
    "都市", "仙侠", "科幻", "网游", "小说", "繁体", "简体", "搜索", "帮助", "点击阅读", "加入书架", "目录",
)
BOOK_PATH = r"/(book|info|b|xiaoshuo|xs)/"
BOOK_PAGE = r"/\d+(_\d+)?\.html?$"
BOOK_FOLDER = r"/\d+/$"
LIST_FOLDER = r"/(class|sort|list|fenlei)/"
BOOK_TAIL = r"(?s)(\n|连载|全本|完结|阅读|最新).*"
CATEGORY_NAME = 10
CATEGORY_BLOCK = r"""(?is)^<(?:nav|div|ul)\b[^>]*\bclass\s*=\s*["'][^"']*(?:nav|menu|header)[^"']*["'][^>]*>"""
CATEGORY_PATHS = ("/sort", "/fenlei", "/top", "list")
CATEGORY_FALLBACK_NAME = 8
TITLE_BREAK = r"[_\-|]"
AUTHOR_LABEL = r"^(作者|作家)[:：\s]*"
AUTHOR_IN_TEXT = r"作者[:：\s]*([^\s/|，。]+)"
DESCRIPTION_LENGTH = 20
TEXT_LENGTH = 20
UNWANTED = ("title", "script", "style", "a", "h1", "ins", "iframe")
AUTHOR_PLACES = (("class", "author"), ("class", "writer"), ("class", "book-author"), ("id", "author"))
INTRO_PLACES = (
    ("id", "intro"), ("class", "intro"), ("class", "book-intro"), ("class", "bookintro"), ("class", "description"),
    ("class", "desc"), ("id", "bookintro"),
)
COVER_PLACES = (
    ("class", "cover"), ("class", "book-cover"), ("class", "bookcover"), ("class", "book-img"), ("class", "img_in"), ("id", "fmimg"),
)
IMAGE_ADDRESSES = ("src", "data-src", "data-original")
DEFAULT_CONTAINERS = (
    ("id", "contentbox"), ("id", "content"), ("class", "content"), ("class", "chapter-content"), ("id", "nr_body"),
    ("class", "read-content"), ("id", "chaptercontent"), ("class", "panel-body"), ("tag", "article"),
)
JS_MARKERS = (
    "@js:", "<js>", '"js"', "jsLib", "bodyJs", "formatJs", "preUpdateJs", "coverDecodeJs", "loginCheckJs",
    "imageDecode", "callBackJs", "java.", "source.", "book.", "chapter.", "cookie.", "cache.",
)
WEBVIEW_MARKERS = (
    '"webView"', "'webView'", "webView", "webJs", "sourceRegex", "overrideUrlRegex", "startBrowserAwait", "loginUi",
)
LOGIN_MARKERS = ("startBrowserAwait", "loginUi")
JSON_PATH_USE = r"(^|[^\w])\$[.\[]"
XPATH_USE = r"(^|[@\s])(/|//|@XPath:)"
IMPORT_SCHEME = r"(?i)(?:yuedu|legado)://[^\s'\"<>]+"
DIRECT_LINK = r"(?i)https?://[^\s'\"<>]+"
LINK_TOKENS = ("booksource", "source", "legado", "yuedu", ".json", ".txt", "importonline")
IMPORT_KEYS = r"(?i)(?:^|[?&])(?:src|url|source|sourceUrl|bookSourceUrl|file)=([^&\s'\"<>]+)"
# --- end of fixed values --------------------------------------------------------------------------------------

LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]*)["']?[^>]*>(.*?)</a\s*>"""


def _links(source: Column, base: Column) -> Column:
    """Array of (pos, href, title, url) of the links in a piece of HTML."""
    # The page is searched once; parts are then taken from each short link.
    pairs = F.transform(F.regexp_extract_all(source, F.lit(LINK), F.lit(0)), lambda a: F.struct(
        F.regexp_extract(a, LINK, 1).alias("href"), F.regexp_extract(a, LINK, 2).alias("inner")))
    return F.transform(pairs, lambda p, i: F.struct(
        (i + 1).cast("long").alias("pos"), p["href"].alias("href"), p["inner"].alias("inner"),
        H.resolve(base, p["href"]).alias("url")))


def extract_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Links of each page: (key, pos, href, title, url), the first of each absolute address kept. No shuffle."""
    found = pages.select(key, F.col(html).alias("_html"), H.base_parts(F.col(url)).alias("_base")).select(
        key, F.filter(_links(F.col("_html"), F.col("_base")), lambda x: x["href"] != "").alias("_l"))
    # Sorted by address and place, the first of each address stands behind another address.
    sorted_ = found.select(key, F.array_sort(F.transform("_l", lambda x: F.struct(x["url"].alias("url"), x["pos"].alias("pos"), x.alias("x")))).alias("_s"))
    once = sorted_.select(key, F.transform(F.filter("_s", lambda x, i: (i == 0) | ~F.get("_s", i - 1)["url"].eqNullSafe(x["url"])),
                                           lambda x: x["x"]).alias("_l"))
    rows = once.select(key, F.explode(elements(F.col("_l"))).alias("_x"))
    title = H.inline_text(F.col("_x.inner"))
    return rows.select(key, "_x.pos", "_x.href", title.alias("title"), "_x.url")


def chapter_links(links: DataFrame, markers=CHAPTER_MARKERS, stop=NAVIGATION_WORDS, part: str | None = NAVIGATION_PART) -> DataFrame:
    """Links whose title holds a chapter mark and is no navigation word."""
    title = F.col("title")
    kept = links.filter((title != "") & ~title.isin(*stop) & contains_any(title, markers))
    return kept.filter(~F.contains(title, F.lit(part))) if part else kept


def book_links(links: DataFrame, key: str, order: str = "pos", stop=BOOK_STOP_WORDS, cap: int | None = None) -> DataFrame:
    """Links that look like books by their address, the first of each address; ``cap`` asks for the first few per page."""
    href, title = F.col("href"), strip(F.col("title"))
    looks = href.rlike(BOOK_PATH) | href.rlike(BOOK_PAGE) | (href.rlike(BOOK_FOLDER) & ~href.rlike(LIST_FOLDER))
    named = links.filter(F.length(title).between(2, 30) & ~contains_any(title, stop) & looks).withColumn(
        "title", strip(F.regexp_replace(title, BOOK_TAIL, ""))).filter(F.length("title") >= 2)
    first = named.groupBy(key, "url").agg(F.min(F.struct(order, "title", "href")).alias("_f")).select(
        key, "url", f"_f.{order}", "_f.title", "_f.href")
    return first if cap is None else top_per_key(first, [key], [F.col(order)], cap)


def category_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                   block: str = CATEGORY_BLOCK, fallback_links: int | None = None) -> DataFrame:
    """Short named links of the navigation blocks, nested lists included; pages without any fall back to list-like links
    (of their first ``fallback_links``, if given). ``block`` is the pattern of a block's opening tag."""
    base = pages.select(key, F.col(html).alias("_html"), H.base_parts(F.col(url)).alias("_b"))
    every = _links(F.col("_html"), F.col("_b"))
    both = base.select(key, _links(H.insides(F.col("_html"), block), F.col("_b")).alias("_n"),
                       (every if fallback_links is None else F.slice(every, 1, fallback_links)).alias("_a"))
    rows = both.select(key, F.explode(elements(F.concat(
        F.transform("_n", lambda x: F.struct(F.lit(0).alias("kind"), x.alias("x"))),
        F.transform("_a", lambda x: F.struct(F.lit(1).alias("kind"), x.alias("x")))))).alias("_r"))
    named = rows.select(key, "_r.kind", "_r.x.pos", "_r.x.href", "_r.x.url", H.inline_text(F.col("_r.x.inner")).alias("name"))
    nav_ok = (F.col("kind") == 0) & F.length("name").between(1, CATEGORY_NAME) & ~F.contains("href", F.lit("javascript")) & ~F.contains("href", F.lit("#"))
    other_ok = (F.col("kind") == 1) & F.length("name").between(1, CATEGORY_FALLBACK_NAME) & contains_any(F.col("href"), CATEGORY_PATHS)
    first = named.filter(nav_ok | other_ok).groupBy(key, "kind", "url").agg(F.min(F.struct("pos", "name")).alias("_f"))
    best = first.groupBy(key).agg(F.min("kind").alias("kind"))
    return first.join(best, [key, "kind"], "left_semi").select(key, "_f.pos", "_f.name", "url")


def flag_blocked(pages: DataFrame, markers=BLOCK_MARKERS, html: str = "html") -> DataFrame:
    """Pages with a flag for challenge or block pages."""
    return pages.withColumn("blocked", F.coalesce(contains_any(F.col(html), markers), F.lit(False)))


def page_metadata(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Title, author, description and cover of a page, each from the first source that has one."""
    or_null = H.or_null
    inner = lambda text: or_null(squeeze(F.regexp_replace(text, H.ANY_TAG, " ")))
    rows = pages.select(key, F.col(url).alias("_url"), F.col(html).alias("_doc")).withColumn(
        "_body", H.drop_elements(H.drop_comments(F.col("_doc")), ("script", "style")))
    doc, body = F.col("_doc"), F.col("_body")
    # Candidates are cut out of the page first; only the chosen small texts have their references decoded.
    pick = lambda text, cut: let(text, lambda t: F.when(t.isNotNull(), F.struct(t.alias("t"), F.lit(cut).alias("cut"))))
    title = F.coalesce(pick(H.meta_content(doc, "og:title", "twitter:title"), True),
                       pick(inner(H.element(doc, "h1")), False), pick(inner(H.element(doc, "title")), True))
    author = F.coalesce(*[or_null(F.regexp_replace(inner(H.element_by_id(body, r"\w+", a, v)), AUTHOR_LABEL, ""))
                          for a, v in AUTHOR_PLACES])
    intro = [inner(H.element_by_id(body, r"\w+", a, v)) for a, v in INTRO_PLACES]
    description = F.coalesce(H.meta_content(doc, "og:description", "description", "twitter:description"),
                             *[F.when(F.length(t) >= DESCRIPTION_LENGTH, t) for t in intro], *reversed(intro))
    images = [or_null(first_image(H.insides_by(doc, a, v))) for a, v in COVER_PLACES] + [or_null(first_image(doc))]
    chosen = rows.select(
        key, "_url", title.alias("_title"), author.alias("_author"), description.alias("_description"),
        # Labelled only in running text: looked for in the text without tags.
        or_null(F.regexp_extract(F.regexp_replace(body, H.ANY_TAG, " "), AUTHOR_IN_TEXT, 1)).alias("_named"),
        F.coalesce(H.meta_content(doc, "og:image", "twitter:image"), *images).alias("_cover"))
    decoded = chosen.select(
        key, "_url", "_cover", F.col("_title.cut").alias("_cut"), H.unescape(F.col("_title.t")).alias("_t"),
        H.unescape(F.coalesce("_author", "_named")).alias("_a"), H.unescape(F.col("_description")).alias("_d"))
    whole = F.when(F.col("_cut"), F.regexp_extract("_t", f"(?s)^(.*?)(?:{TITLE_BREAK}|$)", 1)).otherwise(F.col("_t"))
    return decoded.select(
        key, or_null(squeeze(whole)).alias("title"), or_null(squeeze(F.col("_a"))).alias("author"),
        or_null(squeeze(F.col("_d"))).alias("description"),
        F.when(F.col("_cover").isNotNull(), H.join_url(F.col("_url"), F.col("_cover"))).alias("cover_url"),
        F.col("_url").alias("source_url"))


def first_image(html: Column, names=IMAGE_ADDRESSES) -> Column:
    """Address of the first image, from the first of its attributes that has one; empty without."""
    def address(tag, name):
        found = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
        return F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)])

    tag = F.regexp_extract(html, r"(?is)<img\b[^>]*>", 0)
    return let(tag, lambda t: F.coalesce(*[H.or_null(address(t, n)) for n in names], F.lit("")))


def container(html: Column, kind: str, value: str) -> Column:
    """Inner HTML of the first matching container."""
    return H.inside(html, rf"(?is)<{value}\b[^>]*>") if kind == "tag" else H.element_by_id(html, "(?:div|article|section)", kind, value)


def page_text(pages: DataFrame, rules: DataFrame | None = None, key: str = "page_id", url: str = "url",
              html: str = "html", containers=DEFAULT_CONTAINERS, minimum: int = TEXT_LENGTH) -> DataFrame:
    """Main text: first container with enough text, unwanted elements dropped, non-empty lines joined.

    ``rules`` (host, pattern) name the container of a site by a pattern with one group; it goes before the defaults.
    """
    rows = pages.select(key, F.col(url).alias("_url"), F.col(html).alias("_html"))
    own = F.lit("")
    if rules is not None:
        first = rules.groupBy(F.col("host").alias("_host")).agg(F.min("pattern").alias("_p"))
        rows = rows.withColumn("_host", H.url_host(F.col("_url"))).join(first, "_host", "left")
        own = F.coalesce(F.expr("regexp_extract(_html, _p, 1)"), F.lit(""))

    def text_of(fragment):
        broken = F.regexp_replace(H.drop_elements(H.drop_comments(fragment), UNWANTED), H.ANY_TAG, "\n")
        lines = F.filter(F.transform(F.split(broken, "[\r\n]+"), strip), lambda x: x != "")
        return F.array_join(lines, "\n")

    bodies = F.array(own, *[container(F.col("_html"), kind, value) for kind, value in containers])
    # Containers are cut out first, then cleaned one by one until one is long enough.
    cut = rows.select(key, F.filter(bodies, lambda b: b != "").alias("_bodies"))
    texts = cut.select(key, F.filter(F.transform("_bodies", text_of), lambda t: F.length(t) >= minimum).alias("_t"))
    return texts.select(key, H.unescape(F.get("_t", F.lit(0))).alias("text"))


def pages_in_turn(starts: DataFrame, links: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages in the order a reader meets them who queues every page's next links: (start_url, url, hops, turns), no page twice.

    ``links``: url, pos, next_url, any number a page. The order of a start's pages is that of (hops, turns): a page is read at
    its fewest steps from the start, and among equals after the earliest parent, by the place of the link. ``turns`` are the
    steps at which another than a page's first link was taken, so a plain chain of any length carries none.

    Steps are doubled: after round k all pages within 2^k steps are known, and the jumps of 2^k steps are joined with
    themselves. Rounds grow with the logarithm of the longest way, and end when one finds no page, cycles or not.
    """
    turn = F.array(F.struct(F.lit(-1).alias("step"), F.col("nth").alias("nth")))
    plain = F.array().cast("array<struct<step:int,nth:int>>")
    once = links.filter("next_url IS NOT NULL AND url IS NOT NULL").groupBy("url", "next_url").agg(F.min("pos").alias("pos"))
    nth = F.row_number().over(Window.partitionBy("url").orderBy("pos", "next_url"))
    jumps = checkpointed(once.withColumn("nth", nth).select(
        F.col("url").alias("_from"), F.col("next_url").alias("_to"), F.when(F.col("nth") > 1, turn).otherwise(plain).alias("_turns")))
    found = checkpointed(starts.select(F.col("url").alias("start_url")).filter("start_url IS NOT NULL").distinct().select(
        "start_url", F.col("start_url").alias("url"), F.struct(F.lit(0).alias("hops"), plain.alias("turns")).alias("way")))
    known, reach = found.count(), 1

    def behind(turns, steps):
        return F.transform(turns, lambda t: F.struct((t["step"] - steps).alias("step"), t["nth"].alias("nth")))

    while True:
        further = found.join(jumps, found["url"] == jumps["_from"]).select("start_url", F.col("_to").alias("url"), F.struct(
            (F.col("way.hops") + reach).alias("hops"), F.concat("way.turns", behind("_turns", F.col("way.hops"))).alias("turns")).alias("way"))
        found = checkpointed(found.unionByName(further).groupBy("start_url", "url").agg(F.min("way").alias("way")))
        if (now := found.count()) == known:
            break
        second = jumps.select(F.col("_from").alias("_to"), F.col("_to").alias("_end"), F.col("_turns").alias("_more"))
        jumps = checkpointed(jumps.join(second, "_to").groupBy("_from", F.col("_end").alias("_to")).agg(
            F.min(F.concat("_turns", behind("_more", F.lit(reach)))).alias("_turns")))
        known, reach = now, reach * 2
    rows = found.select("start_url", "url", "way.hops", "way.turns")
    return rows if max_pages is None else top_per_key(rows, ["start_url"], [F.col("hops"), F.col("turns")], max_pages)


def contents(starts: DataFrame, links: DataFrame, chapters: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Chapters of lists of contents over several pages: (start_url, ord, chapter_url, title), each chapter where it comes first.

    ``links``: url, pos, next_url; ``chapters``: url, pos, chapter_url, title, the chapters that a page lists.
    """
    met = pages_in_turn(starts, links, max_pages).join(chapters.filter("chapter_url <> ''"), "url")
    first = met.groupBy("start_url", "chapter_url").agg(F.min(F.struct("hops", "turns", "pos", "title")).alias("_f"))
    rows = first.select("start_url", "chapter_url", "_f.*")
    numbered = position(rows, ["start_url"], [F.col("turns"), F.col("pos"), F.col("chapter_url")], F.col("hops"), "ord")
    return numbered.select("start_url", "ord", "chapter_url", "title")


def stitch_pages(starts: DataFrame, pages: DataFrame, max_hops: int, glue: str = "\n\n") -> DataFrame:
    """Follow next-page links from each start address and join the texts in reading order: (start_url, pages, text).

    ``pages``: url, text, next_url, a row for each next link (null without). A page is read once, and at most ``max_hops`` pages
    are, so a stitched text holds a bounded number of pages.
    """
    # The walk moves addresses only; texts are fetched once, for the pages that were reached.
    links = pages.select("url", F.lit(1).alias("pos"), "next_url")
    texts = pages.groupBy("url").agg(F.min("text").alias("text"))
    reached = pages_in_turn(starts, links, max_hops).join(texts, "url")
    joined_text = F.array_join(F.filter(F.transform(
        F.array_sort(F.collect_list(F.struct("hops", "turns", "text"))), lambda s: s["text"]), lambda t: t != ""), glue)
    found = reached.groupBy("start_url").agg(F.count("*").alias("pages"), joined_text.alias("text"))
    return starts.select(F.col("url").alias("start_url")).distinct().join(found, "start_url", "left").select(
        "start_url", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("text", F.lit("")).alias("text"))


def canonical_url(df: DataFrame, aliases: DataFrame, url: str = "url") -> DataFrame:
    """Address with secure scheme and the main host of its site. ``aliases``: host, main_host."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    rest = F.regexp_replace(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    one = aliases.groupBy(F.col("host").alias("_host")).agg(F.min("main_host").alias("_main"))
    return df.withColumn("_host", host).join(one, "_host", "left").withColumn(
        "canonical", F.concat(F.lit("https://"), F.coalesce("_main", "_host"), rest)).drop("_host", "_main")


def assign_site(pages: DataFrame, sites: DataFrame, key: str = "page_id", url: str = "url", explicit: str | None = None) -> DataFrame:
    """Site rule of each page: the explicit id, else the site whose host is the page's host or a parent of it.

    ``sites``: site_id, ord, catalog_url, toc_pattern, toc_template ($1, $2 .. for the groups). A host is looked up
    by its few domain suffixes, an equi join instead of a suffix test against every site.
    """
    hosts = sites.select("site_id", "ord", H.url_host(F.col("catalog_url")).alias("_suffix")).filter("_suffix <> ''").groupBy(
        "_suffix").agg(F.min(F.struct("ord", "site_id")).alias("_s"))
    labels = F.split(H.url_host(F.col(url)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    # Distinct hosts are far fewer than pages: match hosts, then join pages to their host.
    per_host = pages.select(H.url_host(F.col(url)).alias("_host"), suffixes.alias("_x")).distinct().select(
        "_host", F.explode("_x").alias("_suffix")).join(hosts, "_suffix").groupBy("_host").agg(F.min("_s").alias("_s"))
    tagged = pages.withColumn("_host", H.url_host(F.col(url))).join(
        per_host.select("_host", F.col("_s.site_id").alias("_by_host")), "_host", "left")
    site = F.coalesce(F.nullif(F.col(explicit), F.lit("")), F.col("_by_host")) if explicit else F.col("_by_host")
    rules = sites.groupBy("site_id").agg(F.min_by(F.struct("toc_pattern", "toc_template"), "ord").alias("_r"))
    joined = tagged.withColumn("site_id", site).join(rules, "site_id", "left").select(
        key, F.col(url).alias("_url"), "site_id", F.col("_r.toc_pattern").alias("_p"), F.col("_r.toc_template").alias("_t"))
    toc = F.when(F.expr("regexp_like(_url, _p)"), F.expr("regexp_replace(regexp_extract(_url, _p, 0), _p, _t)"))
    return joined.select(key, "site_id", F.coalesce(toc, F.col("_url")).alias("toc_url"))


def apply_rules(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Fields of each page by the rule table of its host: (key, source, field, value).

    ``rules``: source, host, field, kind (``regex`` or ``json``), rule. The rules of a host travel as one small array
    to its pages, so a page body is never repeated per rule.
    """
    packed = rules.groupBy(F.col("host").alias("_host")).agg(
        F.array_sort(F.collect_list(F.struct("source", "field", "kind", "rule"))).alias("_rules"))
    joined = pages.select(key, H.url_host(F.col(url)).alias("_host"), F.col(body).alias("_body")).join(packed, "_host")
    values = F.expr("""transform(_rules, r -> struct(r.source AS source, r.field AS field,
        CASE WHEN r.kind = 'json' THEN get_json_object(_body, r.rule) ELSE regexp_extract(_body, r.rule, 1) END AS value))""")
    rows = joined.select(key, F.explode(values).alias("_v")).select(key, "_v.source", "_v.field", "_v.value")
    return rows.filter(F.coalesce(strip(F.col("value")), F.lit("")) != "")


@dataclass(frozen=True)
class ListRule:
    """How a source lists its records, and per field a pattern with one group that is searched inside the element.

    With ``tag``, records are the elements of that name whose opening tag matches ``items``, each with its whole inner
    tree; elements nested in one another are records of their own. Without, ``items`` is the pattern of a whole flat element.
    """

    source: str
    items: str
    fields: Mapping[str, str]
    tag: str | None = None


def extract_records(pages: DataFrame, hosts: DataFrame, rules: Sequence[ListRule], key: str = "page_id", url: str = "url",
                    body: str = "html") -> DataFrame:
    """Records of list pages: (key, source, item_no, field, value), one set of fields for every element of the page.

    ``hosts``: host, source. A page's sources are looked up by its host, names only; every distinct rule is one
    expression with literal patterns, so a pattern is compiled once. Empty values are left out, numbers of elements stay.
    """
    named = hosts.groupBy(F.col("host").alias("_host")).agg(F.collect_set("source").alias("_sources"))
    rows = pages.select(key, H.url_host(F.col(url)).alias("_host"), F.col(body).alias("_body")).join(named, "_host")

    def records(rule: ListRule) -> Column:
        def record(item: Column, place: Column) -> Column:
            values = [F.struct(F.lit(name).alias("field"), F.regexp_extract(item, pattern, 1).alias("value"))
                      for name, pattern in rule.fields.items()]
            return F.struct(F.lit(rule.source).alias("source"), (place + 1).cast("long").alias("item_no"), F.array(*values).alias("values"))

        items = H.whole_elements(F.col("_body"), rule.tag, rule.items) if rule.tag else F.regexp_extract_all("_body", F.lit(rule.items), F.lit(0))
        found = F.transform(items, record)
        return F.when(F.array_contains("_sources", rule.source), found)

    every = rows.select(key, F.explode(elements(F.flatten(F.array_compact(F.array(*map(records, rules)))))).alias("_r"))
    flat = every.select(key, "_r.source", "_r.item_no", F.explode("_r.values").alias("_v")).select(
        key, "source", "item_no", "_v.field", "_v.value")
    return flat.filter(strip(F.col("value")) != "")


# --- JSON paths -----------------------------------------------------------------------------------------------
PATH_STEP = re.compile(
    r"""\.\.(?P<deep>[^.\[*]+)|\.\.\[['"]?(?P<inner>[^'"\]*]+)['"]?\]|\.(?P<star>\*)|\.(?P<field>[^.\[]+)|\[(?P<all>\*)\]|\[\?\(?@(?:\.(?P<f1>[\w-]+)|\[['"](?P<f2>[^'"]+)['"]\])
    \s*(?P<op>==|!=|>=|<=|=~|>|<)\s*(?P<want>.+?)\)?\](?=[.\[]|$)|\[(?P<slice>-?\d*:-?\d*(?::-?\d*)?)\]|\[(?P<index>-?\d+)\]|\[['"](?P<quoted>[^'"]+)['"]\]""",
    re.X,
)


def _deep_values(payloads: Column, name: str) -> Column:
    """All values of a field at any depth of an array of JSON texts, in their order, as JSON texts (Arrow-batched helper)."""

    def values_of(texts) -> list[str]:
        found = []
        for text in texts:
            try:
                open_nodes = [json.loads(text or "")]
            except ValueError:
                continue
            while open_nodes:  # the next node in document order is always on top
                node = open_nodes.pop()
                if not isinstance(node, (dict, list)):
                    continue
                if isinstance(node, dict) and name in node:
                    found.append(json.dumps(node[name], ensure_ascii=False))
                open_nodes += list(node.values() if isinstance(node, dict) else node)[::-1]
        return found

    @F.pandas_udf(ArrayType(StringType()))
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(values_of)

    return scan(payloads)


def _children(value: Column) -> Column:
    as_array = F.try_variant_get(value, "$", "array<variant>")
    as_map = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.coalesce(as_array, as_map, F.array().cast("array<variant>"))


def _matches(item: Column, name: str, op: str, want: str) -> Column:
    wanted = want.strip()
    quoted = len(wanted) > 1 and wanted[0] in "'\"" and wanted[-1] == wanted[0]
    text = wanted[1:-1] if quoted else wanted.strip("/") if op == "=~" else wanted
    have = F.try_variant_get(item, f"$['{name}']", "string")
    if op in ("==", "!="):
        same = have == text
        return F.coalesce(same if op == "==" else ~same, F.lit(False))
    if op == "=~":
        return F.coalesce(have.rlike(text), F.lit(False))
    number, limit = F.try_variant_get(item, f"$['{name}']", "double"), float(text)
    tests = {">": number > limit, "<": number < limit, ">=": number >= limit, "<=": number <= limit}
    return F.coalesce(tests[op], F.lit(False))


def _field(name: str):
    return lambda value: F.try_variant_get(value, f"$['{name}']", "variant")


def _item(place: int):
    return lambda value: F.try_element_at(F.try_variant_get(value, "$", "array<variant>"), F.lit(place))


def _slice(low: str, high: str, step: str = ""):
    by = int(step) if step else 1
    if by == 0:
        raise ValueError("a slice needs a step other than 0")

    def cut(value):
        items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        size = F.size(items)
        # Backwards, places run from the last one to one before the first.
        least, most = (F.lit(0), size) if by > 0 else (F.lit(-1), size - 1)

        def edge(n: str, without: Column) -> Column:
            if not n:
                return without
            return F.least(F.lit(int(n)), most) if int(n) >= 0 else F.greatest(size + int(n), least)

        start, stop = (edge(low, least), edge(high, most)) if by > 0 else (edge(low, most), edge(high, least))
        if by > 0:
            return F.filter(items, lambda _, i: (i >= start) & (i < stop) & ((i - start) % by == 0))
        return F.reverse(F.filter(items, lambda _, i: (i <= start) & (i > stop) & ((start - i) % -by == 0)))

    return cut


def json_extract(df: DataFrame, payload: str, path: str, out: str = "values") -> DataFrame:
    """Values of a JSON path as an array of texts: fields, ``[*]``, indexes (also negative), slices, filters, ``..field``.

    Steps run on variants inside the row. Fields of an object come in name order under ``*``. A deep scan may be any step; it
    follows the order of the document after fields and indexes from the start, name order inside objects after other steps.
    """
    present = lambda v: v.isNotNull()
    current = F.filter(F.array(F.try_parse_json(F.col(payload))), present)
    steps, matches = path.strip().removeprefix("$"), []
    if steps and steps[0] not in ".[":
        steps = "." + steps
    while steps:
        match = PATH_STEP.match(steps)
        if match is None:
            raise ValueError(f"unknown step in path {path}: {steps}")
        matches.append(match)
        steps = steps[match.end():]
    plain = "$"  # the path so far while it names one value
    rows = df
    for number, match in enumerate(matches):
        step = match.groupdict()
        name = step["field"] or step["quoted"]
        deep = step["deep"] or step["inner"]
        before = plain
        if not name and (not step["index"] or int(step["index"]) < 0):
            plain = None
        elif plain:
            plain += f"['{name}']" if name else f"[{step['index']}]"
        if deep:
            held = F.transform(current, lambda v: F.to_json(v))
            if before == "$":
                held = F.array(F.col(payload))
            elif before:
                # The value as it stands in the document; a text value that looks like JSON is no tree.
                held = F.when(F.get(held, 0).rlike(r"^[\[{]"), F.array(F.get_json_object(payload, before)))
            rows = rows if before == "$" else bound(rows, _held=F.coalesce(held, F.array().cast("array<string>"))).withColumnRenamed(
                "_held", f"_held{number}")
            held = held if before == "$" else F.col(f"_held{number}")
            current = F.transform(_deep_values(held, deep), lambda t: F.try_parse_json(t))
        elif name:
            current = F.filter(F.transform(current, _field(name)), present)
        elif step["star"] or step["all"]:
            current = F.flatten(F.transform(current, _children))
        elif step["index"]:
            place = int(step["index"])
            current = F.filter(F.transform(current, _item(place + 1 if place >= 0 else place)), present)
        elif step["slice"]:
            current = F.flatten(F.transform(current, _slice(*step["slice"].split(":"))))
        else:
            test = (step["f1"] or step["f2"], step["op"], step["want"])
            items = F.flatten(F.transform(current, _children))
            current = F.filter(items, _tester(*test))
    texts = F.transform(current, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    return rows.select(*[c for c in df.columns if c != out], F.coalesce(texts, F.array().cast("array<string>")).alias(out))


def _tester(name: str, op: str, want: str):
    return lambda item: _matches(item, name, op, want)


def first_filled(*arrays: Column) -> Column:
    """Fallback rule: the first array that is not empty."""
    return F.coalesce(*[elements(a) for a in arrays], F.array().cast("array<string>"))


def joined(*arrays: Column) -> Column:
    """Joining rule: all values one after the other."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(a, none) for a in arrays])


def regex_step(values: Column, pattern: str, replacement: str = "", first_only: bool = False) -> Column:
    """Replacement after a rule, everywhere or once; values that become empty are dropped."""
    changed = F.transform(values, lambda v: replace_first(v, pattern, replacement) if first_only
                          else F.regexp_replace(v, pattern, replacement))
    return F.filter(changed, lambda v: v != "")


# --- source lists ---------------------------------------------------------------------------------------------
def classify_sources(sources: DataFrame, text: str, js=JS_MARKERS, webview=WEBVIEW_MARKERS, login=LOGIN_MARKERS) -> DataFrame:
    """What a source needs: script runtime, web view, JSON or XPath rules, support level and sorted reasons."""
    body = F.col(text)
    out = sources.select(
        *[c for c in sources.columns if c != text],
        contains_any(body, js).alias("needs_js"), contains_any(body, webview).alias("needs_webview"),
        contains_any(body, login).alias("_login"),
        (body.rlike(JSON_PATH_USE) | F.contains(body, F.lit("@Json:"))).alias("uses_jsonpath"),
        body.rlike(XPATH_USE).alias("uses_xpath"))
    level = (
        F.when((F.col("needs_webview") | F.col("_login")) & F.col("needs_js"), "partial")
        .when(F.col("needs_webview") | F.col("_login"), "webview").when(F.col("needs_js"), "rhino").otherwise("native"))
    reasons = F.array_sort(F.filter(F.array(
        F.when(F.col("needs_webview"), "webview"), F.when(F.col("needs_js"), "rhino"),
        F.when(F.col("_login"), "manual_login")), lambda r: r.isNotNull()))
    return out.withColumn("support_level", level).withColumn("reasons", F.array_join(reasons, ",")).drop("_login")


def source_cache(sources: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First record per source address with a stable id."""
    kept = top_per_key(sources.filter(F.coalesce(F.col(key), F.lit("")) != ""), [key], order, 1)
    return kept.withColumn("source_id", source_id(F.col(key)))


def mine_links(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Import links in free text: scheme links, then direct links with a source word, else decoded query values.

    Returns (keys, pos, link, target); ``target`` is the address behind the link after up to four decoding rounds.
    """
    body = H.unescape(strip(F.regexp_replace(F.col(text), r"^\x{FEFF}", "")))
    base = docs.select(*keys, body.alias("_b"))
    trim = lambda link: F.rtrim(link, F.lit(".,);]"))
    schemes = F.transform(F.regexp_extract_all("_b", F.lit(IMPORT_SCHEME), F.lit(0)), trim)
    direct = F.filter(F.regexp_extract_all("_b", F.lit(DIRECT_LINK), F.lit(0)),
                      lambda u: contains_any(F.lower(u), LINK_TOKENS))
    found = F.array_distinct(F.filter(F.concat(schemes, F.transform(direct, trim)), lambda x: x != ""))
    queries = F.array_distinct(F.transform(
        F.regexp_extract_all("_b", F.lit(IMPORT_KEYS), F.lit(1)), lambda v: trim(url_unquote(v))))
    rows = base.select(*keys, "_b", found.alias("_f")).select(
        *keys, F.posexplode(F.when(F.size("_f") > 0, F.col("_f")).otherwise(queries)).alias("_i", "link"))
    value = F.regexp_extract("link", IMPORT_KEYS, 1)
    target = url_unquote(F.when(value != "", value).otherwise(F.col("link")))
    return rows.select(*keys, (F.col("_i") + 1).cast("long").alias("pos"), "link", target.alias("target"))


def new_urls(found: DataFrame, known: DataFrame, order: list[Column]) -> DataFrame:
    """First sighting of addresses that are not in the catalog."""
    return top_per_key(found.join(known.select("url").distinct(), "url", "left_anti"), ["url"], order, 1)


def reading_order(links: DataFrame, keys: list[str], pos: str = "pos", width: int = 4096) -> DataFrame:
    """Reading order of a chapter list: last entry per address, by chapter number, unnumbered ones last.

    A list with fewer than two numbered entries keeps its order. Adds ``chapter_index`` and ``place``.
    """
    columns = [c for c in links.columns if c not in (*keys, "url")]
    last = links.groupBy(*keys, "url").agg(F.max_by(F.struct(*columns), F.col(pos)).alias("_v")).select(*keys, "url", "_v.*")
    indexed = last.withColumn("chapter_index", chapter_index(F.concat_ws(" ", "title", "url")))
    enough = indexed.groupBy(*keys).agg(F.count("chapter_index").alias("_numbered"))
    both = indexed.join(enough, keys)
    number = F.when(F.col("_numbered") >= 2, F.coalesce(F.col("chapter_index"), F.lit(2**40))).otherwise(F.lit(0).cast("long"))
    ordered = both.withColumn("_no", number)
    # Buckets follow the order: by number, and by position inside the unnumbered tail or an unchanged list.
    by_pos = (F.col("_numbered") < 2) | F.col("chapter_index").isNull()
    bucket = F.when(by_pos, F.col("_no") + F.floor(F.col(pos) / F.lit(width))).otherwise(F.floor(F.col("_no") / F.lit(width)))
    return position(ordered, keys, [F.col("_no"), F.col(pos)], bucket, "place").drop("_no", "_numbered")


# --- site code registry ---------------------------------------------------------------------------------------
SITES: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {}


def site(name: str, job: str):
    """Register a DataFrame function as the ``job`` (search, toc, metadata, chapter) of a site with odd pages."""
    if job not in ("search", "toc", "metadata", "chapter"):
        raise ValueError(f"unknown site job {job}")

    def add(transform: Callable[[DataFrame], DataFrame]):
        SITES.setdefault(name, {})[job] = transform
        return transform

    return add


def run_site_job(pages: DataFrame, job: str, default: Callable[[DataFrame], DataFrame], site_column: str = "site_id") -> DataFrame:
    """Run a job with the registered function of each site and the default for all other pages."""
    special = {name: jobs[job] for name, jobs in SITES.items() if job in jobs}
    rest = pages.filter(~F.coalesce(F.col(site_column), F.lit("")).isin(*special)) if special else pages
    out = default(rest)
    for name, transform in special.items():
        out = out.unionByName(transform(pages.filter(F.col(site_column) == name)), allowMissingColumns=True)
    return out
