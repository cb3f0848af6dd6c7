"""Page queries over ``pages``, ``events`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.operators import pages as W
from corpusloom.plans.registry import query, sql_text, table
from corpusloom.session import CHARSET_OPTIONS
from corpusloom.sources import tables as S

STRIP = sql_text(T.STRIP_CHARS)


def entities(column: str) -> str:
    """Character references that occur in the pages, decoded in SQL (the ampersand last)."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        column = f"replace({column}, '{name}', '{char}')"
    return f"regexp_replace({column}, '&amp;?', '&', 'g')"


def squeezed(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'), {STRIP})"


ANY_TAG = "(?s)</?[A-Za-z!?][^>]*(?:>|\\z)"
BLOCKS = "(?i)</?(?:p|div|br|h1|h2|h3|h4|h5|h6|li|tr|section|article|body|title|blockquote|hr)(?:\\s[^>]*)?/?(?:>|\\z)"


def without(column: str, *tags: str) -> str:
    for tag in tags:
        column = f"regexp_replace({column}, '(?is)<{tag}\\b[^>]*>.*?(?:</{tag}\\s*>|\\z)', '', 'g')"
    return column


NO_COMMENT = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
FLAT = entities(f"regexp_replace(regexp_replace({without(NO_COMMENT, 'script', 'style', 'head')}, '{BLOCKS}', chr(10), 'g'), '{ANY_TAG}', '', 'g')")


@query("s2_html_lines", f"""
SELECT page_id, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM (
  SELECT page_id, string_split(regexp_replace({FLAT}, '\\n$', ''), chr(10)) AS a FROM pages)""")
def html_lines(spark, sf_dir):
    return S.html_to_lines(table(spark, sf_dir, "pages"))


@query("s6_decode_pages", """
SELECT page_id, kind, CASE kind WHEN 'gb' THEN 'gb18030' ELSE 'UTF-8' END AS charset, md5(replace(html, 'charset="utf-8"', 'charset="' || CASE kind WHEN 'gb' THEN 'gbk' WHEN 'none' THEN '' ELSE 'utf-8' END || '"')) AS digest
FROM pages, (SELECT unnest(['gb', 'utf', 'none']) AS kind)""")
def decode_pages(spark, sf_dir):
    # The pages as bytes: declared and encoded as gb, as UTF-8, and as UTF-8 without a declared charset.
    for name, value in CHARSET_OPTIONS.items():
        spark.conf.set(name, value)
    pages = table(spark, sf_dir, "pages")

    def bytes_of(kind, declared, charset):
        text = F.replace("html", F.lit('charset="utf-8"'), F.lit(f'charset="{declared}"'))
        return pages.select("page_id", F.lit(kind).alias("kind"), F.encode(text, charset).alias("content"))

    raw = bytes_of("gb", "gbk", "gb18030").unionByName(bytes_of("utf", "utf-8", "UTF-8")).unionByName(bytes_of("none", "", "UTF-8"))
    return S.decode_pages(raw).select("page_id", "kind", "charset", F.md5("html").alias("digest"))


@query("s5_read_status", """
SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def read_status(spark, sf_dir):
    # Error events carry a payload with a stray bracket, which has to read as nulls.
    payload = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", payload.alias("payload"))
    return S.parse_status(rows, "payload", "k bigint")


@query("s7_import_sources", """
SELECT event_id, 'https://s.example/' || CAST(json_extract(props, '$.k') AS VARCHAR) AS source_url, 'n' || user_id AS source_name
FROM events WHERE event_type <> 'error'""")
def import_sources(spark, sf_dir):
    events = S.spread(table(spark, sf_dir, "events"))
    record = F.to_json(F.struct(
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("https://s.example/"), F.get_json_object("props", "$.k")))
        .alias("bookSourceUrl"), F.concat(F.lit("n"), "user_id").alias("bookSourceName")))
    kind = F.col("event_type")
    payload = (
        F.when(kind == "view", F.concat(F.lit("["), record, F.lit("]")))
        .when(kind == "click", F.concat(F.lit('{"bookSources":['), record, F.lit(',{"bookSourceName":"no address"}]}')))
        .when(kind == "purchase", F.concat(F.lit('{"sources":['), record, F.lit("]}")))
        .otherwise(record))
    return S.import_sources(events.select("event_id", payload.alias("payload"))).drop("raw")


LINKS = f"""
raw_links AS (
  SELECT page_id, url, unnest(range(1, len(h) + 1)) AS pos, unnest(h) AS href, unnest(t) AS inner_html FROM (
    SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']?([^"''\\s>]*)["'']?[^>]*>(.*?)</a\\s*>', 1) AS h,
      regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']?([^"''\\s>]*)["'']?[^>]*>(.*?)</a\\s*>', 2) AS t FROM pages)),
links AS (
  SELECT page_id, min(pos) AS pos, arg_min(href, pos) AS href, arg_min({squeezed(entities(f"regexp_replace(inner_html, '{ANY_TAG}', ' ', 'g')"))}, pos) AS title, full_url AS url
  FROM (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS full_url FROM raw_links) GROUP BY page_id, full_url)
"""


@query("w1_extract_links", f"WITH {LINKS} SELECT * FROM links")
def extract_links(spark, sf_dir):
    return W.extract_links(table(spark, sf_dir, "pages"))


@query("w2_chapter_links", f"""
WITH {LINKS} SELECT * FROM links WHERE (contains(title, 'e') OR contains(title, 'o')) AND title NOT IN ('the', 'de', 'of') AND NOT contains(title, 'an')""")
def chapter_links(spark, sf_dir):
    return W.chapter_links(W.extract_links(table(spark, sf_dir, "pages")), ("e", "o"), ("the", "de", "of"), "an")


# The links of the pages, made to point at books.
@query("w3_book_links", f"""
WITH {LINKS} SELECT page_id, pos, title, regexp_replace(url, '^([a-z]+://[^/]*)/', '\\1/book/') AS url FROM links WHERE length(title) BETWEEN 2 AND 30""")
def book_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit('href="/'), F.lit('href="/book/')))
    return W.book_links(W.extract_links(pages), "page_id").drop("href")


@query("w4_category_links", f"""
WITH {LINKS} SELECT page_id, pos, title AS name, url FROM links WHERE length(title) BETWEEN 1 AND 10 AND NOT contains(href, '#')""")
def category_links(spark, sf_dir):
    return W.category_links(table(spark, sf_dir, "pages"), block=r"(?is)^<nav\b[^>]*>")


@query("w5_page_metadata", f"""
SELECT page_id, {squeezed(entities("regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), '" + ANY_TAG + "', ' ', 'g')"))} AS title,
  CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS cover_url, url AS source_url FROM pages""")
def page_metadata(spark, sf_dir):
    return W.page_metadata(table(spark, sf_dir, "pages")).drop("description")


# Every page gets a logo; two of three a cover in a place of its own, one as a lazily loaded image, the other behind an empty place.
@query("w5_cover_places", """
SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE page_id % 3 WHEN 0 THEN '/logo.png' WHEN 1 THEN '/covers/' || page_id || '.jpg'
  ELSE '/lazy/' || page_id || '.jpg' END AS cover_url FROM pages""")
def cover_places(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    logo, number = F.lit('<img class="cover" src="/logo.png">'), F.col("page_id").cast("string")
    place = F.when(F.col("page_id") % 3 == 1, F.concat(
        F.lit('<p class="cover">no image</p><div class="x book-img"><div><b>new</b></div><img alt="c" src="/covers/'), number, F.lit('.jpg"></div>'))).when(
        F.col("page_id") % 3 == 2, F.concat(F.lit("<span id='fmimg'><img src='' data-src='/lazy/"), number, F.lit(".jpg'></span>"))).otherwise(F.lit(""))
    html = F.replace("html", F.lit("<article>"), F.concat(logo, F.lit("<article>"), place))
    return W.page_metadata(pages.withColumn("html", html)).select("page_id", "cover_url")


ARTICLE = without(without("regexp_replace(regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1), '(?s)<!--.*?-->', '', 'g')",
                          "title", "script", "style"), "a", "h1")


@query("w6_page_text", f"""
WITH cut AS (SELECT page_id, unnest(range(1, 1 + len(a))) AS i, trim(unnest(a), {STRIP}) AS line FROM (
  SELECT page_id, regexp_split_to_array(regexp_replace({ARTICLE}, '{ANY_TAG}', chr(10), 'g'), '[\\r\\n]+') AS a FROM pages)),
body AS (SELECT page_id, string_agg(line, chr(10) ORDER BY i) AS t FROM cut WHERE line <> '' GROUP BY 1)
SELECT p.page_id, CASE WHEN length(t) >= 20 THEN {entities("t")} END AS text FROM pages p LEFT JOIN body b ON b.page_id = p.page_id""")
def page_text(spark, sf_dir):
    return W.page_text(table(spark, sf_dir, "pages"))


@query("w6_page_text_by_rule", f"""
SELECT page_id, CASE WHEN length({squeezed("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")}) >= 20 THEN {entities("trim(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1))")} END AS text FROM pages""")
def page_text_by_rule(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rules = pages.select(H.url_host(F.col("url")).alias("host"), F.lit("(?is)<h1>(.*?)</h1>").alias("pattern")).distinct()
    return W.page_text(pages, rules, containers=())


# Every four pages in a row are the parts of one article; the whole articles are stitched.
@query("w7_stitch_pages", """
WITH RECURSIVE steps AS (
  SELECT url, page_id, regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1) AS t FROM pages),
chain AS (
  SELECT url AS start_url, page_id, 1 AS hop, t AS text FROM steps WHERE contains(url, 'page=') OR page_id % 4 = 0
  UNION ALL SELECT c.start_url, s.page_id, c.hop + 1, c.text || chr(10) || chr(10) || s.t FROM chain c JOIN steps s ON s.page_id = c.page_id + 1 WHERE s.page_id % 4 <> 0)
SELECT start_url, max(hop) AS pages, md5(arg_max(text, hop)) AS digest FROM chain GROUP BY start_url""")
def stitch_pages(spark, sf_dir):
    # An address may hold several pages, which are parts of different articles: the walk goes over page numbers. Of an address's
    # articles the one of most pages stays, then that of the smallest number.
    number = F.col("page_id").cast("string")
    pages = table(spark, sf_dir, "pages")
    following = pages.filter("page_id % 4 <> 0").select((F.col("page_id") - 1).alias("page_id"), number.alias("next_url"))
    linked = pages.select("page_id", number.alias("url"), H.element(F.col("html"), "article").alias("text")).join(following, "page_id", "left")
    starts = pages.filter(F.contains("url", F.lit("page=")) | (F.col("page_id") % 4 == 0)).select("page_id", F.col("url").alias("start"), number.alias("url"))
    whole = W.stitch_pages(starts, linked, 4).withColumnRenamed("start_url", "url").join(starts, "url")
    longest = F.max_by(F.struct("pages", F.md5("text").alias("digest")), F.struct("pages", -F.col("page_id"))).alias("_w")
    return whole.groupBy(F.col("start").alias("start_url")).agg(longest).select("start_url", "_w.pages", "_w.digest")


# Eight pages in a row are a list of contents: each links the next one, the third one on, and the first again.
@query("w7_contents", """
WITH RECURSIVE p AS (SELECT page_id, url, min(page_id) OVER (PARTITION BY url) AS same FROM pages),
link AS (SELECT a.page_id AS page, 1 AS pos, a.page_id + 1 AS next FROM p a WHERE a.page_id % 8 < 7
  UNION ALL SELECT page_id, 2, page_id + 3 FROM p WHERE page_id % 8 < 5 UNION ALL SELECT page_id, 3, page_id - page_id % 8 FROM p WHERE page_id % 8 > 0),
walk AS (SELECT page_id AS start, page_id AS page, 0 AS hops, []::INTEGER[] AS way, [page_id] AS seen FROM p WHERE page_id % 8 < 2
  UNION ALL SELECT w.start, l.next, w.hops + 1, w.way || [l.pos], w.seen || [l.next] FROM walk w JOIN link l ON l.page = w.page JOIN p ON p.page_id = l.next
  WHERE NOT list_contains(w.seen, l.next)),
best AS (SELECT start, page, min({'hops': hops, 'way': way}) AS best FROM walk GROUP BY start, page),
chapter AS (SELECT page_id AS page, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS item FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">') AS a FROM pages)),
listed AS (SELECT start, regexp_extract(item, 'href="([^"]*)"', 1) AS chapter_url, min({'best': best, 'pos': pos}) AS f FROM best JOIN chapter USING (page) GROUP BY ALL)
SELECT 'c' || start AS start_url, row_number() OVER (PARTITION BY start ORDER BY f, chapter_url) AS ord, chapter_url FROM listed WHERE chapter_url <> ''""")
def contents(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("n", F.col("page_id") % 8)

    def name(number):
        return F.concat(F.lit("c"), number)

    def linked(pos, allowed, to):
        return pages.filter(allowed).select(name(F.col("page_id")).alias("url"), F.lit(pos).alias("pos"), to.alias("to"))

    targets = pages.select(F.col("page_id").alias("to"), name(F.col("page_id")).alias("next_url"))
    number = F.col("page_id")
    links = linked(1, F.col("n") < 7, number + 1).union(linked(2, F.col("n") < 5, number + 3)).union(linked(3, F.col("n") > 0, number - F.col("n")))
    items = pages.select(name(number).alias("url"), F.posexplode(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">'), F.lit(1))).alias("pos", "chapter_url"))
    starts = pages.filter("n < 2").select(name(number).alias("url"))
    return W.contents(starts, links.join(targets, "to"), items.withColumn("title", F.lit(""))).select("start_url", "ord", "chapter_url")


@query("w8_canonical_url", """
SELECT page_id, 'https://' || regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^(www|m|blog)\\.', '') || regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS canonical FROM pages""")
def canonical_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    aliases = pages.select(host.alias("host"), F.regexp_replace(host, r"^(www|m|blog)\.", "").alias("main_host")).distinct()
    return W.canonical_url(pages.select("page_id", "url"), aliases).select("page_id", "canonical")


@query("w9_assign_site", """
WITH h AS (SELECT page_id, url, regexp_extract(url, '([a-z0-9\\-]+\\.example\\.[a-z]+)', 1) AS d FROM pages)
SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'fixed' WHEN contains(url, 'example.com') THEN d END AS site_id,
  CASE WHEN page_id % 10 <> 0 AND contains(url, 'example.com') AND regexp_matches(url, '/([a-z]+)/([0-9]+)')
    THEN 'https://' || d || '/toc/' || regexp_extract(url, '/([a-z]+)/([0-9]+)', 2) || '?lang=' || regexp_extract(url, '/([a-z]+)/([0-9]+)', 1) ELSE url END AS toc_url
FROM h""")
def assign_site(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("site", F.when(F.col("page_id") % 10 == 0, "fixed").otherwise(""))
    domain = F.regexp_extract("url", r"([a-z0-9\-]+\.example\.[a-z]+)", 1)
    sites = pages.filter(F.contains("url", F.lit("example.com"))).select(domain.alias("site_id")).distinct().select(
        "site_id", F.xxhash64("site_id").alias("ord"), F.concat(F.lit("http://"), "site_id", F.lit("/top")).alias("catalog_url"),
        F.lit(r"/([a-z]+)/([0-9]+)").alias("toc_pattern"), F.concat(F.lit("https://"), "site_id", F.lit(r"/toc/$2?lang=$1")).alias("toc_template"))
    return W.assign_site(pages, sites, explicit="site")


@query("w10_apply_rules", """
WITH v AS (
  SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS source, 'title' AS field, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS value FROM pages
  UNION ALL SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', ''), 'lang', regexp_extract(html, '<html lang="([a-z]+)"', 1) FROM pages WHERE contains(url, 'example.com')
  UNION ALL SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', ''), 'first_link', regexp_extract(html, '<a href="([^"]*)"', 1) FROM pages)
SELECT * FROM v WHERE trim(value) <> ''""")
def apply_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(H.url_host(F.col("url")).alias("host"), F.contains("url", F.lit("example.com")).alias("com")).distinct()
    rules = hosts.select("host", F.col("host").alias("source"), F.lit("regex").alias("kind"), F.explode(F.filter(F.array(
        F.struct(F.lit("title").alias("field"), F.lit("(?is)<title>(.*?)</title>").alias("rule")),
        F.when(F.col("com"), F.struct(F.lit("lang").alias("field"), F.lit('<html lang="([a-z]+)"').alias("rule"))),
        F.struct(F.lit("first_link").alias("field"), F.lit('<a href="([^"]*)"').alias("rule"))), lambda r: r.isNotNull())).alias("r"))
    return W.apply_rules(pages, rules.select("source", "host", "r.field", "kind", "r.rule"))


@query("w10_apply_json_rules", """
SELECT event_id, 'events' AS source, 'kind' AS field, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events""")
def apply_json_rules(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("https://e"), F.col("user_id") % 7, F.lit(".example/")).alias("url"), F.col("props").alias("html"))
    rules = events.select(H.url_host(F.col("url")).alias("host")).distinct().select(
        F.lit("events").alias("source"), "host", F.lit("kind").alias("field"), F.lit("json").alias("kind"), F.lit("$.k").alias("rule"))
    return W.apply_rules(events, rules, "event_id")


# Every link of the navigation list is a record of its own, with an address and, in most, a title.
@query("w10_list_rules", """
WITH e AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, unnest(range(1, len(a) + 1)) AS item_no, unnest(a) AS item FROM (
    SELECT page_id, url, regexp_extract_all(html, '<li>.*?</li>') AS a FROM pages)),
v AS (
  SELECT page_id, 'menu' AS source, item_no, 'link' AS field, regexp_extract(item, 'href="([^"]*)"', 1) AS value FROM e WHERE contains(host, '.example.')
  UNION ALL SELECT page_id, 'menu', item_no, 'long_title', regexp_extract(item, '>([^<>]{4,})</a>', 1) FROM e WHERE contains(host, '.example.'))
SELECT * FROM v WHERE trim(value) <> ''""")
def list_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hosts = pages.filter(F.contains(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit(".example."))).select(
        H.url_host(F.col("url")).alias("host"), F.lit("menu").alias("source")).distinct()
    rule = W.ListRule("menu", "<li>.*?</li>", {"link": 'href="([^"]*)"', "long_title": ">([^<>]{4,})</a>"})
    return W.extract_records(pages, hosts, [rule])


# The page's menu becomes the inner list of one item, with a tail behind it; items of both levels are records.
@query("w10_nested_rules", """
WITH h AS (SELECT page_id, '<ul><li class="top"><a href="/top">t</a>' || regexp_extract(html, '<nav>(.*?)</nav>', 1) || 'tail ' || page_id || '</li><li>last' AS h FROM pages
  WHERE contains(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.example.')),
t AS (SELECT page_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS piece FROM (
  SELECT page_id, string_split(replace(replace(h, '<li', chr(1) || '<li'), '</li>', chr(1) || '</li>'), chr(1)) AS a FROM h)),
d AS (SELECT *, CASE WHEN starts_with(piece, '<li') THEN 1 WHEN starts_with(piece, '</li>') THEN -1 ELSE 0 END AS s FROM t),
e AS (SELECT *, sum(s) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM d),
span AS (SELECT o.page_id, o.i AS a, coalesce(min(c.i), 1000000) AS b FROM e o LEFT JOIN e c ON c.page_id = o.page_id AND c.i > o.i AND c.s = -1 AND c.depth = o.depth - 1
  WHERE o.s = 1 GROUP BY ALL),
item AS (SELECT span.page_id, span.a, row_number() OVER (PARTITION BY span.page_id ORDER BY span.a) AS item_no, string_agg(piece, '' ORDER BY i) AS item
  FROM span JOIN t ON t.page_id = span.page_id AND t.i >= span.a AND t.i < span.b GROUP BY span.page_id, span.a),
v AS (SELECT page_id, 'nested' AS source, item_no, 'inner' AS field, regexp_extract(item, 'href="([^"]*)".*href="([^"]*)"', 2) AS value FROM item
  UNION ALL SELECT page_id, 'nested', item_no, 'tail', regexp_extract(item, '</ul>([^<]*)$', 1) FROM item
  UNION ALL SELECT page_id, 'nested', item_no, 'size', regexp_extract(item, '^(?s)(.*)$', 1) FROM item
  UNION ALL SELECT page_id, 'tops', 1, 'size', regexp_extract(item, '^(?s)(.*)$', 1) FROM item WHERE item_no = 1)
SELECT page_id, source, item_no, field, md5(value) AS digest FROM v WHERE trim(value) <> ''""")
def nested_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat(
        F.lit('<ul><li class="top"><a href="/top">t</a>'), F.regexp_extract("html", "<nav>(.*?)</nav>", 1), F.lit("tail "), F.col("page_id"), F.lit("</li><li>last")))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    named = pages.filter(F.contains(host, F.lit(".example."))).select(H.url_host(F.col("url")).alias("host")).distinct()
    hosts = named.withColumn("source", F.explode(F.array(F.lit("nested"), F.lit("tops"))))
    rules = [W.ListRule("nested", "^<li", {"inner": 'href="[^"]*".*href="([^"]*)"', "tail": "</ul>([^<]*)$", "size": "(?s)^(.*)$"}, tag="li"),
             W.ListRule("tops", '^<li class="top"', {"size": "(?s)^(.*)$"}, tag="li")]
    return W.extract_records(pages, hosts, rules).select("page_id", "source", "item_no", "field", F.md5("value").alias("digest"))


@query("w11_json_extract", """
SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k,
  array_to_string([CAST(json_extract(props, '$.k') AS VARCHAR), CAST(user_id AS VARCHAR)], ',') AS deep,
  CASE WHEN CAST(json_extract(props, '$.k') AS INT) >= 50 THEN CAST(event_id AS VARCHAR) ELSE '' END AS big, CAST(user_id AS VARCHAR) AS last,
  event_id || ',-1' AS inner_ids, array_to_string([CAST(user_id AS VARCHAR), CAST(json_extract(props, '$.k') AS VARCHAR)], ',') AS backwards
FROM events""")
def json_extract(spark, sf_dir):
    # A nested record per event: the payload as first item of a list, the user as second.
    events = S.spread(table(spark, sf_dir, "events")).select("event_id", F.concat(
        F.lit('{"box":{"items":[{"id":'), "event_id", F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit('},{"k":'), "user_id",
        F.lit(',"id":-1}]}}')).alias("payload"))
    out = W.json_extract(events, "payload", "$.box.items[0].k", "k")
    out = W.json_extract(out, "payload", "$..k", "deep")
    out = W.json_extract(out, "payload", "$.box.items[-1].k", "last")
    out = W.json_extract(out, "payload", "$.box..id", "inner_ids")
    out = W.json_extract(out, "payload", "$.box.items[::-1].k", "backwards")
    wide = W.json_extract(out, "payload", "$.box['items'][?(@.k >= 50)].id", "big")
    return wide.select(
        F.array_join("inner_ids", ",").alias("inner_ids"), F.array_join("backwards", ",").alias("backwards"),
        "event_id", F.array_join("k", ",").alias("k"), F.array_join("deep", ",").alias("deep"),
        F.array_join(F.filter("big", lambda v: v != "-1"), ",").alias("big"), F.array_join("last", ",").alias("last"))


@query("w12_combine_rules", """
WITH r AS (SELECT page_id, regexp_extract_all(html, '<h2>(.*?)</h2>', 1) AS none, regexp_extract_all(html, '<h1>(.*?)</h1>', 1) AS h1, regexp_extract_all(html, '<title>(.*?)</title>', 1) AS title FROM pages)
SELECT page_id, array_to_string(h1, '|') AS fallback, array_to_string(h1 || title, '|') AS joined,
  array_to_string([x FOR x IN [regexp_replace(y, '[ae]', '', 'g') FOR y IN title] IF x <> ''], '|') AS cleaned,
  array_to_string([x FOR x IN [regexp_replace(y, '[ae]', '_') FOR y IN title] IF x <> ''], '|') AS once FROM r""")
def combine_rules(spark, sf_dir):
    def every(tag):
        return F.regexp_extract_all("html", F.lit(f"<{tag}>(.*?)</{tag}>"), F.lit(1))

    h2, h1, title = every("h2"), every("h1"), every("title")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.array_join(W.first_filled(h2, h1, title), "|").alias("fallback"), F.array_join(W.joined(h1, h2, title), "|").alias("joined"),
        F.array_join(W.regex_step(title, "[ae]"), "|").alias("cleaned"), F.array_join(W.regex_step(title, "[ae]", "_", True), "|").alias("once"))


@query("w13_classify_sources", """
WITH m AS (SELECT page_id, contains(html, '***') AS js, contains(html, '###') AS wv, contains(html, '$$$') AS login,
  regexp_matches(html, '(^|[^\\w])\\$[.\\[]') OR contains(html, '@Json:') AS jp, regexp_matches(html, '(^|[@\\s])(/|//|@XPath:)') AS xp FROM pages)
SELECT page_id, js AS needs_js, wv AS needs_webview, jp AS uses_jsonpath, xp AS uses_xpath,
  CASE WHEN (wv OR login) AND js THEN 'partial' WHEN wv OR login THEN 'webview' WHEN js THEN 'rhino' ELSE 'native' END AS support_level,
  concat_ws(',', CASE WHEN login THEN 'manual_login' END, CASE WHEN js THEN 'rhino' END, CASE WHEN wv THEN 'webview' END) AS reasons FROM m""")
def classify_sources(spark, sf_dir):
    return W.classify_sources(table(spark, sf_dir, "pages").select("page_id", "html"), "html", ("***",), ("###",), ("$$$",))


@query("w14_source_cache", """
SELECT host, page_id, 'source:' || substr(sha1(host), 1, 12) AS source_id FROM (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1)""")
def source_cache(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), "page_id")
    return W.source_cache(rows, "host", [F.col("page_id")])


@query("w15_mine_links", """
WITH l AS (
  SELECT page_id, 1 AS pos, 'yuedu://booksource/importonline?src=' || url_encode(url_encode(url)) AS link, url AS target FROM pages
  UNION ALL SELECT page_id, 2, 'https://files.example/' || page_id || '.json', 'https://files.example/' || page_id || '.json' FROM pages WHERE NOT contains(url, 'page='))
SELECT * FROM l""")
def mine_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    direct = F.when(F.contains("url", F.lit("page=")), "https://plain.example/x").otherwise(
        F.concat(F.lit("https://files.example/"), "page_id", F.lit(".json")))
    text = F.concat(
        F.lit("import <a href='yuedu://booksource/importonline?src="), F.url_encode(F.url_encode("url")), F.lit("'>here</a> or ("),
        direct, F.lit(") and again "), direct, F.lit("."))
    return W.mine_links(pages.select("page_id", text.alias("text")), ["page_id"])


@query("p2_chapter_index", """
SELECT page_id, CAST(regexp_extract_all(url, '[0-9]{1,6}')[-1] AS BIGINT) AS chapter_index FROM pages""")
def chapter_index(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.chapter_index(F.col("url")).alias("chapter_index"))


@query("p4_flag_blocked", """
SELECT page_id, contains(html, '###') OR contains(html, 'erste') OR contains(html, '%%%') AS blocked FROM pages""")
def flag_blocked(spark, sf_dir):
    return W.flag_blocked(table(spark, sf_dir, "pages"), ("###", "erste", "%%%")).select("page_id", "blocked")


@query("j10_new_urls", """
WITH f AS (SELECT regexp_replace(url, '[?#].*$', '') AS url, min(page_id) AS page_id FROM pages WHERE page_id % 3 <> 0 GROUP BY 1)
SELECT url, page_id FROM f WHERE url NOT IN (SELECT regexp_replace(url, '[?#].*$', '') FROM pages WHERE page_id % 3 = 0)""")
def new_urls(spark, sf_dir):
    # The catalog holds every third page, the scan found the others.
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    known = rows.filter(F.col("page_id") % 3 == 0)
    return W.new_urls(rows.filter(F.col("page_id") % 3 != 0), known, [F.col("page_id")])


@query("g11_cap_per_site", """
SELECT host, page_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM (
  SELECT regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/?#]*)', 1) AS host, page_id FROM pages)) WHERE n <= 20""")
def cap_per_site(spark, sf_dir):
    from corpusloom.operators.catalog import cap_per_site as cap

    rows = table(spark, sf_dir, "pages").select(H.url_host(F.col("url")).alias("host"), "page_id")
    return cap(rows, "host", [F.col("page_id")])


@query("g2_reading_order", """
WITH l AS (
  SELECT regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/?#]*)', 1) AS host, page_id AS pos,
    CASE WHEN contains(url, 'utm_') THEN 'extra' ELSE regexp_replace(url, '^[a-z]+://[^/]*|[?#].*$', '', 'g') END AS url FROM pages),
last AS (SELECT host, url, max(pos) AS pos FROM l GROUP BY 1, 2),
i AS (SELECT *, CASE WHEN regexp_matches(url, '[0-9]') THEN CAST(regexp_extract_all(url, '[0-9]{1,6}')[-1] AS BIGINT) END AS chapter_index FROM last),
c AS (SELECT *, count(chapter_index) OVER (PARTITION BY host) AS numbered FROM i)
SELECT host, url, chapter_index, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN numbered < 2 THEN 0 ELSE coalesce(chapter_index, 1099511627776) END, pos) AS place FROM c""")
def reading_order(spark, sf_dir):
    path = F.when(F.contains("url", F.lit("utm_")), "extra").otherwise(F.regexp_replace("url", "^[a-z]+://[^/]*|[?#].*$", ""))
    links = table(spark, sf_dir, "pages").select(
        H.url_host(F.col("url")).alias("host"), F.col("page_id").alias("pos"), F.lit("").alias("title"), path.alias("url"))
    return W.reading_order(links, ["host"], width=64).select("host", "url", "chapter_index", "place")


@query("x3_site_registry", """
SELECT page_id, CASE WHEN contains(url, 'spam-farm') THEN 'special ' || page_id ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END AS title FROM pages""")
def site_registry(spark, sf_dir):
    @W.site("spam-farm", "metadata")
    def special(pages):
        return pages.select("page_id", F.concat(F.lit("special "), "page_id").alias("title"))

    pages = table(spark, sf_dir, "pages").withColumn(
        "site_id", F.when(F.contains("url", F.lit("spam-farm")), "spam-farm").otherwise("other"))
    return W.run_site_job(pages, "metadata", lambda p: p.select("page_id", H.element(F.col("html"), "title").alias("title")))
