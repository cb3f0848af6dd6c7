"""Links, metadata, text, addresses, rules, source lists on small literal pages."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.operators import corpus as C
from corpusloom.operators import pages as W
from corpusloom.sources import tables as S

HEAD = """<html><head><meta name="description" content="Twelve letters from a lighthouse, in order." />
  <meta content="The Lamp | Harbour Shelf" property="og:title"><meta property="og:title" content="The Lamp | Harbour Shelf">
  <meta property="og:image" content="../img/lamp.png"></head><body><p class="meta author">作家: M. Reed</p></body></html>"""
SHELF = """<html><body><div class="book"><h1>Tide Tables</h1><div id="intro"><p>The first paragraph of a note.</p>
  <div><p>A second one, deeper down.</p></div><p>And a third.</p></div><p>作者：Ines K</p></div>
  <ol><li><a href="../t/12.html">第12章 潮</a></li><li><a href="../t/11.html">第11章 岸</a></li>
  <li><a href="../t/11.html">第11章 岸</a></li><li><a href="/">首页</a></li></ol></body></html>"""
NESTED = """<body><div class="side"><div>menu</div></div><div id="content" class="wide"><div class="part"><p>第一段写在最里面的盒子里，够长了吧。</p>
  <div><p>第二段更深。</p></div></div><script>late()</script><p>第三段在外面。</p><a href="n.html">下一页</a></div><div>footer</div></body>"""


def page(spark, html, url="https://example.test/book/1/"):
    return spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")


def test_metadata(spark):
    row = W.page_metadata(page(spark, HEAD)).first()
    assert row.title == "The Lamp" and row.author == "M. Reed"
    assert row.description == "Twelve letters from a lighthouse, in order."
    assert row.cover_url == "https://example.test/book/img/lamp.png"
    row = W.page_metadata(page(spark, SHELF)).first()
    # In running text the name ends at the first space; a label class takes the whole name.
    assert row.title == "Tide Tables" and row.author == "Ines"
    assert row.description == "The first paragraph of a note. A second one, deeper down. And a third."
    row = W.page_metadata(page(spark, "<html><head><title>Only &amp; title_site</title></head><body>x</body></html>")).first()
    assert (row.title, row.author, row.cover_url) == ("Only & title", None, None)
    short = W.page_metadata(page(spark, "<div id='intro'>short</div><div class='desc'>last</div>")).first()
    assert short.description == "last"


def test_toc_links_in_reading_order(spark):
    links = W.chapter_links(W.extract_links(page(spark, SHELF)))
    ordered = W.reading_order(links, ["page_id"]).orderBy("place").collect()
    assert [(r.title, r.url, r.place) for r in ordered] == [
        ("第11章 岸", "https://example.test/book/t/11.html", 1), ("第12章 潮", "https://example.test/book/t/12.html", 2)]


def test_nested_navigation(spark):
    html = "<ul class='nav'><li><a href='/a'>One</a><ul><li><a href='/b'>Two</a></li></ul></li><li><a href='/c'>Three</a></li></ul><a href='/d'>Out</a>"
    assert {(r.name, r.url) for r in W.category_links(page(spark, html)).collect()} == {
        ("One", "https://example.test/a"), ("Two", "https://example.test/b"), ("Three", "https://example.test/c")}


def test_dot_steps(spark):
    rows = {"../../x": "http://h/x", "../../../../../../x": "http://h/x", "/c/../d": "http://h/d", "./y?q=./z": "http://h/a/b/y?q=./z",
            "..": "http://h/a/", "z/./k/": "http://h/a/b/z/k/", "/p?u=/../q": "http://h/p?u=/../q"}
    frame = spark.createDataFrame([(h,) for h in rows], "h string")
    got = {r.h: r.u for r in frame.select("h", H.join_url(F.lit("http://h/a/b/c.html"), F.col("h")).alias("u")).collect()}
    assert got == rows


def test_reading_order_newest_first(spark):
    rows = [("n", i + 1, f"第{n}章", f"https://x/txt/{n}") for i, n in enumerate((1072, 1071, 1070))]
    frame = spark.createDataFrame(rows, "n string, pos int, title string, url string")
    assert [r.chapter_index for r in W.reading_order(frame, ["n"]).orderBy("place").collect()] == [1070, 1071, 1072]
    plain = spark.createDataFrame([("n", 1, "b", "u/b"), ("n", 2, "a", "u/a"), ("n", 3, "第3章", "u/c")],
                                  "n string, pos int, title string, url string")
    assert [r.title for r in W.reading_order(plain, ["n"]).orderBy("place").collect()] == ["b", "a", "第3章"]


def test_chapter_text(spark):
    assert W.page_text(page(spark, NESTED)).first().text == "第一段写在最里面的盒子里，够长了吧。\n第二段更深。\n第三段在外面。"
    rules = spark.createDataFrame([("example.test", "(?s)<div class=.part.><p>(.*?)</p>")], "host string, pattern string")
    assert W.page_text(page(spark, NESTED), rules, minimum=5).first().text == "第一段写在最里面的盒子里，够长了吧。"
    assert W.page_text(page(spark, "<div id='content'>短</div>")).first().text is None


def test_blocked_pages(spark):
    frame = spark.createDataFrame([("<title>Just a moment...</title>",), ("<p>fine</p>",), (None,)], "html string")
    assert [r.blocked for r in W.flag_blocked(frame).collect()] == [True, False, False]


def test_html_to_lines(spark):
    html = "<html><head><title>t</title></head><body><h1>第1章 A&amp;B</h1><p>x<br>y</p><script>var a='<p>';</script><style>p{}</style>z</body>"
    lines = [r.line for r in S.html_to_lines(page(spark, html)).orderBy("line_no").collect()]
    assert [x for x in lines if x] == ["第1章 A&B", "x", "y", "z"]


def test_stitched_articles_stay_apart_under_one_address(spark, tmp_path):
    """Pages 0 to 3 and 4 to 7 are two articles; page 4 has the address of page 1, page 8 that of page 0 and no second page."""
    from corpusloom.plans import pages as plans

    urls = ["u0", "u1", "u2", "u3", "u1", "u5", "u6", "u7", "u0"]
    spark.createDataFrame([(i, u, f"<article>t{i}</article>") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(
        str(tmp_path / "pages.parquet"))
    digest = {t: hashlib.md5(t.encode()).hexdigest() for t in ("t0\n\nt1\n\nt2\n\nt3", "t4\n\nt5\n\nt6\n\nt7")}
    got = {(r.start_url, r.pages, r.digest) for r in plans.stitch_pages(spark, str(tmp_path)).collect()}
    assert got == {("u0", 4, digest["t0\n\nt1\n\nt2\n\nt3"]), ("u1", 4, digest["t4\n\nt5\n\nt6\n\nt7"])}


def test_stitch_pages(spark):
    pages = spark.createDataFrame(
        [("a", "1", "b"), ("b", "2", "c"), ("c", "3", "a"), ("d", "4", None), ("e", "", "d")], "url string, text string, next_url string")
    starts = spark.createDataFrame([("a",), ("d",), ("e",), ("x",)], "url string")
    out = {r.start_url: (r.pages, r.text) for r in W.stitch_pages(starts, pages, 8, "+").collect()}
    assert out == {"a": (3, "1+2+3"), "d": (1, "4"), "e": (2, "4"), "x": (0, "")}
    assert {r.start_url: r.text for r in W.stitch_pages(starts, pages, 2, "+").collect()}["a"] == "1+2"


def test_reading_order_of_many_links(spark):
    """A queue of next links, read page by page, against the doubled steps: chains, forks, cycles, dead ends, no links."""
    import random
    rnd = random.Random(8)
    links = [(f"l{i}", 0, f"l{i + 1}") for i in range(300)] + [("l300", 0, "l7")]
    links += [(f"r{rnd.randrange(40)}", rnd.randrange(5), f"r{rnd.randrange(40)}") for _ in range(90)] + [("r1", None, None), (None, 1, "r2"), ("r1", 1, "gone")]
    frame = spark.createDataFrame(links, "url string, pos int, next_url string")
    starts = spark.createDataFrame([("l0",), ("l250",), ("r1",), ("r5",), ("alone",), (None,), ("r1",)], "url string")
    following = {}
    for url, pos, to in sorted((x for x in links if x[0] and x[2]), key=lambda x: (x[1], x[2])):
        following.setdefault(url, [])
        if to not in following[url]:
            following[url].append(to)

    def queued(start):
        queue, read = [start], []
        while queue:
            page = queue.pop(0)
            read.append(page)
            queue += [n for n in following.get(page, []) if n not in read and n not in queue]
        return read

    got = {}
    for r in sorted(W.pages_in_turn(starts, frame).collect(), key=lambda r: (r.hops, [tuple(t) for t in r.turns])):
        got.setdefault(r.start_url, []).append(r.url)
    assert got == {s: queued(s) for s in ("l0", "l250", "r1", "r5", "alone")}
    first = W.pages_in_turn(starts, frame, 3).filter("start_url = 'r1'").collect()
    assert {r.url for r in first} == set(queued("r1")[:3])


def test_contents_over_pages(spark):
    links = spark.createDataFrame([("p1", 0, "p2"), ("p1", 1, "p3"), ("p2", 0, "p3"), ("p3", 0, "p1")], "url string, pos int, next_url string")
    chapters = spark.createDataFrame(
        [("p1", 0, "c1", "One"), ("p1", 1, "c2", "Two"), ("p2", 0, "c2", "Two again"), ("p2", 1, "c4", "Four"), ("p3", 0, "c3", "Three"),
         ("p3", 1, "", "none"), ("p9", 0, "c9", "other")], "url string, pos int, chapter_url string, title string")
    starts = spark.createDataFrame([("p1",), ("p3",)], "url string")
    out = {}
    for r in W.contents(starts, links, chapters).orderBy("start_url", "ord").collect():
        out.setdefault(r.start_url, []).append((r.ord, r.title))
    assert out == {"p1": [(1, "One"), (2, "Two"), (3, "Four"), (4, "Three")], "p3": [(1, "Three"), (2, "One"), (3, "Two"), (4, "Four")]}
    assert W.contents(starts.limit(0), links, chapters).collect() == []


def test_canonical_url_and_site(spark):
    pages = spark.createDataFrame([(1, "http://www.a.test/x?y=1", ""), (2, "https://m.b.test/info/7/", "")], "page_id int, url string, site string")
    alias = spark.createDataFrame([("www.a.test", "a.test")], "host string, main_host string")
    assert [r.canonical for r in W.canonical_url(pages, alias).orderBy("page_id").collect()] == [
        "https://a.test/x?y=1", "https://m.b.test/info/7/"]
    sites = spark.createDataFrame([("sa", 1, "https://www.a.test/", None, None), ("sb", 2, "https://b.test/top", r"/info/(\d+)/", "https://b.test/toc/$1.html")],
                                  "site_id string, ord int, catalog_url string, toc_pattern string, toc_template string")
    out = {r.page_id: (r.site_id, r.toc_url) for r in W.assign_site(pages, sites).collect()}
    assert out == {1: ("sa", "http://www.a.test/x?y=1"), 2: ("sb", "https://b.test/toc/7.html")}


STORE = json.dumps({"shop": {"lamp": [
    {"name": "oil", "watt": 4, "type-of": "old"}, {"name": "arc", "watt": 60, "type-of": "new"}, {"name": "led", "watt": 90, "type-of": "old"}],
    "attic": {"lamp": [{"name": "gas", "watt": 2}]}}, "rows": [{"id": "u"}, {"id": "v"}], "note": '{"name": "text"}'})


@pytest.mark.parametrize("path, want", [
    ("$..name", ["oil", "arc", "led", "gas"]),
    ("$.shop.lamp[1:].name", ["arc", "led"]),
    ("$.shop.lamp[-2:].name", ["arc", "led"]),
    ("$.shop.lamp[:-1].name", ["oil", "arc"]),
    ("$.shop.lamp[?(@.watt >= 60)].name", ["arc", "led"]),
    ("$.shop.lamp[?(@['type-of'] == 'old')].name", ["oil", "led"]),
    ("$.shop.lamp[?(@.name =~ /^(oil|arc)/)].watt", ["4", "60"]),
    ("$.shop.lamp[?(@.watt != 4)].name", ["arc", "led"]),
    ("$.shop['lamp'][0]['type-of']", ["old"]),
    ("$.rows[*].id", ["u", "v"]),
    ("$.rows[1].id", ["v"]),
    ("$.rows[-1].id", ["v"]),
    ("$.rows[9].id", []),
    ("$.none", []),
    ("$.shop.lamp[::2].name", ["oil", "led"]),
    ("$.shop.lamp[1:9:2].name", ["arc"]),
    ("$.shop.lamp[::-1].name", ["led", "arc", "oil"]),
    ("$.shop.lamp[-1:0:-1].name", ["led", "arc"]),
    ("$.shop.lamp[9:-9:-2].name", ["led", "oil"]),
    ("$.shop..name", ["oil", "arc", "led", "gas"]),
    ("$.shop.lamp[1]..['type-of']", ["new"]),
    ("$.shop.lamp[-2:]..watt", ["60", "90"]),
    ("$..lamp..name", ["oil", "arc", "led", "gas"]),
    ("$.note..name", []),
    ("rows[0]..id", ["u"]),
])
def test_json_paths(spark, path, want):
    frame = spark.createDataFrame([(STORE,), ("{broken",)], "p string")
    rows = W.json_extract(frame, "p", path).collect()
    assert rows[0]["values"] == want and rows[1]["values"] == []


def test_unknown_json_steps_raise(spark):
    frame = spark.createDataFrame([(STORE,)], "p string")
    for path in ("$.rows[0,1]", "$.rows[::0]", "$..*"):
        with pytest.raises(ValueError):
            W.json_extract(frame, "p", path)


def test_rule_combination(spark):
    frame = spark.createDataFrame([(["a1b1"], [], ["z"])], "x array<string>, y array<string>, z array<string>")
    row = frame.select(
        W.first_filled(F.col("y"), F.col("x")).alias("fallback"), W.joined(F.col("x"), F.col("y"), F.col("z")).alias("joined"),
        W.regex_step(F.col("x"), r"(\d)", "<$1>").alias("every"), W.regex_step(F.col("x"), r"(\d)", "<$1>", True).alias("once"),
        W.regex_step(F.col("z"), "z").alias("dropped")).first()
    assert row.fallback == ["a1b1"] and row.joined == ["a1b1", "z"]
    assert row.every == ["a<1>b<1>"] and row.once == ["a<1>b1"] and row.dropped == []


def test_source_classes(spark):
    sources = [
        {"bookSourceUrl": "https:example", "bookSourceName": "Native"},
        {"bookSourceUrl": "x", "searchUrl": "@js:'https://js.example.test'"},
        {"bookSourceUrl": "x", "jsLib": "var token = 1;", "webJs": "1"},
        {"bookSourceUrl": "x", "loginUi": "1"},
    ]
    frame = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(sources)], "i int, t string")
    out = W.classify_sources(frame, "t").orderBy("i").collect()
    assert [(r.support_level, r.reasons) for r in out] == [
        ("native", ""), ("rhino", "rhino"), ("partial", "rhino,webview"), ("webview", "manual_login,webview")]


def test_import_sources(spark):
    from urllib.parse import quote

    one = {"bookSourceUrl": "u1", "bookSourceName": "n1"}
    rows = [json.dumps([one, {"bookSourceName": "none"}]), json.dumps({"bookSources": [one]}), json.dumps({"sources": [one]}),
            json.dumps(one), "broken {", json.dumps({"bookSources": []})]
    rows[4:4] = ['<html><script>\nwindow.sources = [{"bookSourceUrl":"u1","bookSourceName":"n1"}];\n</script></html>',
                 json.dumps([one]).replace('"', "&quot;"), quote(json.dumps({"sources": [one]}))]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, payload string")
    out = S.import_sources(frame).orderBy("i").collect()
    assert [(r.i, r.source_url, r.source_name) for r in out] == [(i, "u1", "n1") for i in range(7)]


def test_import_links(spark):
    from urllib.parse import quote

    address = "https://example.test/bookSources.json"
    share = f'yuedu://booksource/importonline?src={quote(address, safe="")}'
    texts = [f'<html><body><a href="{share}">import</a></body></html>', "see https://a.test/x and https://a.test/list.json.",
             "open ?src=" + quote(quote(address, safe=""), safe="")]
    out = W.mine_links(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"]).orderBy("i").collect()
    assert [(r.link, r.target) for r in out] == [
        (share, address), ("https://a.test/list.json", "https://a.test/list.json"), (address, address)]


def test_category_links(spark):
    html = '<div class="top-nav"><a href="/c/1">玄幻</a><a href="#x">锚</a><a href="/c/2">这个名字实在是太长了不要</a></div><a href="/list/3">其他</a>'
    assert [(r.name, r.url) for r in W.category_links(page(spark, html)).collect()] == [("玄幻", "https://example.test/c/1")]
    assert [(r.name, r.url) for r in W.category_links(page(spark, '<a href="/list/3">其他</a><a href="/z">x</a>')).collect()] == [
        ("其他", "https://example.test/list/3")]


def test_book_links(spark):
    html = ('<a href="/book/12">剑来连载中</a><a href="/1_2.html">雪中</a><a href="/33/">长生</a><a href="/class/3/">大类</a>'
            '<a href="/44/">首页</a><a href="/about">关于我们</a><a href="/55/">x</a>')
    out = W.book_links(W.extract_links(page(spark, html)), "page_id").orderBy("pos").collect()
    assert [r.title for r in out] == ["剑来", "雪中", "长生"]


def test_decode_pages(spark):
    text = '<meta charset="gbk"><p>中文</p>'
    plain = "<p>中文</p>"
    frame = spark.createDataFrame([(1, text.encode("gb18030")), (2, plain.encode("utf-8")), (3, plain.encode("gb18030")),
                                   (4, b'<meta charset="x-unknown">abc'), (5, b'<meta charset="gbk">' + "été 中".encode()),
                                   (6, b'<meta charset="gbk">a\xff\xff')], "id int, content binary")
    out = {r.id: r.html for r in S.decode_pages(frame).collect()}
    assert out == {1: text, 2: plain, 3: plain, 4: '<meta charset="x-unknown">abc', 5: '<meta charset="gbk">été 中',
                   6: '<meta charset="gbk">a\ufffd\ufffd'}


def test_unescape(spark):
    frame = spark.createDataFrame([("a &amp;amp; &#20013; &nbsp;&copy",), ("plain",), (None,)], "x string")
    assert [r[0] for r in frame.select(H.unescape(F.col("x"))).collect()] == ["a &amp; 中 \xa0©", "plain", None]


def test_select_range_and_first_n(spark):
    frame = spark.createDataFrame([("n", i) for i in range(10)], "n string, i int")
    pick = lambda *a: [r.i for r in C.select_range(frame, ["n"], [F.col("i")], *a).orderBy("i").collect()]
    assert pick(3, 5) == [2, 3, 4] and pick(None, None, 2) == [0, 1] and pick(8) == [7, 8, 9] and pick(2, 9, 2) == [1, 2]
    assert C.first_n(frame, ["n"], [F.col("i")], 4).count() == 4


def test_records_by_rule(spark):
    body = '<li class="b"><a href="/1">One</a><i>x</i></li>\n<li class="b"><a href="/2"></a></li><li class="b"><b>none</b></li>'
    pages = spark.createDataFrame(
        [(1, "https://www.a.example/x", body), (2, "https://b.example/", body), (3, "https://a.example/", None), (4, None, body)],
        "page_id int, url string, html string")
    hosts = spark.createDataFrame([("a.example", "s1"), ("a.example", "s2"), ("c.example", "s1")], "host string, source string")
    rules = [W.ListRule("s1", r"(?s)<li\b.*?</li>", {"url": 'href="([^"]*)"', "name": ">([^<]+)</a>"}), W.ListRule("s2", "<i>.*?</i>", {"tag": "<i>(.*?)</i>"})]
    out = sorted((r.page_id, r.source, r.item_no, r.field, r.value) for r in W.extract_records(pages, hosts, rules).collect())
    assert out == [(1, "s1", 1, "name", "One"), (1, "s1", 1, "url", "/1"), (1, "s1", 2, "url", "/2"), (1, "s2", 1, "tag", "x")]


def test_nested_records_by_rule(spark):
    body = "<ul><li>A<ul><li>B</li></ul>tail</li><LI class=x>C<p>z</ul><link href=l><li>never closed"
    pages = spark.createDataFrame([(1, "https://a.example/", body), (2, "https://a.example/", "</li><li>q</li></li>"), (3, "https://a.example/", ""),
                                   (4, "https://a.example/", None)], "page_id int, url string, html string")
    hosts = spark.createDataFrame([("a.example", "s")], "host string, source string")
    fields = {"own": "^<[^>]*>([^<]*)", "inner": "<ul><li>([^<]*)", "tail": "</ul>([^<]*)$"}
    out = sorted(tuple(r) for r in W.extract_records(pages, hosts, [W.ListRule("s", "(?i)^<li", fields, tag="li")]).collect())
    assert out == [(1, "s", 1, "inner", "B"), (1, "s", 1, "own", "A"), (1, "s", 1, "tail", "tail"), (1, "s", 2, "own", "B"), (1, "s", 3, "own", "C"),
                   (1, "s", 4, "own", "never closed"), (2, "s", 1, "own", "q")]


def test_element_spans_of_random_pages(spark):
    """Spans against a stack, over well-formed and broken pages."""
    import random
    rnd = random.Random(4)
    pages = ["".join(rnd.choice(["<li>", "</li>", "<li a='b'>", "text", "<ul>", "</ul>", "<LI\n>", "<link>"]) for _ in range(rnd.randrange(200))) for _ in range(60)]

    def plain(html):
        import re
        marks = [(m.start(), m[0].startswith("</")) for m in re.finditer(r"(?i)</?li[\s/>]", html)]
        open_, ends = [], {}
        for at, closes in marks:
            if not closes:
                open_.append(at)
            elif open_:
                ends[open_.pop()] = at
        return [html[at:ends.get(at, len(html))] for at, closes in marks if not closes]

    frame = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    for r in frame.select("html", H.whole_elements(F.col("html"), "li", "(?i)^<li").alias("found")).collect():
        assert r.found == plain(r.html)


def test_cover_places(spark):
    pages = [(1, '<img src="/a.png"><div class="big cover"><p><img alt=x data-original=/b.png></p></div>'), (2, '<div class="cover">none</div><IMG data-src="c.png" src="">'),
             (3, '<div class="covered"><img src="d.png"></div><meta property="og:image" content="/e.png">'), (4, "<p>no image"),
             (5, '<div class="cover">x</div><i></i><div class="cover"><img src="/second.png"></div><img class="cover" src="/own.png">')]
    frame = spark.createDataFrame([(i, "https://a.example/x/y", h) for i, h in pages], "page_id int, url string, html string")
    out = {r.page_id: r.cover_url for r in W.page_metadata(frame).collect()}
    assert out == {1: "https://a.example/b.png", 2: "https://a.example/x/c.png", 3: "https://a.example/e.png", 4: None, 5: "https://a.example/second.png"}


def test_metadata_texts_are_computed_once(spark):
    """A null for an empty text must not name the text twice: with steps around it, it would be computed many times."""
    plan = W.page_metadata(spark.createDataFrame([(1, "u", "<h1>a</h1>")], "page_id int, url string, html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<h1\\b") == 1 and plan.count("og:image") <= 2
