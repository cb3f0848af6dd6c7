"""Headings, chapters, segments, numerals, ids."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.operators import corpus as C


def lines_of(spark, *lines):
    return spark.createDataFrame([("n", i + 1, x) for i, x in enumerate(lines)], "novel_id string, line_no long, line string")


def tags(spark, *lines):
    rows = C.tag_headings(lines_of(spark, *lines)).orderBy("line_no").collect()
    return [(r.rule, r.number, r.title) for r in rows]


def test_notice_headings_are_kept_and_sentences_are_not(spark):
    found = tags(spark, "明天就要上架了，在此求订阅", "今天请假一天", "今日请假", "完本感言",
                 "第十卷 尼特莱尔家族III复活 第十三卷 斯特拉斯堡", "这里需要说明一下剧情，并不是章节标题。")
    assert [f[0] for f in found] == ["notice"] * 4 + ["volume", None]


@pytest.mark.parametrize("line, rule, number, title", [
    ("第1章 标题", "digit", 1, "标题"),
    ("406.第403章 聚众看片", "digit", 403, "聚众看片"),
    ("第００１章 标题", "digit", 1, "标题"),
    ("第四百二十一章 标题", "numeral", 421, "标题"),
    ("第1回 标题", "digit", 1, "标题"),
    ("Chương 1: Tiêu đề", "latin", 1, "Tiêu đề"),
    ("chapter 12 - The end", "latin", 12, "The end"),
    ("第十三卷 第七十二章 雨", "numeral", 72, "雨"),
    ("第四卷 幽灵饭店 第六十一章 夜", "numeral", 61, "夜"),
    ("﻿　第8章", "digit", 8, "第8章"),
    ("第十三卷第三十八章真正的恐怖电影：", None, None, None),
    ("第一回合开始了", None, None, None),
    ("他翻到第三章看了看", None, None, None),
    ("", None, None, None),
])
def test_heading_table(spark, line, rule, number, title):
    assert tags(spark, line) == [(rule, number, title)]


def test_split_chapters(spark):
    text = "序言\n\n第一章 开始\r\n正文一\n\n正文二\n第九章 乱号\n第三章 结束\n完\n"
    docs = spark.createDataFrame([("a", text), ("b", "没有标题"), ("c", "")], "novel_id string, text string")
    rows = C.split_chapters(docs).orderBy("seq").collect()
    assert [(r.novel_id, r.seq, r.number, r.title, r.body, r.file) for r in rows] == [
        ("a", 0, None, None, "序言", "Intro.md"),
        ("a", 1, 1, "开始", "正文一\n\n正文二", "Chapter 0001 开始.md"),
        ("a", 2, 9, "乱号", "", "Chapter 0002 乱号.md"),
        ("a", 3, 3, "结束", "完", "Chapter 0003 结束.md"),
    ]
    simple = C.split_simple(docs, C.HEADING_RULES).orderBy("novel_id", "block").collect()
    assert [(r.novel_id, r.block, r.heading, r.body) for r in simple] == [
        ("a", 0, "Mở Đầu", "序言"), ("a", 1, "第一章 开始", "正文一\n正文二"), ("a", 3, "第三章 结束", "完"),
        ("b", 0, "Mở Đầu", "没有标题")]


def test_chapter_numbers_of_lines_agree_with_whole_text(spark):
    lines = [f"第{i}章 题" if i % 7 == 0 else f"行{i}" for i in range(500)]
    frame = lines_of(spark, *lines)
    got = {r.line_no: r.seq for r in C.split_chapters_table(frame, width=16).collect()}
    want, seq = {}, 0
    for i, line in enumerate(lines):
        seq += line.startswith("第")
        want[i + 1] = seq
    assert got == want


def test_segment_manifest(spark):
    text = "一\n\n 二　\n"
    rows = C.segment_manifest(spark.createDataFrame([(1, text)], "ch int, text string"), "ch").orderBy("id").collect()
    assert [(r.id, r.segment_id, r.text, r.segment_count) for r in rows] == [
        (1, "chapter_0001:seg_0001", "一", 2), (3, "chapter_0001:seg_0003", "二", 2)]
    assert rows[0].source_hash == hashlib.sha256("一".encode()).hexdigest()
    assert rows[0].chapter_hash == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("text, value", [
    ("一万三千五十", 13050), ("二点五", 2.5), ("一万零三百", 10300), ("一二三", 123), ("十五", 15), ("三亿", 3e8),
    ("一亿二千万", 1.2e8), ("12", 12), ("１２", 12), ("零", 0), ("两百", 200), ("abc", None), ("", None),
])
def test_numeral_value(spark, text, value):
    frame = spark.createDataFrame([(text,)], "x string")
    assert frame.select(T.numeral_value(F.col("x"))).first()[0] == value


def test_numeral_mentions(spark):
    rows = C.numeral_mentions(spark.createDataFrame([(1, "三人和三人，12个，二点五")], "d int, text string"), "d").collect()
    assert {(r.mention, r.mentions, r.value) for r in rows} == {("三", 2, 3.0), ("12", 1, 12.0), ("二点五", 1, 2.5)}


def split_long_plain(text):
    """The rule in plain Python: sentences gathered until over 200 characters."""
    if len(text) <= 500:
        return [text]
    out, open_, end = [], "", 0
    for match in re.finditer(r"[^。！？!?]*[。！？!?]+[”’\"'\])]*", text):
        open_ += match.group()
        end = match.end()
        if len(open_) > 200:
            out.append(open_)
            open_ = ""
    return [p for p in (x.strip() for x in [*out, open_, text[end:]]) if p]


@pytest.mark.parametrize("text", [
    "短。", "啊" * 600, ("这是一句话。" * 120), ("他说：“走！”" * 90) + "尾巴", "。" * 501, "字" * 300 + "？！”" + "文" * 300,
])
def test_split_long(spark, text):
    frame = spark.createDataFrame([(1, text)], "id int, text string")
    rows = C.split_long(frame, ["id"]).orderBy("piece_no").collect()
    assert [r.piece for r in rows] == split_long_plain(text)
    assert [r.piece_no for r in rows] == list(range(1, len(rows) + 1))


def test_final_title_and_assembly(spark):
    rows = [(1, 1, "# 第一章 雨"), (1, 2, "Mưa rơi."), (2, 1, "# Chương 2: Nắng"), (2, 2, "Trời nắng."), (3, 1, "Không tiêu đề")]
    frame = spark.createDataFrame(rows, "ch int, id int, refined_translation string")
    out = {r.ch: r.final_text for r in C.assemble(frame, [], "ch").collect()}
    assert out == {1: "# Chương 0001\n\nMưa rơi.", 2: "# Chương 0002 Nắng\n\nTrời nắng.",
                   3: "# Chương 0003\n\nKhông tiêu đề"}


@pytest.mark.parametrize("text, want", [
    ("第1072章 搜刮", 1072), ("第十二回 a", 12), ("https://x/txt/48/1070", 1070), ("no number", None), ("第 7 节", 7)])
def test_chapter_index(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(C.chapter_index(F.col("x"))).first()[0] == want


def test_file_index_and_fill(spark):
    toc = spark.createDataFrame([("n", 1, None, "Chapter 0005 a.md"), ("n", 2, None, "x.md"), ("n", 3, 9, "Chương 4.md")],
                                "novel_id string, pos int, idx int, file string")
    out = {r.file: r.idx for r in C.fill_index(toc, ["novel_id"], "pos", "idx", "file").collect()}
    assert out == {"Chapter 0005 a.md": 5, "x.md": 2, "Chương 4.md": 9}


def test_text_sample(spark):
    frame = spark.createDataFrame([("n", i, "x" * 30) for i in range(10)], "novel string, ch int, text string")
    row = C.text_sample(frame, ["novel"], "ch", limit=100, width=3).first()
    assert row.sample == (("x" * 30 + "\n") * 4)[:100] and row.chapters == 4


def test_strip_matches_every_white_space(spark):
    text = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert spark.createDataFrame([(text + "a b" + text,)], "x string").select(T.strip(F.col("x"))).first()[0] == "a b"
    assert (text + "a").strip() == "a"


@pytest.mark.parametrize("target, want", [
    ("Pette Chinar", True), ("Triệu Kỳ", False), ("김수현", True), ("佐藤", False), ("A1", False), ("Ab 12345678", False), ("", False)])
def test_foreign_like(spark, target, want):
    assert spark.createDataFrame([(target,)], "x string").select(T.is_foreign_like(F.col("x"))).first()[0] is want


def test_ids(spark):
    row = C.make_ids(spark.createDataFrame([("Đấu Phá: Thương/Khung", "http://u/1")], "t string, u string"), "t", "u").first()
    digest = hashlib.sha1(b"http://u/1").hexdigest()[:8]
    assert row.novel_id == f"u_ph_th_ng_khung_{digest}" or row.novel_id.endswith(digest)
    assert row.branch == "Dau Pha ThuongKhung" and row.file_title == "Đấu Phá ThươngKhung"


@pytest.mark.parametrize("base, href", [
    ("https://a.b/c/d?x=1#y", "e"), ("https://a.b/c/d?x=1#y", "/e"), ("https://a.b/c/d", "//h/e"), ("https://a.b/c/d?x=1#y", "?p=2"),
    ("https://a.b/c/d?x=1", "#z"), ("https://a.b", "e/f"), ("https://a.b/c/", "https://q/"), ("https://a.b/c/d/e", "../f"),
    ("https://a.b/c/d/e", "./f"), ("https://a.b/c/d/e", "../../f"), ("https://a.b/c/d", "javascript:void(0)")])
def test_join_url(spark, base, href):
    from urllib.parse import urljoin

    row = spark.createDataFrame([(base, href)], "b string, h string").select(H.join_url(F.col("b"), F.col("h"))).first()
    assert row[0] == urljoin(base, href)


@pytest.mark.parametrize("text", ["a%20b", "a%2520b", "x+y%zz", "%E4%B8%AD", "100%", "a%25252525b"])
def test_url_unquote(spark, text):
    from urllib.parse import unquote

    want = text
    for _ in range(4):
        want = unquote(want)
    assert spark.createDataFrame([(text,)], "x string").select(T.url_unquote(F.col("x"))).first()[0] == want


def test_normalise(spark):
    frame = spark.createDataFrame([("見 TMD 和 atmd",)], "text string")
    assert C.normalise(frame, "text", ("見", "见"), [("tmd", "他妈的")]).first()[0] == "见 他妈的 和 atmd"
