"""From texts to ordered chapters, hashed segments and back to assembled chapters.

Work on whole texts stays inside the row (no shuffle, a hot source is only a matter of input splits). The ``_table``
forms take line tables whose groups may be large and use two-level running totals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.keyed import position, running_total, top_per_key
from corpusloom.functions.text import (
    CJK, elements, fold_accents, numeral_value, safe_title, slug_id, split_lines, squeeze, strip,
)

# --- fixed values ---------------------------------------------------------------------------------------------
NUMERAL = "[0-9０-９零〇○一二三四五六七八九十百千万兩两]"
CJK_ONLY_NUMERAL = "[零〇○一二三四五六七八九十百千万兩两]"
AFTER_MARK = r"(?:[\s:：、.．\-—–]+|(?=[一-鿿])|$)"
NOTICE_WORDS = ("上架", "请假", "請假", "请假条", "感言", "完本感言", "后记", "後記", "番外", "停更", "致读者", "致讀者")
SENTENCE_STARTS = "（(“\"【["
SENTENCE_ENDS = "。！？；…”\"）)】].!?"
DEFAULT_HEADING = "Mở Đầu"
FINAL_HEADING = "Chương %04d"
LONG_PARAGRAPH = 500
FLUSH_LENGTH = 200
SENTENCE_MARKS = "。！？!?"
CLOSING_MARKS = "”’\"'\\])"
SAMPLE_LIMIT = 8000
SEED_CHAPTERS_FILE = 50
SEED_CHAPTERS_CRAWL = 5
# --- end of fixed values --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class HeadingRule:
    """One row of the heading table: a pattern over the normalised line, tried in list order."""

    name: str
    pattern: str
    number_group: int = 0
    title_group: int = 0
    compact: bool = False
    no_sentence: bool = False


HEADING_RULES = (
    HeadingRule("digit", rf"^第\s*([0-9０-９]+)\s*[章节回]{AFTER_MARK}(.*)$", 1, 2),
    HeadingRule("numeral", rf"^第\s*({CJK_ONLY_NUMERAL}+)\s*[章节回]{AFTER_MARK}(.*)$", 1, 2),
    HeadingRule("latin", r"(?iu)^(?:Chương|Chapter|Chap)\s*([0-9]+)\s*[:：\-—–]?\s*(.*)$", 1, 2),
    HeadingRule("notice", "(?:" + "|".join(NOTICE_WORDS) + ")", compact=True, no_sentence=True),
    HeadingRule("volume", rf"^第{NUMERAL}+卷", compact=True),
)


def normal_heading(line: Column) -> Column:
    """Line without BOM, running number and volume prefix in front of a real chapter mark."""
    text = F.translate(F.regexp_replace(strip(line), "^﻿+", ""), "　", " ")
    text = F.regexp_replace(text, r"^\s*\d+\s*[.\-、:]\s*", "")
    text = F.regexp_replace(text, rf"^第\s*{NUMERAL}+\s*卷?[^第]*(?=第\s*{NUMERAL}+\s*[章节回])", "")
    return strip(text)


def heading_parts(line: Column) -> Column:
    """Normalised line and its form without white space; bound once so that the rules do not recompute it."""
    text = normal_heading(line)
    return F.struct(text.alias("text"), F.regexp_replace(text, r"(?U)\s+", "").alias("compact"))


def heading(parts: Column, rules=HEADING_RULES) -> Column:
    """Struct (rule, number, title, heading) of a heading line given its parts, null for running text."""
    text, compact = parts["text"], parts["compact"]
    size = F.length(compact)
    first, last = F.substring(text, 1, 1), F.substring(compact, -1, 1)
    sentence = F.contains(F.lit(SENTENCE_STARTS), first) | F.contains(F.lit(SENTENCE_ENDS), last)
    rejected = (text == "") | F.endswith(text, F.lit("：")) | text.rlike(rf"^第\s*{NUMERAL}+\s*回合")
    tests = []
    for rule in rules:
        matched = (compact if rule.compact else text).rlike(rule.pattern)
        if rule.compact:
            matched = size.between(2, 80) & matched
        if rule.no_sentence:
            matched = ~sentence & matched
        number = F.lit(0).cast("long")
        if rule.number_group:
            number = numeral_value(F.regexp_extract(text, rule.pattern, rule.number_group), False).cast("long")
        title = strip(F.regexp_extract(text, rule.pattern, rule.title_group)) if rule.title_group else text
        tests.append(F.when(matched, F.struct(
            F.lit(rule.name).alias("rule"), number.alias("number"),
            F.when(title == "", text).otherwise(title).alias("title"), text.alias("heading"))))
    return F.when(~rejected, F.coalesce(*tests))


def tag_headings(lines: DataFrame, rules=HEADING_RULES, line: str = "line") -> DataFrame:
    """Lines with rule, number, title and heading (nulls for running text)."""
    parts = lines.withColumn("_p", heading_parts(F.col(line)))
    return parts.withColumn("_h", heading(F.col("_p"), rules)).select(
        *lines.columns, "_h.rule", "_h.number", "_h.title", "_h.heading"
    )


def _heads(lines: Column, rules) -> Column:
    """Array of (at, tag) of the heading lines; every line is normalised and tested once."""
    tags = F.transform(
        F.transform(lines, heading_parts),
        lambda parts, i: F.struct((i + 1).alias("at"), heading(parts, rules).alias("tag")),
    )
    return F.filter(tags, lambda h: h["tag"].isNotNull())


def _blocks(texts: DataFrame, rules, key: str, text: str, need_heading: bool) -> DataFrame:
    """Row per block of a text: (key, seq, tag, at, first, inside), ``first`` its heading line and ``inside`` the lines below;
    block 0 stands before the first heading. Blocks are cut inside the row, so a text's lines are copied once."""
    heads = texts.select(key, split_lines(F.col(text)).alias("lines")).withColumn("heads", _heads(F.col("lines"), rules))
    none = F.array(F.lit(None).cast(heads.schema["heads"].dataType.elementType))
    def block(head: Column, seq: Column) -> Column:
        at = F.coalesce(head["at"], F.lit(0))
        stop = F.coalesce(F.get("heads", seq)["at"], F.size("lines") + 1)
        return F.struct(
            head["tag"].alias("tag"), at.alias("at"), F.get("lines", at - 1).alias("first"),
            F.slice("lines", at + 1, stop - at - 1).alias("inside"))

    blocks = F.transform(F.concat(none, F.col("heads")), block)
    return heads.select(
        key, F.posexplode(F.when(F.size("heads") > (0 if need_heading else -1), blocks)).alias("seq", "block"),
    ).select(key, "seq", "block.*")


def split_chapters(texts: DataFrame, rules=HEADING_RULES, key: str = "novel_id", text: str = "text") -> DataFrame:
    """Chapters of whole texts: (key, seq, number, title, heading, body, file). seq 0 is the intro, if any.

    The running number counts headings and ignores the printed one; a text without a heading yields no rows.
    """
    body = strip(F.array_join("inside", "\n"))
    name = F.rtrim(F.concat(F.format_string("Chapter %04d ", F.col("seq")), safe_title(F.col("tag.title"))))
    return (
        _blocks(texts, rules, key, text, True)
        .select(
            key, F.col("seq").cast("long").alias("seq"), "tag.number", "tag.title", "tag.heading",
            body.alias("body"),
            F.when(F.col("seq") == 0, "Intro.md").otherwise(F.concat(name, F.lit(".md"))).alias("file"),
        )
        .filter((F.col("seq") > 0) | (F.col("body") != ""))
    )


def split_chapters_table(lines: DataFrame, rules=HEADING_RULES, key: str = "novel_id", width: int = 4096) -> DataFrame:
    """Chapter number of every line of a line table: (key, line_no, line, seq, is_heading).

    For line tables in which one novel may be very large; chapters keep their lines as rows.
    """
    parts = lines.withColumn("_p", heading_parts(F.col("line")))
    tagged = parts.withColumn("is_heading", heading(F.col("_p"), rules).isNotNull()).drop("_p")
    value = F.col("is_heading").cast("long")
    bucket = F.floor(F.col("line_no") / F.lit(width))
    return running_total(tagged, [key], [F.col("line_no")], bucket, value, "seq")


def split_simple(texts: DataFrame, rules, key: str = "novel_id", text: str = "text") -> DataFrame:
    """Second split form: blank lines dropped, empty chapters dropped, default heading before the first one."""
    return (
        _blocks(texts, rules, key, text, False)
        .select(
            key, F.col("seq").cast("long").alias("block"),
            F.when(F.col("at") > 0, strip(F.col("first"))).otherwise(DEFAULT_HEADING).alias("heading"),
            F.filter("inside", lambda x: strip(x) != "").alias("kept"),
        )
        .filter(F.size("kept") > 0)
        .select(key, "block", "heading", strip(F.array_join("kept", "\n")).alias("body"))
    )


def chapter_id(index: Column) -> Column:
    return F.format_string("chapter_%04d", index)


def segment_manifest(chapters: DataFrame, index: str, text: str = "text", *keep: str) -> DataFrame:
    """Non-blank stripped lines as segments with ids, hashes and the segment count of the chapter.

    The id is the line number counting blank lines, so ids have gaps. Row-wise: no shuffle.
    """
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(
        (i + 1).cast("long").alias("id"), strip(x).alias("text")))
    kept = F.filter(lines, lambda s: s["text"] != "")
    return (
        chapters.select(*keep, index, F.sha2(F.col(text), 256).alias("chapter_hash"), kept.alias("_s"))
        .withColumn("segment_count", F.size("_s").cast("long"))
        .withColumn("_s", F.explode(elements(F.col("_s"))))
        .select(
            *keep, index, chapter_id(F.col(index)).alias("chapter_id"), F.col("_s.id").alias("id"),
            F.format_string("chapter_%04d:seg_%04d", F.col(index), F.col("_s.id")).alias("segment_id"),
            F.sha2(F.col("_s.text"), 256).alias("source_hash"), F.col("_s.text").alias("text"),
            "chapter_hash", "segment_count",
        )
    )


def split_long(paragraphs: DataFrame, key: list[str], text: str = "text", marks: str = SENTENCE_MARKS,
               long: int = LONG_PARAGRAPH, flush: int = FLUSH_LENGTH) -> DataFrame:
    """Paragraphs over ``long`` characters are cut after sentence ends, flushed once over ``flush`` characters.

    A tail without sentence end is a piece of its own. The fold keeps (done pieces, open piece).
    """
    whole = strip(F.col(text))
    # Every match runs to a sentence end or to the end of the text, so the scan is linear even without any end mark.
    sentence = f"[^{marks}]*+(?:[{marks}]++[{CLOSING_MARKS}]*+|\\z)"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, piece):
        # The grown piece is bound once by folding over a one-element array.
        return F.aggregate(F.array(F.concat(acc["open"], piece)), acc, lambda a, grown: F.when(
            F.length(grown) > flush,
            F.struct(F.concat(a["done"], F.array(grown)).alias("done"), F.lit("").alias("open")),
        ).otherwise(F.struct(a["done"].alias("done"), grown.alias("open"))))

    cut = paragraphs.select(*key, whole.alias("_whole")).select(*key, "_whole", F.when(
        F.length("_whole") > long, F.regexp_extract_all("_whole", F.lit(sentence), F.lit(0))).alias("_all"))
    closed = F.filter("_all", lambda x: x.rlike(f"[{marks}]"))
    tail = F.filter("_all", lambda x: ~x.rlike(f"[{marks}]"))
    folded = F.aggregate(closed, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    pieces = F.when(F.col("_all").isNull(), F.array("_whole")).otherwise(F.concat(folded, tail))
    tidy = F.filter(F.transform(pieces, strip), lambda p: p != "")
    return cut.select(*key, F.posexplode(tidy).alias("_p", "piece")).select(
        *key, (F.col("_p") + 1).cast("long").alias("piece_no"), "piece"
    )


def final_title(first_line: Column, index: Column, script: str = CJK) -> Column:
    """Heading of a published chapter: rebuilt number, old title kept unless it holds source script."""
    bare = F.regexp_replace(first_line, r"^\s*#+\s*", "")
    bare = strip(F.regexp_replace(
        strip(bare), r"(?iu)^\s*(?:Chương|Chapter)\s*[0-9０-９一二三四五六七八九十百千万萬零〇两兩]+\s*[:：.\-、]?\s*", ""))
    title = F.when(F.startswith(strip(first_line), F.lit("#")) & ~bare.rlike(script), bare).otherwise("")
    return F.rtrim(F.concat(F.format_string(FINAL_HEADING, index), F.lit(" "), title))


def assemble(segments: DataFrame, keys: list[str], index: str, order: str = "id",
             text: str = "refined_translation") -> DataFrame:
    """Published chapter text: segments in id order joined by a blank line under a rebuilt heading.

    A chapter is one output text, so its segments meet in one row; the grouping key is the chapter, not the novel.
    """
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))),
                    lambda s: s["t"]), "\n\n")
    joined = segments.groupBy(*keys, index).agg(body.alias("_body"), F.count("*").alias("segments"))
    first = F.substring_index(F.col("_body"), "\n", 1)
    headed = F.startswith(strip(first), F.lit("#"))
    title = final_title(first, F.col(index))
    rest = F.when(F.contains(F.col("_body"), F.lit("\n")),
                  F.expr("substring(_body, length(substring_index(_body, '\n', 1)) + 1)")).otherwise("")
    text_out = F.when(headed, F.concat(F.lit("# "), title, rest)).otherwise(
        F.concat(F.lit("# "), title, F.lit("\n\n"), F.col("_body")))
    return joined.select(*keys, index, title.alias("heading"), "segments", text_out.alias("final_text"))


def select_range(chapters: DataFrame, keys: list[str], order: list[Column], start: int | None = None,
                 end: int | None = None, cap: int | None = None) -> DataFrame:
    """Chapters start..end (1-based, inclusive), then at most ``cap`` of them. Adds ``chapter_no``."""
    first = max(1, start or 1)
    last = min(x for x in (end, first + cap - 1 if cap else None, 2**31 - 1) if x is not None)
    return top_per_key(chapters, keys, order, last, "chapter_no").filter(F.col("chapter_no") >= first)


def first_n(chapters: DataFrame, keys: list[str], order: list[Column], n: int = SEED_CHAPTERS_FILE) -> DataFrame:
    """First n chapters of every novel, for the seed scan."""
    return top_per_key(chapters, keys, order, n, "chapter_no")


def text_sample(chapters: DataFrame, keys: list[str], order: str, text: str = "text", limit: int = SAMPLE_LIMIT,
                width: int = 1024) -> DataFrame:
    """Opening text of every novel: chapters in order, each followed by a line break, until ``limit`` characters."""
    sized = chapters.select(*keys, order, (F.length(text) + 1).cast("long").alias("_n"),
                            F.substring(text, 1, limit).alias("_head"))
    bucket = F.floor(F.col(order) / F.lit(width))
    total = running_total(sized, keys, [F.col(order)], bucket, F.col("_n"), "_upto")
    used = total.filter(F.col("_upto") - F.col("_n") < limit)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_head").alias("t"))))
    sample = F.array_join(F.transform(parts, lambda s: F.concat(s["t"], F.lit("\n"))), "")
    return used.groupBy(*keys).agg(F.substring(sample, 1, limit).alias("sample"), F.count("*").alias("chapters"))


def normalise(docs: DataFrame, text: str, char_map: tuple[str, str], rules: list[tuple[str, str]]) -> DataFrame:
    """Character map first, then the abbreviation table, ignoring case, in list order."""
    out = F.translate(F.col(text), *char_map)
    for word, replacement in rules:
        out = F.regexp_replace(out, rf"(?iU)\b{word}\b", replacement)
    return docs.withColumn(text, out)


def numeral_mentions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Runs of digits or numerals with their value, counted per document."""
    runs = F.regexp_extract_all(
        F.col(text), F.lit(r"([0-9０-９]+|[零〇一二两兩三四五六七八九十百千万萬亿億点]+)"), F.lit(1))
    # Count inside the row first, then give each distinct run its value once.
    return (
        docs.select(key, F.explode(runs).alias("mention"))
        .groupBy(key, "mention").agg(F.count("*").alias("mentions"))
        .withColumn("value", numeral_value(F.col("mention")))
    )


def make_ids(df: DataFrame, title: str, url: str) -> DataFrame:
    return df.withColumn("novel_id", slug_id(F.col(title), F.col(url))).withColumn(
        "branch", squeeze(F.regexp_replace(fold_accents(F.col(title)), r"(?U)[^\w\s\-]", ""))
    ).withColumn("file_title", safe_title(F.col(title)))


def chapter_index(text: Column) -> Column:
    """Chapter number of a title or address: marked digits, marked numeral, else the last digit group."""
    marked = F.regexp_extract(text, r"第?\s*(\d{1,6})\s*[章节回卷集篇]", 1)
    numeral = F.regexp_extract(text, r"第?([零〇一二两兩三四五六七八九十百千万萬亿億]+)[章节回卷集篇]", 1)
    groups = F.regexp_extract_all(text, F.lit(r"(\d{1,6})"), F.lit(1))
    return F.coalesce(
        F.nullif(marked, F.lit("")).cast("long"),
        F.when(numeral != "", numeral_value(numeral).cast("long")),
        F.element_at(F.when(F.size(groups) > 0, groups), -1).cast("long"),
    )


def file_index(name: Column) -> Column:
    """Chapter number of a chapter file name."""
    found = F.regexp_extract(name, r"(?iu)(?:Chapter|Chương)\s*0*([0-9]+)", 1)
    return F.nullif(found, F.lit("")).try_cast("long")


def fill_index(toc: DataFrame, keys: list[str], order: str, index: str, file: str, width: int = 4096) -> DataFrame:
    """Stable index: the stored one, else the one in the file name, else the position in the novel."""
    placed = position(toc, keys, [F.col(order), F.col(file)], F.floor(F.col(order) / F.lit(width)), "_pos")
    return placed.withColumn(index, F.coalesce(F.col(index).cast("long"), file_index(F.col(file)), "_pos")).drop("_pos")
