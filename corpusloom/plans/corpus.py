"""Corpus queries: lines, chapters, segments, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.plans.registry import query, sql_text, table
from corpusloom.sources import tables as S

# Latin rules for the driver's Latin-script documents: printed chapter numbers, and short closed lines as headings.
DEMO_RULES = (
    C.HeadingRule("latin", r"(?iu)^(?:Chapter|Chap)\s*([0-9]+)\s*[:\-]?\s*(.*)$", 1, 2),
    C.HeadingRule("short", r"^(\S+(?: \S+){0,2})\.$", 0, 1),
)
LINES = """
lines AS (
  SELECT doc_id, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM (
    SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM (
      SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS a
      FROM documents)))
"""
STRIP = sql_text(T.STRIP_CHARS)
NORMAL = f"""
normal AS (
  SELECT *, trim(regexp_replace(replace(trim(line, {STRIP}), chr(12288), ' '), '^\\s*\\d+\\s*[.\\-、:]\\s*', ''), {STRIP}) AS h
  FROM lines)
"""
TAGGED = f"""
tagged AS (
  SELECT doc_id, line_no, line,
    CASE WHEN h = '' OR h LIKE '%：' THEN NULL
         WHEN regexp_matches(h, '(?i)^(?:Chapter|Chap)\\s*([0-9]+)\\s*[:\\-]?\\s*(.*)$') THEN 'latin'
         WHEN regexp_matches(h, '^(\\S+(?: \\S+){{0,2}})\\.$') THEN 'short' END AS rule, h
  FROM normal)
"""


def document_lines(spark, sf_dir):
    return S.text_lines(table(spark, sf_dir, "documents"), "doc_id")


@query("s1_corpus_lines", f"WITH {LINES} SELECT doc_id, line_no, line FROM lines")
def corpus_lines(spark, sf_dir):
    return document_lines(spark, sf_dir)


@query("p1_tag_headings", f"""
WITH {LINES}, {NORMAL}, {TAGGED}
SELECT doc_id, line_no, rule,
  CASE rule WHEN 'latin' THEN CAST(regexp_extract(h, '(?i)^(?:Chapter|Chap)\\s*([0-9]+)', 1) AS BIGINT) ELSE 0 END AS number,
  CASE rule WHEN 'latin' THEN coalesce(nullif(trim(regexp_extract(h, '(?i)^(?:Chapter|Chap)\\s*([0-9]+)\\s*[:\\-]?\\s*(.*)$', 2), {STRIP}), ''), h)
    ELSE regexp_extract(h, '^(.*)\\.$', 1) END AS title
FROM tagged WHERE rule IS NOT NULL""")
def tag_headings(spark, sf_dir):
    tagged = C.tag_headings(document_lines(spark, sf_dir), DEMO_RULES)
    return tagged.filter(F.col("rule").isNotNull()).select("doc_id", "line_no", "rule", "number", "title")


CHAPTERS = f"""
{LINES}, {NORMAL}, {TAGGED},
counted AS (
  SELECT *, sum(CASE WHEN rule IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seq,
    count(rule) OVER (PARTITION BY doc_id) AS headings
  FROM tagged),
chapters AS (
  SELECT doc_id, CAST(seq AS BIGINT) AS seq, max(CASE WHEN rule IS NOT NULL THEN h END) AS heading,
    trim(coalesce(string_agg(CASE WHEN rule IS NULL THEN line END, chr(10) ORDER BY line_no), ''), {STRIP}) AS body
  FROM counted WHERE headings > 0 GROUP BY doc_id, seq)
"""


@query("g1_split_chapters", f"""
WITH {CHAPTERS} SELECT doc_id, seq, coalesce(heading, '') AS heading, body FROM chapters
WHERE seq > 0 OR body <> ''""")
def split_chapters(spark, sf_dir):
    chapters = C.split_chapters(table(spark, sf_dir, "documents"), DEMO_RULES, "doc_id")
    return chapters.select("doc_id", "seq", F.coalesce("heading", F.lit("")).alias("heading"), "body")


@query("g1_chapter_of_line", f"""
WITH {LINES}, {NORMAL}, {TAGGED}
SELECT doc_id, line_no, rule IS NOT NULL AS is_heading,
  CAST(sum(CASE WHEN rule IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS seq
FROM tagged""")
def chapter_of_line(spark, sf_dir):
    numbered = C.split_chapters_table(document_lines(spark, sf_dir), DEMO_RULES, "doc_id", 64)
    return numbered.select("doc_id", "line_no", "is_heading", "seq")


@query("g1_split_simple", f"""
WITH {LINES}, {NORMAL}, {TAGGED},
counted AS (
  SELECT *, sum(CASE WHEN rule IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM tagged)
SELECT doc_id, CAST(block AS BIGINT) AS block,
  coalesce(max(CASE WHEN rule IS NOT NULL THEN trim(line, {STRIP}) END), 'Mở Đầu') AS heading,
  trim(string_agg(CASE WHEN rule IS NULL AND trim(line, {STRIP}) <> '' THEN line END, chr(10) ORDER BY line_no), {STRIP}) AS body
FROM counted GROUP BY doc_id, block
HAVING count(CASE WHEN rule IS NULL AND trim(line, {STRIP}) <> '' THEN 1 END) > 0""")
def split_simple(spark, sf_dir):
    return C.split_simple(table(spark, sf_dir, "documents"), DEMO_RULES, "doc_id")


SEGMENTS = f"""
seg_lines AS (
  SELECT doc_id, text AS whole, unnest(range(1, len(a) + 1)) AS id, unnest(a) AS raw
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents)),
segments AS (
  SELECT doc_id, id, trim(raw, {STRIP}) AS text, whole FROM seg_lines WHERE trim(raw, {STRIP}) <> '')
"""


@query("c1_segment_manifest", f"""
WITH {SEGMENTS}
SELECT doc_id, printf('chapter_%04d', doc_id) AS chapter_id, id,
  printf('chapter_%04d:seg_%04d', doc_id, id) AS segment_id, sha256(text) AS source_hash,
  sha256(whole) AS chapter_hash, count(*) OVER (PARTITION BY doc_id) AS segment_count, text
FROM segments""")
def segment_manifest(spark, sf_dir):
    return C.segment_manifest(table(spark, sf_dir, "documents"), "doc_id")


LONG_SENTENCE = r"[^.!?]*[.!?]+[”’\"'\])]*"


@query("c2_split_long", f"""
WITH RECURSIVE {SEGMENTS},
parts AS (
  SELECT doc_id, id, text, CASE WHEN length(text) <= 500 THEN [text]
    ELSE regexp_extract_all(text, '{LONG_SENTENCE.replace("'", "''")}') END AS sents,
    CASE WHEN length(text) <= 500 THEN '' ELSE trim(regexp_extract(text, '([^.!?]*)$', 1), {STRIP}) END AS tail
  FROM segments),
tails AS (
  SELECT doc_id, id, sents, CASE WHEN length(text) <= 500 THEN '' ELSE
    trim(substr(text, length(array_to_string(sents, '')) + 1), {STRIP}) END AS tail, length(text) <= 500 AS short
  FROM parts),
fold AS (
  SELECT doc_id, id, sents, tail, short, 1 AS i, sents[1] AS open FROM tails WHERE len(sents) > 0
  UNION ALL
  SELECT doc_id, id, sents, tail, short, i + 1,
    CASE WHEN length(open) > 200 THEN sents[i + 1] ELSE open || sents[i + 1] END
  FROM fold WHERE i < len(sents)),
pieces AS (
  SELECT doc_id, id, i, trim(open, {STRIP}) AS piece FROM fold WHERE length(open) > 200 OR i = len(sents)
  UNION ALL SELECT doc_id, id, 1000000, tail FROM tails WHERE tail <> '')
SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id, id ORDER BY i) AS piece_no, piece FROM pieces WHERE piece <> ''
""")
def split_long(spark, sf_dir):
    segments = C.segment_manifest(table(spark, sf_dir, "documents"), "doc_id")
    return C.split_long(segments, ["doc_id", "id"], "text", ".!?")


def _word(column: str, word: str, replacement: str) -> str:
    """Whole-word replacement in a dialect without look-around: twice, for words that share a separator."""
    edge = "[^\\p{L}\\p{N}\\p{M}_]"
    for _ in range(2):
        column = f"regexp_replace({column}, '(^|{edge}){word}({edge}|$)', '\\1{replacement}\\2', 'gi')"
    return column


C9_TEXT = _word(_word("translate(text, 'éèêäöü', 'eeeaou')", "und", "and"), "der", "the")


@query("c9_normalise", f"SELECT doc_id, {C9_TEXT} AS text FROM documents")
def normalise(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.normalise(docs, "text", ("éèêäöü", "eeeaou"), [("und", "and"), ("der", "the")])


@query("c10_numeral_mentions", """
SELECT page_id, mention, count(*) AS mentions, CAST(mention AS DOUBLE) AS value FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '[0-9]+')) AS mention FROM pages) GROUP BY page_id, mention""")
def numeral_mentions(spark, sf_dir):
    return C.numeral_mentions(table(spark, sf_dir, "pages"), "page_id", "html")


@query("g6_text_sample", """
WITH sized AS (
  SELECT source, doc_id, text, sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents)
SELECT source, substr(string_agg(text || chr(10), '' ORDER BY doc_id), 1, 8000) AS sample, count(*) AS chapters
FROM sized WHERE upto - length(text) - 1 < 8000 GROUP BY source""")
def text_sample(spark, sf_dir):
    return C.text_sample(table(spark, sf_dir, "documents"), ["source"], "doc_id")


ORDER_LINE = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"


@query("p3_select_range", f"""
SELECT l_orderkey, l_partkey, l_suppkey, chapter_no FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER_LINE}) AS chapter_no FROM lineitem)
WHERE chapter_no BETWEEN 2 AND 4""")
def select_range(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    order = [F.col(c.strip()) for c in ORDER_LINE.split(",")]
    return C.select_range(items, ["l_orderkey"], order, 2, 6, 3).select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("chapter_no").cast("long").alias("chapter_no"))


@query("g7_first_n", """
SELECT o_custkey, o_orderkey, chapter_no FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS chapter_no FROM orders)
WHERE chapter_no <= 5""")
def first_n(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return C.first_n(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], C.SEED_CHAPTERS_CRAWL).select(
        "o_custkey", "o_orderkey", F.col("chapter_no").cast("long").alias("chapter_no"))


@query("g12_fill_index", """
SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey * 10
  WHEN o_orderstatus = 'O' THEN o_orderkey
  ELSE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS chapter_index
FROM orders""")
def fill_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    toc = orders.select(
        "o_custkey", "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") * 10).alias("chapter_index"),
        F.when(F.col("o_orderstatus") == "O", F.format_string("Chapter %04d x.md", "o_orderkey")).otherwise("x.md")
        .alias("file"))
    return C.fill_index(toc, ["o_custkey"], "o_orderkey", "chapter_index", "file").drop("file")


@query("c11_make_ids", """
WITH titled AS (SELECT page_id, url, regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1) AS title FROM pages),
based AS (
  SELECT *, lower(trim(regexp_replace(trim(title), '[^A-Za-z0-9_\\-]+', '_', 'g'), '_')) AS b FROM titled)
SELECT page_id, substr(CASE WHEN b = '' THEN 'novel' ELSE b END, 1, 48) || '_' || substr(sha1(url), 1, 8) AS novel_id,
  trim(regexp_replace(regexp_replace(strip_accents(title), '[^\\p{L}\\p{N}\\p{M}_\\s\\-]', '', 'g'), '\\s+', ' ', 'g')) AS branch,
  substr(trim(regexp_replace(regexp_replace(title, '[\\\\/:*?"<>|]', '', 'g'), '\\s+', ' ', 'g')), 1, 120) AS file_title
FROM based""")
def make_ids(spark, sf_dir):
    from corpusloom.functions.html import element

    pages = table(spark, sf_dir, "pages").select("page_id", "url", element(F.col("html"), "title").alias("title"))
    return C.make_ids(pages, "title", "url").drop("url", "title")


@query("c12_assemble", """
SELECT conv_id, 'Chương ' || printf('%04d', conv_id) AS heading, count(*) AS segments,
  '# Chương ' || printf('%04d', conv_id) || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS final_text
FROM conversations GROUP BY conv_id""")
def assemble(spark, sf_dir):
    return C.assemble(table(spark, sf_dir, "conversations"), [], "conv_id", "turn", "text")


@query("flagship_corpus_catalog", f"""
WITH {CHAPTERS}
SELECT doc_id, count(*) AS chapters, min(seq) AS first_seq, CAST(sum(length(body)) AS BIGINT) AS body_chars,
  arg_min(heading, seq) AS first_heading
FROM chapters WHERE seq > 0 GROUP BY doc_id""")
def corpus_catalog(spark, sf_dir):
    chapters = C.split_chapters(table(spark, sf_dir, "documents"), DEMO_RULES, "doc_id").filter(F.col("seq") > 0)
    return chapters.groupBy("doc_id").agg(
        F.count("*").alias("chapters"), F.min("seq").alias("first_seq"),
        F.sum(F.length("body")).alias("body_chars"), F.min_by("heading", "seq").alias("first_heading"))
