"""Registered queries of the pipeline operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    conversations, decontaminate, html_text, language_id, line_dedup, manifest, mixing, perplexity, simhash, substring, suffix, topk, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, twin: str | None = None):
    def add(job):
        QUERIES[name] = job
        if twin is not None:
            TWINS[name] = twin
        return job

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_decontaminate")
def decontaminated(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_simhash")
def simhash_groups(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_substring_dedup")
def substring_dedup(spark, sf_dir):
    return substring.digests(substring.cut(table(spark, sf_dir, "documents")))


@query("op3_line_dedup", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS w FROM l, unnest(range(1, len(lines) - 1)) AS t(i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM w),
g AS (SELECT doc_id, list(i) AS starts FROM r WHERE n > 1 GROUP BY doc_id),
k AS (SELECT doc_id, lines, CASE WHEN starts IS NULL THEN lines ELSE list_transform(list_filter(range(1, len(lines) + 1),
  lambda j: NOT list_has_any(starts, [j, j - 1, j - 2])), lambda j: lines[j]) END AS kept FROM l LEFT JOIN g USING (doc_id))
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_removed,
  CASE WHEN lines IS NOT NULL THEN sha256(coalesce(array_to_string(kept, chr(10)), '')) END AS kept_sha256 FROM k""")
def line_windows(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query("op10_mixing")
def mixed_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op4_language_id")
def languages(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op9_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20""")
def nearest(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op5_warc")
def archives(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op7_suffix_dedup")
def repeated_bytes(spark, sf_dir):
    return suffix.digests(suffix.cut(table(spark, sf_dir, "documents")))


@query("op8_quality_lm")
def quality(spark, sf_dir):
    return perplexity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: CRC-32 in SQL: the table of the reversed polynomial, and a macro-free fold over the characters of an ASCII string.
CRC_TABLE = """c AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda v, i:
  CASE WHEN v % 2 = 1 THEN xor(3988292384::BIGINT, v // 2) ELSE v // 2 END, n::BIGINT)) AS crc)"""


def crc(text: str) -> str:
    return (f"xor(4294967295::BIGINT, list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), "
            "lambda v, x: xor(v // 256, crc[(xor(v, x) & 255) + 1]), 4294967295::BIGINT))")


@query("op11_conversations", f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations, c),
e AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, substr(role, 1, 1) AS initial,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM e),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS last,
  count(*) OVER (PARTITION BY conv_id) AS n FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (last IS NOT NULL AND last || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']),
  (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:'])) AS t(a, b, edits, added)),
step AS (SELECT * FROM (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) AS t(letter, a, b)),
op AS (SELECT conv_id, i, a, b, least(k.cost, 99) AS cost, edit, line FROM (
  SELECT conv_id, i, a, b, 3 + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cost, 'R' AS edit,
    [CASE WHEN letter = 'u' THEN 'user:' ELSE 'assistant:' END || text] AS line FROM f, step WHERE letter IN ('u', 'a') AND fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, i, a, b, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K', [role || ':' || text] FROM f, step
    WHERE letter = initial AND fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, i, a, a, 4, 'D', []::VARCHAR[] FROM f, range(4) AS s(a)) AS k),
walk AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS s, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL SELECT w.conv_id, w.i + 1, op.b::BIGINT, min({{'cost': (w.best.cost + 3 * length(ins.edits) + op.cost)::BIGINT, 'audit': w.best.audit || ins.edits || op.edit,
    'lines': w.best.lines || ins.added || op.line}}) FROM walk w, ins, op WHERE ins.a = w.s AND op.a = ins.b AND op.conv_id IS NOT DISTINCT FROM w.conv_id AND op.i = w.i + 1
  GROUP BY w.conv_id, w.i, op.b),
ended AS (SELECT w.conv_id, min({{'cost': w.best.cost + 3 * length(ins.edits), 'audit': w.best.audit || ins.edits, 'lines': w.best.lines || ins.added}}) AS best
  FROM walk w JOIN ins ON ins.a = w.s AND ins.b IN (0, 3) JOIN (SELECT DISTINCT conv_id, n FROM f) AS z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = z.n GROUP BY w.conv_id)
SELECT i.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank, coalesce(g.duplicate, 0)::BIGINT AS duplicate,
  coalesce(g.truncated, 0)::BIGINT AS truncated, coalesce(g.illegal, 0)::BIGINT AS illegal, coalesce(x.best.cost, 0)::BIGINT AS cost, coalesce(x.best.audit, '') AS audit,
  sha256(coalesce(array_to_string(x.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended x ON x.conv_id IS NOT DISTINCT FROM i.conv_id""")
def repaired(spark, sf_dir):
    return conversations.report(table(spark, sf_dir, "conversations"))


def field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR END"


LEAF = " || ".join(field(c) for c in manifest.COLUMNS)


@query("op12_manifest", f"""
WITH RECURSIVE {CRC_TABLE},
l AS (SELECT doc_id, source, sha256({LEAF}) AS leaf, sha256({LEAF.replace("text", "changed")}) AS other,
  dense_rank() OVER (ORDER BY source NULLS FIRST) AS key FROM (SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc("doc_id::VARCHAR")} % 2 = 0
    THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents, c)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS place, count(*) OVER (PARTITION BY key) AS n FROM l),
tree AS (SELECT 0 AS level, key, place, n, leaf AS h FROM leaves
  UNION ALL SELECT level + 1, key, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM tree WHERE n > 1 GROUP BY level, key, place // 3, n),
roots AS (SELECT key, h AS subroot, max(level) OVER () + 1 AS base, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, place, n, subroot AS h FROM roots
  UNION ALL SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // 3, n),
nodes AS (SELECT 0 AS part, level, key, place, h FROM tree WHERE n > 1 UNION ALL SELECT 1, level, 0, place, h FROM top WHERE n > 1),
beside AS (SELECT a.part, a.level, a.key, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
  coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS behind
  FROM nodes a JOIN nodes b ON a.part = b.part AND a.level = b.level AND a.key = b.key AND a.place // 3 = b.place // 3 GROUP BY ALL),
way AS (SELECT leaves.key, leaves.place, list({{'before': before, 'behind': behind}} ORDER BY part, level) AS way FROM leaves JOIN roots ON roots.key = leaves.key
  JOIN beside b ON (b.part = 0 AND b.key = leaves.key AND b.place = leaves.place // (3 ** b.level)::BIGINT)
    OR (b.part = 1 AND b.place = roots.place // (3 ** b.level)::BIGINT) GROUP BY ALL),
met AS (SELECT v.*, r.subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(way.way, []) AS way FROM leaves v JOIN roots r ON r.key = v.key
  LEFT JOIN way ON way.key = v.key AND way.place = v.place),
fold AS (SELECT key, place, 0::BIGINT AS i, other AS h, way FROM met
  UNION ALL SELECT key, place, i + 1, sha256(way[i + 1].before || h || way[i + 1].behind), way FROM fold WHERE i < len(way))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(m.way, lambda x: x.before || x.behind), ''), '')) AS proof_sha256,
  f.h AS folded_root, f.h = root AS verified FROM met m JOIN fold f ON f.key = m.key AND f.place = m.place AND f.i = len(m.way)""")
def proven(spark, sf_dir):
    return manifest.report(table(spark, sf_dir, "documents"))


@query("op13_html_text")
def main_texts(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))
