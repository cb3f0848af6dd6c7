"""Lexicon, lock and context queries over ``documents``, ``benchmark``, ``part``, ``supplier`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import names as N
from corpusloom.functions import text as T
from corpusloom.operators import kb as K
from corpusloom.operators import lexicon as L
from corpusloom.operators import locks as O
from corpusloom.operators import quality as Q
from corpusloom.plans.corpus import LINES
from corpusloom.plans.registry import query, sql_text, table

STRIP = sql_text(T.STRIP_CHARS)
TOKENS = r"""
tokens AS (
  SELECT doc_id, source, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS token
  FROM (SELECT doc_id, source, regexp_split_to_array(trim(text, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[\s\x0b]+') AS a FROM documents))
"""
# Lexicon: every distinct token and every neighbouring pair of tokens of the term list.
LEX = r"""
terms AS (
  SELECT item_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS t1, unnest(a[2:] || ['']) AS t2
  FROM (SELECT item_id, regexp_split_to_array(trim(text, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[\s\x0b]+') AS a FROM benchmark)),
lex AS (
  SELECT t1 AS key, 1 AS n, min(item_id) AS item FROM terms GROUP BY 1
  UNION ALL SELECT t1 || ' ' || t2, 2, min(item_id) FROM terms WHERE t2 <> '' GROUP BY 1)
"""


def lexicon(spark, sf_dir):
    tokens = table(spark, sf_dir, "benchmark").select("item_id", L.units(F.col("text"), "token").alias("a"))
    one = tokens.select("item_id", F.explode("a").alias("key"))
    two = tokens.select("item_id", F.explode(F.transform("a", lambda t, i: F.when(
        i + 1 < F.size("a"), F.concat_ws(" ", t, F.get("a", i + 1))))).alias("key")).filter(F.col("key").isNotNull())
    return one.unionByName(two).groupBy("key").agg(F.min("item_id").alias("item")).withColumn(
        "target", F.concat(F.lit("T:"), "key")).withColumn(
        "type", F.when(F.col("item") % 3 == 0, "name").when(F.col("item") % 3 == 1, "location").otherwise("term"))


def spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return L.match_spans(docs, lexicon(spark, sf_dir), ["doc_id"], unit="token", longest=2)


SPANS = f"""
{TOKENS}, {LEX},
pairs AS (SELECT doc_id, pos, token AS key, 1 AS n FROM tokens UNION ALL
  SELECT a.doc_id, a.pos, a.token || ' ' || b.token, 2 FROM tokens a JOIN tokens b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1),
spans AS (
  SELECT doc_id, pos, p.n AS n_units, p.key, item, 'T:' || p.key AS target,
    CASE item % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'location' ELSE 'term' END AS type
  FROM pairs p JOIN lex l ON l.key = p.key AND l.n = p.n)
"""


@query("j6_match_spans", f"WITH {SPANS} SELECT doc_id, pos, n_units, key, item FROM spans")
def match_spans(spark, sf_dir):
    return spans(spark, sf_dir).select("doc_id", "pos", "n_units", "key", "item")


@query("c7_mentions", f"""
WITH {SPANS}
SELECT doc_id, pos, type, CASE WHEN type = 'name' THEN substr(key, 1, 1) || regexp_replace(substr(key, 2), '[.,]+$', '') ELSE key END AS raw
FROM spans WHERE type IN ('name', 'location')
  AND length(CASE WHEN type = 'name' THEN substr(key, 1, 1) || regexp_replace(substr(key, 2), '[.,]+$', '') ELSE key END) > 1""")
def mentions(spark, sf_dir):
    return L.mentions(spans(spark, sf_dir), suffixes=".,").select("doc_id", "pos", "type", "raw")


@query("a2_entity_counts", f"""
WITH {SPANS},
m AS (
  SELECT doc_id, pos, type, target, CASE WHEN type = 'name' THEN substr(key, 1, 1) || regexp_replace(substr(key, 2), '[.,]+$', '') ELSE key END AS raw
  FROM spans WHERE type IN ('name', 'location'))
SELECT raw, CASE type WHEN 'name' THEN 'characters' ELSE 'glossary' END AS class, count(*) AS frequency,
  arg_min(target, lpad(CAST(doc_id AS VARCHAR), 9, '0') || lpad(CAST(pos AS VARCHAR), 9, '0') || target) AS target
FROM m WHERE length(raw) > 1 GROUP BY 1, 2""")
def entity_counts(spark, sf_dir):
    found = L.mentions(spans(spark, sf_dir), suffixes=".,")
    return L.entity_counts(found, F.struct("doc_id", "pos", "target"))


@query("a5_coverage", f"""
WITH {TOKENS}, {LEX}
SELECT source, doc_id, count(*) AS total_units, count(l.key) AS matched_units, round(count(l.key) / count(*), 4) AS coverage
FROM tokens t LEFT JOIN lex l ON l.key = t.token AND l.n = 1 GROUP BY ROLLUP (source, doc_id)""")
def coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(L.units(F.col("text"), "token")).alias("key"))
    words = lexicon(spark, sf_dir).select("key").filter(~F.contains("key", F.lit(" "))).withColumn("hit", F.lit(True))
    joined = docs.join(words, "key", "left")
    return L.coverage(joined, ["source", "doc_id"], F.coalesce("hit", F.lit(False)), F.lit(True), F.lit(1))


# The cover: costs in millionths from the end of a line; a place where no pair of tokens starts does not need the next one.
COVER = f"""
{LINES}, {LEX},
tokens AS (
  SELECT source, doc_id, line_no - 1 AS line_no, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS token, unnest(a[2:] || [NULL]) AS next FROM (
    SELECT source, doc_id, line_no, regexp_split_to_array(body, '[\\s\\x0b]+') AS a FROM (
      SELECT source, doc_id, line_no, trim(line, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS body FROM lines JOIN documents USING (doc_id))
    WHERE body <> '')),
priced AS (
  SELECT t.*, a.item IS NOT NULL AS known, CASE WHEN a.item IS NULL THEN 60050000 ELSE 1052000 - 300000 * (a.item % 2) END AS one,
    2052000 - 300000 * (b.item % 2) AS two
  FROM tokens t LEFT JOIN lex a ON a.n = 1 AND a.key = token LEFT JOIN lex b ON b.n = 2 AND b.key = token || ' ' || next),
chosen AS (
  SELECT doc_id, line_no, pos, 1 AS n, one AS cost, 0 AS beyond FROM priced WHERE two IS NULL
  UNION ALL
  SELECT p.doc_id, p.line_no, p.pos, CASE WHEN p.two + c.beyond <= p.one + c.cost THEN 2 ELSE 1 END,
    least(p.two + c.beyond, p.one + c.cost), c.cost
  FROM chosen c JOIN priced p ON p.doc_id = c.doc_id AND p.line_no = c.line_no AND p.pos = c.pos - 1 AND p.two IS NOT NULL),
marked AS (
  SELECT p.*, c.n, pos - 1 - coalesce(max(CASE WHEN c.n = 1 THEN pos END) OVER (
    PARTITION BY doc_id, line_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pairs
  FROM priced p JOIN chosen c USING (doc_id, line_no, pos)),
cover AS (
  SELECT source, doc_id, line_no, pos, n AS n_units, CASE n WHEN 2 THEN token || ' ' || next ELSE token END AS src,
    CASE WHEN n = 2 OR known THEN 'dict' ELSE 'unknown' END AS kind FROM marked WHERE pairs % 2 = 0)
"""


def gloss_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    lines = docs.select("source", "doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("line_no", "text"))
    keys = ["source", "doc_id", "line_no"]
    entries = lexicon(spark, sf_dir).select("key", "target", (F.col("item") % 2).cast("int").alias("tier"), F.lit(1).alias("priority"))
    return L.gloss_rows(lines, entries, keys, unit="token", script=".", longest=2), keys


def gloss_tokens(spark, sf_dir):
    rows, keys = gloss_rows(spark, sf_dir)
    return rows.select(*keys, F.inline("tokens"))


@query("c3_gloss", f"""WITH RECURSIVE {COVER}
SELECT source, doc_id, line_no, pos, n_units, src, CASE kind WHEN 'dict' THEN 'T:' || src ELSE src END AS tgt, kind FROM cover""")
def gloss(spark, sf_dir):
    return gloss_tokens(spark, sf_dir)


@query("c3_draft_text", f"""WITH RECURSIVE {COVER}
SELECT source, doc_id, line_no, string_agg(CASE kind WHEN 'dict' THEN 'T:' || src ELSE src END, ' ' ORDER BY pos) AS draft
FROM cover GROUP BY ALL""")
def draft_text(spark, sf_dir):
    rows, keys = gloss_rows(spark, sf_dir)
    return rows.select(*keys, L.draft(F.col("tokens")).alias("draft"))


@query("a5_cover_coverage", f"""WITH RECURSIVE {COVER}
SELECT source, doc_id, CAST(sum(n_units) AS BIGINT) AS total_units, CAST(sum(CASE kind WHEN 'dict' THEN n_units ELSE 0 END) AS BIGINT) AS matched_units,
  round(sum(CASE kind WHEN 'dict' THEN n_units ELSE 0 END) / sum(n_units), 4) AS coverage FROM cover GROUP BY ROLLUP (source, doc_id)""")
def cover_coverage(spark, sf_dir):
    return L.coverage(gloss_tokens(spark, sf_dir), ["source", "doc_id"], F.col("kind") == "dict", F.col("kind") != "pass", F.col("n_units"))


@query("a10_promote_candidates", f"""
WITH {SPANS},
m AS (SELECT key AS raw, CASE WHEN doc_id % 5 = 0 THEN 'x' || target ELSE target END AS target, type FROM spans WHERE type <> 'term'),
entries AS (SELECT key, CASE WHEN item % 4 = 0 THEN '??' ELSE 'T:' || key END AS target,
  CASE item % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'location' ELSE 'term' END AS type FROM lex WHERE item % 2 = 0),
scored AS (SELECT raw, target, type, count(*) AS score FROM m GROUP BY ALL),
kept AS (
  SELECT s.*, e.target AS known FROM scored s LEFT JOIN entries e ON e.key = s.raw AND e.type = s.type
  WHERE e.target IS NULL OR (e.target <> s.target AND NOT (regexp_matches(e.target, '[A-Za-z]') AND NOT regexp_matches(s.target, '[A-Za-z]')))),
best AS (SELECT *, row_number() OVER (PARTITION BY raw, type ORDER BY score DESC, target DESC) AS n FROM kept)
SELECT raw, target, type, CAST(score AS DOUBLE) AS score,
  CASE WHEN score < 3 THEN 'pending' WHEN known IS NOT NULL OR n > 1 THEN 'rejected' ELSE 'approved' END AS status FROM best""")
def promote_candidates(spark, sf_dir):
    found = spans(spark, sf_dir).filter("type <> 'term'").select(
        F.col("key").alias("raw"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), "target")).otherwise(F.col("target")).alias("target"), "type")
    entries = lexicon(spark, sf_dir).filter("item % 2 = 0").select(
        "key", F.when(F.col("item") % 4 == 0, "??").otherwise(F.col("target")).alias("target"), "type")
    return K.promote_candidates(found, entries)


LAYERED = """
layers AS (
  SELECT CASE p_size % 4 WHEN 0 THEN 'project' WHEN 1 THEN 'universe' WHEN 2 THEN 'style' ELSE 'global' END AS layer,
    CASE WHEN p_size % 4 IN (0, 1) THEN p_brand END AS scope, p_name AS key, p_type || ' ' || p_partkey AS target,
    CAST(p_size % 3 AS INT) AS tier, p_size AS priority, p_partkey AS id FROM part),
active AS (SELECT DISTINCT 'ctx ' || p_brand AS context, p_brand AS scope FROM part
  UNION SELECT DISTINCT 'ctx ' || p_brand, 'Brand#1' FROM part),
ranked AS (
  SELECT a.context, l.*, CASE layer WHEN 'project' THEN 0 WHEN 'universe' THEN 1 WHEN 'style' THEN 2 ELSE 3 END AS r
  FROM layers l JOIN active a ON a.scope = l.scope WHERE layer IN ('project', 'universe')
  UNION ALL SELECT NULL, l.*, CASE layer WHEN 'style' THEN 2 ELSE 3 END FROM layers l WHERE layer IN ('style', 'global')),
resolved AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY context, key ORDER BY r, tier DESC, priority, id) AS n FROM ranked) WHERE n = 1)
"""


def layered(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    quarter = F.col("p_size") % 4
    layers = part.select(
        F.when(quarter == 0, "project").when(quarter == 1, "universe").when(quarter == 2, "style").otherwise("global").alias("layer"),
        F.when(quarter.isin(0, 1), F.col("p_brand")).alias("scope"), F.col("p_name").alias("key"),
        F.concat_ws(" ", "p_type", "p_partkey").alias("target"), (F.col("p_size") % 3).cast("int").alias("tier"),
        F.col("p_size").alias("priority"), F.col("p_partkey").alias("id"))
    contexts = part.select(F.concat(F.lit("ctx "), "p_brand").alias("context"), F.col("p_brand").alias("scope"))
    active = contexts.unionByName(contexts.withColumn("scope", F.lit("Brand#1"))).distinct()
    return layers, active


@query("g3_resolve_lexicon", f"WITH {LAYERED} SELECT context, key, layer, target, tier, priority FROM resolved")
def resolve_lexicon(spark, sf_dir):
    return L.resolve_lexicon(*layered(spark, sf_dir))


@query("g3_lookup_terms", f"""
WITH {LAYERED},
wanted AS (SELECT DISTINCT 'ctx ' || p_brand AS context, p_name AS key FROM part)
SELECT w.context, w.key, coalesce(o.target, c.target) AS target, coalesce(o.layer, c.layer) AS layer FROM wanted w
LEFT JOIN resolved o ON o.context = w.context AND o.key = w.key
LEFT JOIN resolved c ON c.context IS NULL AND c.key = w.key""")
def lookup_terms(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select(
        F.concat(F.lit("ctx "), "p_brand").alias("context"), F.col("p_name").alias("key")).distinct()
    return L.lookup_terms(wanted, L.resolve_lexicon(*layered(spark, sf_dir)))


@query("p7_clean_target", f"""
WITH cut AS (SELECT p_partkey, trim(split_part(trim(split_part(split_part(p_size || '. ' || p_type || CASE WHEN p_partkey % 3 = 0 THEN ' (' || p_brand || ')' ELSE '; ' END || p_name || ' / ' || p_brand || '=x', '=', 1), '/', 1), {STRIP}), ' (', 1), {STRIP}) AS t FROM part)
SELECT p_partkey, trim(split_part(trim(regexp_replace(t, '^\\d+\\.\\s*', ''), {STRIP}), ';', 1), {STRIP}) AS target FROM cut""")
def clean_target(spark, sf_dir):
    between = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" ("), "p_brand", F.lit(")"))).otherwise("; ")
    raw = F.concat("p_size", F.lit(". "), "p_type", between, "p_name", F.lit(" / "), "p_brand", F.lit("=x"))
    return table(spark, sf_dir, "part").select("p_partkey", L.clean_target(raw).alias("target"))


@query("j16_token_rules", f"""
WITH {TOKENS},
rules AS (SELECT token AS pattern, 'r' || min(doc_id) AS replacement FROM (SELECT token, doc_id FROM tokens WHERE source = 'src1') GROUP BY 1)
SELECT doc_id, pos, token, coalesce(replacement, token) AS target FROM tokens LEFT JOIN rules ON pattern = token""")
def token_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select("doc_id", "source", F.posexplode(L.units(F.col("text"), "token")).alias("_p", "token")).select(
        "doc_id", "source", (F.col("_p") + 1).cast("long").alias("pos"), "token")
    rules = tokens.filter("source = 'src1'").groupBy(F.col("token").alias("pattern"), F.col("doc_id").alias("id")).count().select(
        "pattern", F.concat(F.lit("r"), "id").alias("replacement"), F.lit("replace").alias("rule_type"),
        F.lit(1).alias("priority"), "id", F.lit(True).alias("enabled"))
    return L.apply_token_rules(tokens.drop("source"), rules, many=True)


@query("j17_map_chars", """
WITH m AS (SELECT string_agg(ch, '' ORDER BY ch) AS a, string_agg(chr(97 + CAST(n % 26 AS INT)), '' ORDER BY ch) AS b FROM (
  SELECT ch, n_nationkey AS n FROM (SELECT substr('éèêçäöüñíóáúßàâîôû', n_nationkey + 1, 1) AS ch, n_nationkey FROM nation) WHERE ch <> ''))
SELECT doc_id, translate(text, a, b) AS text FROM documents, m""")
def map_chars(spark, sf_dir):
    # The character table comes from ``nation``: one accented letter per row.
    letters = F.lit("éèêçäöüñíóáúßàâîôû")
    charmap = table(spark, sf_dir, "nation").select(
        letters.substr(F.col("n_nationkey") + 1, F.lit(1)).alias("trad"),
        F.char(F.lit(97) + F.col("n_nationkey") % 26).alias("simp")).filter("trad <> ''")
    return L.map_chars(table(spark, sf_dir, "documents").select("doc_id", "text"), charmap)


@query("g9_merge_runs", """
WITH p AS (SELECT DISTINCT l_suppkey, l_orderkey AS pos FROM lineitem),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY l_suppkey ORDER BY pos) AS island FROM p)
SELECT l_suppkey, min(pos) AS run_start, max(pos) AS run_end, count(*) AS n FROM i GROUP BY l_suppkey, island""")
def merge_runs(spark, sf_dir):
    return L.merge_runs(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey")


LOCKS = r"""
locks AS (
  SELECT raw, CASE WHEN item % 2 = 0 THEN 'characters' ELSE 'glossary' END AS "group", 'Target' || item AS target FROM (
    SELECT raw, min(item_id) AS item FROM (
      SELECT item_id, unnest(regexp_split_to_array(trim(text, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[\s\x0b]+')) AS raw FROM benchmark)
    WHERE raw <> '' GROUP BY 1))
"""


def locks(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(L.units(F.col("text"), "token")).alias("raw"), "item_id")
    return words.groupBy("raw").agg(F.min("item_id").alias("item")).select(
        "raw", F.when(F.col("item") % 2 == 0, "characters").otherwise("glossary").alias("group"),
        F.concat(F.lit("Target"), "item").alias("target"))


@query("j7_present_terms", f"""
WITH {LOCKS} SELECT doc_id, raw AS term FROM documents JOIN locks ON contains(text, raw)""")
def present_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return L.present_terms(docs, locks(spark, sf_dir).select(F.col("raw").alias("term")), ["doc_id"])


@query("j8_active_universes", f"""
WITH {LOCKS} SELECT DISTINCT doc_id, 'u' || length(raw) AS universe FROM documents JOIN locks ON contains(text, raw)""")
def active_universes(spark, sf_dir):
    markers = locks(spark, sf_dir).select(F.col("raw").alias("marker"), F.concat(F.lit("u"), F.length("raw")).alias("universe"))
    return L.active_universes(table(spark, sf_dir, "documents"), markers, ["doc_id"])


@query("c5_lock_pack", f"""
WITH {LOCKS},
present AS (SELECT doc_id, "group", raw, target FROM documents JOIN locks ON contains(text, raw))
SELECT doc_id, "group", string_agg(raw || '=' || target, ';' ORDER BY raw) AS entries FROM present GROUP BY 1, 2""")
def lock_pack(spark, sf_dir):
    packs = O.lock_pack(O.present_locks(table(spark, sf_dir, "documents"), locks(spark, sf_dir), ["doc_id"]), ["doc_id"])
    # Read the packs back, so that the JSON itself is what is compared.
    outer = packs.select("doc_id", F.explode(F.from_json("pack", "map<string,string>")).alias("group", "inner"))
    return outer.select("doc_id", "group", F.explode(F.from_json("inner", "map<string,string>")).alias("raw", "target")).groupBy(
        "doc_id", "group").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("raw", "target"))), lambda e: F.concat_ws("=", e["raw"], e["target"])), ";").alias("entries"))


@query("c4_apply_locks", f"""
WITH {LOCKS},
pairs AS (
  SELECT doc_id, list(raw || chr(1) || target ORDER BY length(raw) DESC, raw) AS p
  FROM documents JOIN locks ON contains(text, raw) GROUP BY 1)
SELECT d.doc_id, list_reduce([text] || coalesce(p, []), lambda acc, x: replace(acc, split_part(x, chr(1), 1), split_part(x, chr(1), 2))) AS text
FROM documents d LEFT JOIN pairs USING (doc_id)""")
def apply_locks(spark, sf_dir):
    docs, all_locks = table(spark, sf_dir, "documents").select("doc_id", "text"), locks(spark, sf_dir)
    none = spark.createDataFrame([], "raw string, alias string")
    return O.apply_locks(docs, O.present_locks(docs, all_locks, ["doc_id"], packed=True), none, ["doc_id"], {})


@query("g4_merge_locks", """
WITH rows AS (
  SELECT 'nation' || c_nationkey AS grp, CAST(c_custkey % 50 AS VARCHAR) AS raw,
    CASE WHEN c_acctbal < 3000 THEN '123' ELSE c_name || ' (x)' END AS target, 1 AS source_rank, c_custkey AS seq FROM customer
  UNION ALL SELECT 'nation' || s_nationkey, CAST(s_suppkey % 50 AS VARCHAR), CASE WHEN s_acctbal < 6000 THEN '456' ELSE s_name END, 0, s_suppkey FROM supplier),
ranked AS (
  SELECT grp, raw, split_part(target, ' (', 1) AS target, row_number() OVER (PARTITION BY grp, raw
    ORDER BY NOT regexp_matches(split_part(target, ' (', 1), '[A-Za-z]'), source_rank, seq) AS n FROM rows)
SELECT grp, raw, target FROM ranked WHERE n = 1""")
def merge_locks(spark, sf_dir):
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    rows = customer.select(
        F.concat(F.lit("nation"), "c_nationkey").alias("grp"), (F.col("c_custkey") % 50).cast("string").alias("raw"),
        F.when(F.col("c_acctbal") < 3000, "123").otherwise(F.concat("c_name", F.lit(" (x)"))).alias("target"),
        F.lit(1).alias("source_rank"), F.col("c_custkey").alias("seq"),
    ).unionByName(supplier.select(
        F.concat(F.lit("nation"), "s_nationkey").alias("grp"), (F.col("s_suppkey") % 50).cast("string").alias("raw"),
        F.when(F.col("s_acctbal") < 6000, "456").otherwise(F.col("s_name")).alias("target"),
        F.lit(0).alias("source_rank"), F.col("s_suppkey").alias("seq")))
    return O.merge_locks(rows, ["grp"])


@query("k5_longest_first", f"""
WITH {LOCKS} SELECT doc_id, string_agg(raw, ';' ORDER BY length(raw) DESC, raw) AS ordered
FROM documents JOIN locks ON contains(text, raw) GROUP BY 1""")
def longest_first(spark, sf_dir):
    present = O.present_locks(table(spark, sf_dir, "documents"), locks(spark, sf_dir), ["doc_id"])
    pairs = F.collect_list(F.struct(F.col("raw").alias("src"), F.col("target").alias("dst")))
    return present.groupBy("doc_id").agg(
        F.array_join(F.transform(O.longest_first(pairs), lambda p: p["src"]), ";").alias("ordered"))


@query("j19_edge_context", """
WITH edges AS (SELECT DISTINCT n_name AS source, r_name AS target, 'in' AS relationship FROM nation JOIN region ON n_regionkey = r_regionkey),
present AS (SELECT DISTINCT o_orderkey, n_name AS raw FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT DISTINCT o_orderkey, source || ' --(' || relationship || ')--> ' || target AS edge FROM edges JOIN present ON raw = source OR raw = target""")
def edge_context(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    edges = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("in").alias("relationship"))
    present = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.col("n_name").alias("raw"))
    return O.edge_context(edges, present, ["o_orderkey"])


@query("j9_classify_candidates", """
WITH kb AS (SELECT p_name AS key, p_type || ' ' || p_partkey AS target, p_brand AS type, CAST(p_size % 3 AS INT) AS tier,
    CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS scope, p_size AS priority FROM part WHERE p_size > 5),
top AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier DESC, priority, target) AS r FROM kb),
best AS (SELECT key, target, type, row_number() OVER (PARTITION BY key ORDER BY
    CASE WHEN scope IS NULL OR (tier = 2 AND scope = 'Brand#3') OR (tier = 1 AND scope IN ('Brand#4', 'Brand#5')) THEN 0 ELSE 1 END, r) AS n
  FROM top)
SELECT c.candidate, CASE WHEN b.key IS NULL THEN 'unknown' ELSE 'known' END AS status, b.target, b.type
FROM (SELECT DISTINCT p_name AS candidate FROM part UNION SELECT c_name FROM customer) c LEFT JOIN best b ON b.key = c.candidate AND b.n = 1""")
def classify_candidates(spark, sf_dir):
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    kb = part.select(
        F.col("p_name").alias("key"), F.concat_ws(" ", "p_type", "p_partkey").alias("target"), F.col("p_brand").alias("type"),
        (F.col("p_size") % 3).cast("int").alias("tier"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("scope"),
        F.col("p_size").alias("priority"), (F.col("p_size") > 5).alias("is_active"))
    scopes = spark.createDataFrame([(2, "Brand#3"), (1, "Brand#4"), (1, "Brand#5")], "tier int, scope string")
    candidates = part.select(F.col("p_name").alias("candidate")).unionByName(customer.select(F.col("c_name").alias("candidate"))).distinct()
    return O.classify_candidates(candidates, kb, scopes)


@query("j18_name_origin", """
WITH tables AS (SELECT n_name AS key, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey),
names AS (SELECT DISTINCT n_name AS name FROM nation UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer)
SELECT name, CASE WHEN key IS NOT NULL THEN 'Japanese' ELSE 'Latin' END AS origin, coalesce(value, trim(name, ' _-.')) AS converted
FROM names LEFT JOIN tables ON key = name""")
def name_origin(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    own = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.lit("japanese_full").alias("kind"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("key"), F.col("r_name").alias("value"))
    fixed = spark.createDataFrame(N.name_rows(), "kind string, ord int, key string, value string")
    names = nation.select(F.col("n_name").alias("name")).unionByName(
        table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))).unionByName(
        table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))).distinct()
    return L.name_origin(names, own.unionByName(fixed))


@query("c8_read_names", """
WITH chars AS (SELECT p_partkey, unnest(range(1, length(p_name) + 1)) AS i, unnest(string_split(p_name, '')) AS ch FROM part),
readings AS (SELECT substr(n_name, 1, 1) AS ch, 'x' AS r FROM nation WHERE n_nationkey < 0
  UNION ALL SELECT chr(97 + n_nationkey), 'nation' || n_nationkey FROM nation)
SELECT p_partkey, string_agg(upper(substr(w, 1, 1)) || lower(substr(w, 2)), ' ' ORDER BY i) AS target FROM (
  SELECT p_partkey, i, coalesce(r, c.ch) AS w FROM chars c LEFT JOIN readings d ON d.ch = c.ch) GROUP BY 1""")
def read_names(spark, sf_dir):
    readings = table(spark, sf_dir, "nation").select(
        F.char(F.lit(97) + F.col("n_nationkey")).alias("key"), F.concat(F.lit("nation"), "n_nationkey", F.lit(", other")).alias("value"))
    return L.read_names(table(spark, sf_dir, "part"), readings, ["p_partkey"], "p_name")


@query("a6_pov", """
SELECT source, CAST(sum(length(regexp_replace(text, '[^iI]', '', 'g'))) AS BIGINT) AS first_person,
  CAST(sum(length(regexp_replace(text, '[^hs]', '', 'g'))) AS BIGINT) AS third_person,
  CASE WHEN sum(length(regexp_replace(text, '[^hs]', '', 'g'))) > sum(length(regexp_replace(text, '[^iI]', '', 'g'))) THEN 3 ELSE 1 END AS pov
FROM documents GROUP BY source""")
def pov(spark, sf_dir):
    return O.pov(table(spark, sf_dir, "documents"), ["source"], "text", "[iI]", "[hs]")


@query("a7_address_forms", """
SELECT DISTINCT conv_id, form FROM (
  SELECT conv_id, unnest(regexp_extract_all(text, '\\n([^\\n]*)\\n', 1)) AS q FROM conversations)
JOIN (SELECT unnest(['the', 'que', 'der', 'de', 'and', 'une']) AS form) ON contains(q, form)""")
def address_forms(spark, sf_dir):
    return O.address_forms(table(spark, sf_dir, "conversations"), ["conv_id"], forms=("the", "que", "der", "de", "and", "une"),
                           quote=r"\n([^\n]*)\n")


@query("c6_quoted_candidates", """
SELECT DISTINCT conv_id, candidate FROM (
  SELECT conv_id, unnest(regexp_extract_all(text, ' ([^ ,.\\n]+),', 1)) AS candidate FROM conversations)
WHERE length(candidate) BETWEEN 2 AND 5""")
def quoted_candidates(spark, sf_dir):
    return O.quoted_candidates(table(spark, sf_dir, "conversations"), ["conv_id"], quote=r" ([^ ,.\n]+),")


EVENTS = """
ev AS (SELECT user_id, event_id AS idx, event_type || ' ' || event_id AS e FROM events WHERE event_type <> 'view'),
undated AS (SELECT user_id, e, r FROM (
  SELECT user_id, event_type || ' ' || event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r
  FROM events WHERE event_type = 'view' AND value < 2) WHERE r <= 5)
"""


@query("j13_recent_context", f"""
WITH {EVENTS},
chapters AS (SELECT user_id, event_id AS mark FROM events WHERE event_type = 'purchase'),
ranked AS (
  SELECT c.user_id, c.mark, v.e, 0 AS k, v.idx AS o, row_number() OVER (PARTITION BY c.user_id, c.mark ORDER BY v.idx DESC) AS r
  FROM chapters c JOIN ev v ON v.user_id = c.user_id AND v.idx < c.mark),
both_kinds AS (
  SELECT user_id, mark, e, k, o FROM ranked WHERE r <= 5
  UNION ALL SELECT c.user_id, c.mark, u.e, 1, 10 - u.r FROM chapters c JOIN undated u ON u.user_id = c.user_id),
lastfive AS (SELECT *, row_number() OVER (PARTITION BY user_id, mark ORDER BY k DESC, o DESC) AS r FROM both_kinds)
SELECT c.user_id, c.mark, coalesce(string_agg(l.e, ';' ORDER BY k, o), '') AS context
FROM chapters c LEFT JOIN (SELECT * FROM lastfive WHERE r <= 5) l ON l.user_id = c.user_id AND l.mark = c.mark GROUP BY 1, 2""")
def recent_context(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    chapters = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("mark"))
    happened = events.filter("event_type <> 'view' or value < 2").select(
        "user_id", F.when(F.col("event_type") != "view", F.col("event_id")).alias("idx"), "event_id",
        F.concat_ws(" ", "event_type", "event_id").alias("e"))
    out = O.recent_context(chapters, happened, ["user_id"], "mark", "idx", F.col("e"), [F.col("event_id")], width=1000)
    return out.select("user_id", "mark", F.array_join("context", ";").alias("context"))


@query("g5_context_array", """
SELECT user_id, event_id, coalesce(array_to_string(list(event_type || ' ' || event_id) OVER (
  PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ';'), '') AS context FROM events""")
def context_array(spark, sf_dir):
    from corpusloom.functions.keyed import last_n_before

    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    out = last_n_before(events.select("user_id", "event_id"), events, ["user_id"], "event_id", "event_id", 5, [], 1000,
                        F.concat_ws(" ", "event_type", "event_id"), "context", ["user_id", "event_id"])
    return out.select("user_id", "event_id", F.coalesce(F.array_join("context", ";"), F.lit("")).alias("context"))


@query("a13_kpis", f"""
WITH {SPANS}, m AS (
  SELECT doc_id, key AS raw, CASE WHEN doc_id % 100 = 0 THEN 'other' ELSE target END AS target, type FROM spans)
SELECT count(DISTINCT CASE WHEN type = 'name' THEN raw END) AS new_characters,
  count(DISTINCT CASE WHEN type <> 'name' THEN raw END) AS new_terms,
  round(count(DISTINCT raw) FILTER (raw NOT IN (SELECT raw FROM m GROUP BY raw HAVING count(DISTINCT target) > 1)) / count(DISTINCT raw), 4) AS consistency
FROM m""")
def kpis(spark, sf_dir):
    from corpusloom.operators.catalog import kpi_terms

    found = spans(spark, sf_dir).select(
        F.col("key").alias("raw"), F.when(F.col("doc_id") % 100 == 0, "other").otherwise(F.col("target")).alias("target"), "type")
    return kpi_terms(found)


@query("a13_kpi_table", f"""
WITH {SPANS}, m AS (SELECT key AS raw, CASE WHEN doc_id % 100 = 0 THEN 'other' ELSE target END AS target, type FROM spans),
cov AS (SELECT count(*) AS total, count(l.key) AS hit FROM tokens t LEFT JOIN lex l ON l.key = t.token AND l.n = 1),
tm AS (SELECT DISTINCT md5(trim(text, {STRIP})) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
talkpairs AS (SELECT u.text AS draft, a.text AS final FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
SELECT 'graph_coverage' AS metric, round(hit / total, 4) AS value FROM cov
UNION ALL SELECT 'memory_hit_rate', round(count(*) FILTER (md5(trim(text, {STRIP})) IN (SELECT h FROM tm)) / count(*), 4) FROM documents
UNION ALL SELECT 'correction_rate', round(count(*) FILTER (draft <> final) / count(*), 4) FROM talkpairs
UNION ALL SELECT 'new_characters', CAST(count(DISTINCT raw) FILTER (type = 'name') AS DOUBLE) FROM m
UNION ALL SELECT 'new_terms', CAST(count(DISTINCT raw) FILTER (type <> 'name') AS DOUBLE) FROM m
UNION ALL SELECT 'consistency', round(count(*) FILTER (n = 1) / count(*), 4) FROM (SELECT raw, count(DISTINCT target) AS n FROM m GROUP BY raw)""")
def kpi_table(spark, sf_dir):
    from corpusloom.operators import memory as M
    from corpusloom.operators.catalog import kpi_table as table_of
    from corpusloom.plans.knowledge import doc_memory

    found = spans(spark, sf_dir).select(
        F.col("key").alias("raw"), F.when(F.col("doc_id") % 100 == 0, "other").otherwise(F.col("target")).alias("target"), "type")
    covered = coverage(spark, sf_dir).filter("doc_id is not null").select("total_units", "matched_units")
    hits = M.tm_hit_rate(table(spark, sf_dir, "documents"), doc_memory(spark, sf_dir), ["source"])
    talk = table(spark, sf_dir, "conversations")
    drafts = talk.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("draft"))
    finals = talk.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("final"))
    return table_of(covered, hits, drafts.join(finals, ["conv_id", "turn"]), found)


@query("g8_recover_segments", r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS raw FROM (
    SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
marked AS (
  SELECT doc_id, line_no, CASE WHEN length(raw) % 3 = 0 THEN '[' || length(raw) % 7 || '] ' || raw ELSE raw END AS line FROM lines),
heads AS (
  SELECT doc_id, line_no, trim(line, """ + STRIP + r""") AS line FROM marked),
parsed AS (
  SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^\[?(\d+)\]?[.:]?\s*(.*)') THEN CAST(regexp_extract(line, '^\[?(\d+)\]?[.:]?\s*(.*)', 1) AS BIGINT) END AS id,
    CASE WHEN regexp_matches(line, '^\[?(\d+)\]?[.:]?\s*(.*)') THEN regexp_extract(line, '^\[?(\d+)\]?[.:]?\s*(.*)', 2) ELSE line END AS t FROM heads),
blocks AS (
  SELECT *, count(id) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM parsed),
joined AS (
  SELECT doc_id, block, max(id) AS id, trim(string_agg(t, chr(10) ORDER BY line_no), """ + STRIP + r""") AS text FROM blocks WHERE block > 0 GROUP BY 1, 2)
SELECT doc_id, id, arg_max(text, block) AS text FROM joined WHERE id BETWEEN 1 AND 4 GROUP BY 1, 2""")
def recover_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    marked = F.transform(F.split("text", "\n", -1), lambda x: F.when(
        F.length(x) % 3 == 0, F.concat(F.lit("["), F.length(x) % 7, F.lit("] "), x)).otherwise(x))
    replies = docs.select("doc_id", F.array_join(marked, "\n").alias("reply"))
    expected = docs.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("id"))
    return Q.recover_segments(replies, expected, ["doc_id"])
