"""Knowledge-base queries over ``part``, ``supplier``, ``customer``, ``lineitem``, ``documents`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import kb as K
from corpusloom.operators import memory as M
from corpusloom.plans.registry import query, sql_text, table
from corpusloom.session import work_dir
from corpusloom.sources import tables as S

STRIP = sql_text(T.STRIP_CHARS)

# Old tables: every part is a term named by its type and size, every supplier and customer an entity.
TERM = """
term AS (
  SELECT p_name || ' ' || p_size AS source, p_type AS target, p_brand AS type, CAST(p_size % 3 AS INT) AS tier,
    CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS scope, p_partkey AS id, p_size AS priority,
    p_retailprice AS confidence FROM part)
"""
ENTITY = """
entity AS (
  SELECT s_suppkey AS id, source, entity_type, tier, scope, aliases, description, status FROM (
    SELECT s_suppkey, p_name || ' ' || p_size AS source,
      CASE s_nationkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' WHEN 2 THEN 'location' END AS entity_type,
      CAST(s_nationkey % 3 AS INT) AS tier, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE 'n' || s_nationkey END AS scope,
      CASE WHEN s_nationkey % 2 = 0 THEN '[]' ELSE s_name END AS aliases,
      CASE WHEN s_acctbal < 5000 THEN '' ELSE 'balance ' || CAST(s_suppkey AS VARCHAR) END AS description,
      CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE 'active' END AS status
    FROM supplier JOIN part ON p_partkey = s_suppkey)
  UNION ALL SELECT 1000000000 + s_suppkey, s_name, 'person', 1, 'n' || s_nationkey, s_name, '', NULL FROM supplier)
"""
NODE = f"""
{TERM}, {ENTITY},
ranked AS (
  SELECT key, type, tier, scope, row_number() OVER (PARTITION BY key ORDER BY r, tier, scope NULLS FIRST, type) AS n FROM (
    SELECT source AS key, 'term' AS type, tier, scope, 0 AS r FROM term UNION ALL
    SELECT source, CASE entity_type WHEN 'person' THEN 'character' WHEN 'organization' THEN 'sect'
      ELSE coalesce(entity_type, 'term') END, tier, scope, 1 FROM entity)),
node AS (SELECT key, type, tier, scope FROM ranked WHERE n = 1)
"""


def old_term(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tier = (F.col("p_size") % 3).cast("int")
    return part.select(
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("source"), F.col("p_type").alias("target"),
        F.col("p_brand").alias("type"), tier.alias("tier"),
        F.when(tier != 0, F.col("p_brand")).alias("scope"), F.col("p_partkey").alias("id"),
        F.col("p_size").alias("priority"), F.col("p_retailprice").alias("confidence"),
        F.lit(None).cast("string").alias("pos"), F.lit(None).cast("string").alias("context_marker"))


def old_entity(spark, sf_dir):
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    nation = F.col("s_nationkey")
    named = supplier.join(part, supplier["s_suppkey"] == part["p_partkey"]).select(
        F.col("s_suppkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("source"),
        F.when(nation % 4 == 0, "person").when(nation % 4 == 1, "organization").when(nation % 4 == 2, "location")
        .alias("entity_type"),
        (nation % 3).cast("int").alias("tier"), F.when(nation % 3 != 0, F.concat(F.lit("n"), nation)).alias("scope"),
        F.when(nation % 2 == 0, "[]").otherwise(F.col("s_name")).alias("aliases"),
        F.when(F.col("s_acctbal") < 5000, "").otherwise(F.concat(F.lit("balance "), "s_suppkey")).alias("description"),
        F.when(nation % 5 != 0, "active").alias("status"))
    people = supplier.select(
        (F.col("s_suppkey") + 1000000000).alias("id"), F.col("s_name").alias("source"),
        F.lit("person").alias("entity_type"), F.lit(1).alias("tier"), F.concat(F.lit("n"), nation).alias("scope"),
        F.col("s_name").alias("aliases"), F.lit("").alias("description"), F.lit(None).cast("string").alias("status"))
    return named.unionByName(people)


def nodes(spark, sf_dir):
    return K.build_nodes(old_term(spark, sf_dir), old_entity(spark, sf_dir))


@query("u1_build_nodes", f"WITH {NODE} SELECT key, type, tier, scope FROM node")
def build_nodes(spark, sf_dir):
    return nodes(spark, sf_dir).drop("id")


@query("j1_node_translations", f"""
WITH {NODE} SELECT n.key, t.target AS vietnamese, t.priority, t.type AS source_dict FROM term t JOIN node n ON t.source = n.key""")
def node_translations(spark, sf_dir):
    node = nodes(spark, sf_dir)
    made = K.node_translations(old_term(spark, sf_dir), node)
    return made.join(node, made["node_id"] == node["id"]).select("key", "vietnamese", "priority", "source_dict")


@query("j1_lineitem_part", """
SELECT p_name, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem
JOIN part ON l_partkey = p_partkey GROUP BY p_name""")
def lineitem_part(spark, sf_dir):
    items, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    # Lines are counted per part key before the join, so a hot part does not travel.
    sums = items.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return sums.join(part, sums["l_partkey"] == part["p_partkey"]).groupBy("p_name").agg(
        F.sum("n").alias("lines"), F.sum("q").cast("long").alias("quantity"))


@query("j2_remap_edges", f"""
WITH {NODE}
SELECT nf.key AS source_key, nt.key AS target_key, l_returnflag AS relationship,
  coalesce(CASE WHEN l_tax > 0 THEN l_tax END, 1.0) AS confidence
FROM lineitem JOIN entity ef ON ef.id = l_suppkey JOIN entity et ON et.id = l_partkey
JOIN node nf ON ef.source = nf.key JOIN node nt ON et.source = nt.key""")
def remap_edges(spark, sf_dir):
    node = nodes(spark, sf_dir)
    edge = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("relation"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("weight"))
    made = K.remap_edges(edge, old_entity(spark, sf_dir), node)
    return made.join(node.select(F.col("id").alias("source_id"), F.col("key").alias("source_key")), "source_id").join(
        node.select(F.col("id").alias("target_id"), F.col("key").alias("target_key")), "target_id"
    ).select("source_key", "target_key", "relationship", "confidence")


@query("j2_order_nation", """
SELECT n_name, count(*) AS lines, count(DISTINCT o_orderkey) AS orders FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name""")
def order_nation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name").agg(F.sum("n").alias("lines"), F.count("*").alias("orders")))


@query("j3_node_attributes", f"""
WITH {NODE},
long AS (
  SELECT id, source, 'aliases' AS attr_key, aliases AS attr_value FROM entity WHERE aliases <> '' AND aliases <> '[]'
  UNION ALL SELECT id, source, 'description', description FROM entity WHERE description <> ''
  UNION ALL SELECT id, source, 'status', status FROM entity WHERE status <> '')
SELECT n.key, attr_key, arg_min(attr_value, l.id) AS attr_value FROM long l JOIN node n ON l.source = n.key
GROUP BY n.key, attr_key""")
def node_attributes(spark, sf_dir):
    node = nodes(spark, sf_dir)
    made = K.node_attributes(old_entity(spark, sf_dir), node)
    return made.join(node, made["node_id"] == node["id"]).select("key", "attr_key", "attr_value")


@query("j4_override_type", f"""
WITH {NODE},
best AS (
  SELECT source, arg_min(CASE entity_type WHEN 'person' THEN 'character' WHEN 'organization' THEN 'sect'
    ELSE coalesce(entity_type, 'term') END, (-tier) * 10000000000 + id) AS type FROM entity GROUP BY source)
SELECT n.key, coalesce(b.type, n.type) AS type, n.tier FROM node n LEFT JOIN best b ON b.source = n.key""")
def override_type(spark, sf_dir):
    return K.override_type(nodes(spark, sf_dir), old_entity(spark, sf_dir)).select("key", "type", "tier")


@query("a1_prefix_table", f"""
WITH {NODE} SELECT substr(key, 1, 1) AS head, max(length(key)) AS max_len FROM node GROUP BY 1""")
def prefix_table(spark, sf_dir):
    return K.prefix_table(nodes(spark, sf_dir))


@query("s3_load_lexicon", f"""
WITH {NODE}
SELECT n.key, t.target, n.type, t.priority, t.type AS source_dict, n.tier, n.scope
FROM term t JOIN node n ON t.source = n.key
WHERE t.confidence < 950 AND t.type NOT IN ('Brand#1', 'Brand#2')""")
def load_lexicon(spark, sf_dir):
    node = nodes(spark, sf_dir)
    translations = K.node_translations(old_term(spark, sf_dir), node).withColumn("is_active", F.col("confidence") < 950)
    return S.load_lexicon(node, translations, ("Brand#1", "Brand#2")).drop("pos")


@query("s4_load_layer", """
SELECT 'project' AS layer, 'p1' AS scope, s_name AS key, 'nation ' || s_nationkey AS target, 'character' AS type FROM supplier
UNION ALL SELECT 'style', NULL, c_name, c_mktsegment, 'term' FROM customer
UNION ALL SELECT 'universe', 'u1', n_name, 'region ' || n_regionkey, 'location' FROM nation""")
def load_layer(spark, sf_dir):
    base = work_dir(spark, "layers")
    none = F.lit(None).cast("string").alias("pos")
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    entries = {
        "project": supplier.select(F.col("s_name").alias("key"), F.concat(F.lit("nation "), "s_nationkey").alias("target"),
                                   none, F.lit("character").alias("type")),
        "style": customer.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("target"), none,
                                 F.lit("term").alias("type")),
        "universe": nation.select(F.col("n_name").alias("key"), F.concat(F.lit("region "), "n_regionkey").alias("target"),
                                  none, F.lit("location").alias("type")),
    }
    K.copy_dims(spark, entries, base, {})
    scopes = {"project": "p1", "style": None, "universe": "u1"}
    out = None
    for layer, scope in scopes.items():
        part = S.load_layer_path(spark, f"{base}/{layer}", layer, scope)
        out = part if out is None else out.unionByName(part)
    return out.drop("pos")


@query("u8_copy_dims", """
SELECT 'nation' AS dim, n_name AS name, CAST(n_regionkey AS BIGINT) AS id FROM nation
UNION ALL SELECT 'region', r_name, r_regionkey FROM region""")
def copy_dims(spark, sf_dir):
    base = work_dir(spark, "dims")
    paths = K.copy_dims(spark, {n: table(spark, sf_dir, n) for n in ("nation", "region")}, base,
                        {"nation": ["n_name", "n_regionkey"]})
    return spark.read.parquet(paths["nation"]).select(
        F.lit("nation").alias("dim"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("id")
    ).unionByName(spark.read.parquet(paths["region"]).select(
        F.lit("region").alias("dim"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("id")))


DOC_TM = f"""
tm AS (
  SELECT md5(trim(text, {STRIP})) AS raw_hash, 'T' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS translated_text, source AS project_scope
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
"""


def doc_memory(spark, sf_dir):
    # Texts are hashed first, so that the join moves hashes.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", M.raw_hash(F.col("text")).alias("raw_hash"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(
        "raw_hash",
        F.concat(F.lit("T"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("translated_text"),
        F.col("source").alias("project_scope"))


@query("j5_tm_lookup", f"""
WITH {DOC_TM},
own AS (SELECT raw_hash, project_scope, min(translated_text) AS t FROM tm GROUP BY 1, 2),
anyone AS (SELECT raw_hash, t FROM (
  SELECT raw_hash, t, row_number() OVER (PARTITION BY raw_hash ORDER BY project_scope, t) AS n FROM own) WHERE n = 1)
SELECT d.doc_id, coalesce(o.t, a.t) AS translated_text,
  CASE WHEN o.t IS NOT NULL THEN 'project' WHEN a.t IS NOT NULL THEN 'any' END AS match
FROM (SELECT doc_id, source, md5(trim(text, {STRIP})) AS h FROM documents) d
LEFT JOIN own o ON o.raw_hash = d.h AND o.project_scope = d.source LEFT JOIN anyone a ON a.raw_hash = d.h""")
def tm_lookup(spark, sf_dir):
    segments = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("scope"))
    return M.tm_lookup(segments, doc_memory(spark, sf_dir)).select("doc_id", "translated_text", "match")


@query("u2_tm_from_segments", """
SELECT md5(text) AS raw_hash, arg_min(source, doc_id) AS branch, min(doc_id) AS chapter, arg_min(lang, doc_id) AS target
FROM documents GROUP BY 1""")
def tm_from_segments(spark, sf_dir):
    context = table(spark, sf_dir, "documents").select(
        F.md5("text").alias("source_hash"), F.col("source").alias("branch"), F.col("doc_id").alias("chapter"),
        F.col("lang").alias("target"))
    return M.tm_from_segments(context, [F.col("chapter")])


@query("u3_tm_upsert", f"""
WITH rows AS (
  SELECT md5(trim(text, {STRIP})) AS raw_hash, doc_id, lang, source, CASE WHEN lang IN ('en', 'fr') THEN 0 ELSE 1 END AS w
  FROM documents WHERE length(text) > 5)
SELECT raw_hash, arg_max(lang || ' ' || doc_id, w * 1000000000 + doc_id) AS translated_text,
  arg_max(source, w * 1000000000 + doc_id) AS project_scope,
  CASE WHEN min(w) = 0 THEN CAST(arg_min(doc_id, w * 1000000000 + doc_id) AS BIGINT) END AS chapter_index,
  CASE WHEN min(w) = 0 THEN 3 ELSE 1 END AS hit_count,
  arg_min(doc_id, w * 1000000000 + doc_id) AS first_at, arg_max(doc_id, w * 1000000000 + doc_id) AS last_at
FROM rows GROUP BY raw_hash""")
def tm_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pairs = docs.select("lang", F.col("text").alias("raw_text"), "doc_id", "source",
                        F.concat_ws(" ", "lang", "doc_id").alias("refined_translation"), F.col("doc_id").alias("seen_at"))
    old_lang = F.col("lang").isin("en", "fr")
    old = M.memory_pairs(pairs.filter(old_lang), F.col("source")).withColumn(
        "chapter_index", F.col("seen_at")).withColumn("hit_count", F.lit(3))
    new = M.memory_pairs(pairs.filter(~old_lang), F.col("source"))
    return M.tm_upsert(old, new).drop("raw_text")


@query("a11_tm_hits", f"""
WITH {DOC_TM}
SELECT t.raw_hash, count(d.doc_id) AS hits, max(d.doc_id) AS last_used_at
FROM (SELECT DISTINCT raw_hash FROM tm) t
LEFT JOIN (SELECT doc_id, md5(trim(text, {STRIP})) AS h FROM documents) d ON d.h = t.raw_hash GROUP BY 1""")
def tm_hits(spark, sf_dir):
    return M.tm_hits(table(spark, sf_dir, "documents"), doc_memory(spark, sf_dir), "text", "doc_id")


@query("a11_tm_hit_rate", f"""
WITH {DOC_TM}
SELECT source, count(*) AS segments, count(*) FILTER (h IN (SELECT raw_hash FROM tm)) AS hits,
  round(count(*) FILTER (h IN (SELECT raw_hash FROM tm)) / count(*), 4) AS hit_rate
FROM (SELECT source, md5(trim(text, {STRIP})) AS h FROM documents) GROUP BY source""")
def tm_hit_rate(spark, sf_dir):
    return M.tm_hit_rate(table(spark, sf_dir, "documents"), doc_memory(spark, sf_dir), ["source"])


@query("u4_reading_map", """
SELECT key, value FROM (
  SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY r DESC) AS n FROM (
    SELECT CAST(n_regionkey AS VARCHAR) AS key, max(n_name) AS value, 0 AS r FROM nation GROUP BY 1
    UNION ALL SELECT CAST(r_regionkey AS VARCHAR), CASE WHEN r_regionkey = 1 THEN '' ELSE r_name END, 1 FROM region
    UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'fixed', 2 FROM nation WHERE n_nationkey = 3) WHERE value <> '') WHERE n = 1""")
def reading_map(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a = nation.groupBy(F.col("n_regionkey").cast("string").alias("key")).agg(F.max("n_name").alias("value"))
    b = region.select(F.col("r_regionkey").cast("string").alias("key"),
                      F.when(F.col("r_regionkey") == 1, "").otherwise(F.col("r_name")).alias("value"))
    fix = nation.filter("n_nationkey = 3").select(F.col("n_nationkey").cast("string").alias("key"), F.lit("fixed").alias("value"))
    return K.reading_map(a, b, fix)


@query("u5_catalog_append", """
SELECT page_id AS id, url, CASE WHEN regexp_matches(url, '#top$') THEN 'done' WHEN page_id % 2 = 0 THEN 'queued' ELSE 'discovered' END AS status FROM pages""")
def catalog_append(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.lit("discovered").alias("status"))
    secure = F.startswith("url", F.lit("https:"))
    # Every other page is queued first; a later change, that sorts before it by name, makes some of them done.
    queued = pages.filter("id % 2 = 0").select("id", F.lit("queued").alias("status"), F.lit(1).alias("change_no"))
    done = pages.filter(F.col("url").endswith("#top")).select("id", F.lit("done").alias("status"), F.lit(2).alias("change_no"))
    status = done.unionByName(queued)
    return K.catalog_append(pages.filter(secure), pages.filter(~secure), status)


@query("u6_add_edges", """
SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_returnflag || l_linestatus AS relationship FROM lineitem
WHERE l_linestatus = 'F' OR l_returnflag <> 'N'""")
def add_edges(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"),
        F.concat("l_returnflag", "l_linestatus").alias("relationship"), "l_linestatus")
    old = edges.filter("l_linestatus = 'F'")
    new = edges.filter("l_linestatus <> 'F'").withColumn(
        "relationship", F.when(F.startswith("relationship", F.lit("N")), " ").otherwise(
            F.concat(F.lit(" "), "relationship", F.lit("\t"))))
    return K.add_edges(old, new)


@query("u7_set_terms", """
WITH entries AS (SELECT p_name AS key, min(p_type) AS target FROM part GROUP BY 1),
edits AS (SELECT CASE WHEN p_size > 45 THEN p_brand ELSE p_name END AS key, 'new ' || p_type AS target, p_partkey AS edit_no FROM part WHERE p_size > 40)
SELECT key, target FROM (
  SELECT key, target, row_number() OVER (PARTITION BY key ORDER BY edit_no DESC) AS n FROM (
    SELECT key, target, -1 AS edit_no FROM entries UNION ALL SELECT * FROM edits)) WHERE n = 1""")
def set_terms(spark, sf_dir):
    entries, edits = term_edits(spark, sf_dir)
    return K.set_terms(entries, edits, ["key"])


@query("u7_update_targets", """
WITH entries AS (SELECT p_name AS key, min(p_type) AS target FROM part GROUP BY 1),
edits AS (SELECT CASE WHEN p_size > 45 THEN p_brand ELSE p_name END AS key, 'new ' || p_type AS target, p_partkey AS edit_no FROM part WHERE p_size > 40)
SELECT e.key, coalesce((SELECT arg_max(d.target, d.edit_no) FROM edits d WHERE d.key = e.key), e.target) AS target FROM entries e""")
def update_targets(spark, sf_dir):
    entries, edits = term_edits(spark, sf_dir)
    return K.update_targets(entries, edits, ["key"])


def term_edits(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    entries = part.groupBy(F.col("p_name").alias("key")).agg(F.min("p_type").alias("target"))
    edits = part.filter("p_size > 40").select(
        F.when(F.col("p_size") > 45, F.col("p_brand")).otherwise(F.col("p_name")).alias("key"),
        F.concat(F.lit("new "), "p_type").alias("target"), F.col("p_partkey").alias("edit_no"))
    return entries, edits


@query("u9_append_entities", """
SELECT event_id, event_type AS type, CASE WHEN event_type = 'error' THEN '' ELSE 'u' || user_id END AS raw FROM events WHERE event_type <> 'error'""")
def append_entities(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("type"),
        F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit("u"), "user_id")).alias("raw"))
    return K.append_entities(log.filter("type in ('view', 'error')"), log.filter("type not in ('view', 'error')"), ["raw", "type"])


@query("u10_enqueue", """
WITH open AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 200),
ranked AS (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
  WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM open))
SELECT user_id, event_id FROM ranked WHERE n = 1""")
def enqueue(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    jobs = events.filter("event_type = 'signup'").select(
        "user_id", F.when(F.col("value") > 200, "running").otherwise("done").alias("status"))
    requests = events.filter("event_type = 'purchase'")
    return K.enqueue(jobs, requests, "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("u11_edge_changes", """
WITH before AS (SELECT l_suppkey, l_partkey, max(l_returnflag) AS r FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1, 2),
after AS (SELECT l_suppkey, l_partkey, max(l_returnflag) AS r FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2)
SELECT coalesce(b.l_suppkey, a.l_suppkey) AS l_suppkey, coalesce(b.l_partkey, a.l_partkey) AS l_partkey,
  CASE WHEN b.r IS NULL THEN 'create' WHEN a.r IS NULL THEN 'delete' ELSE 'update' END AS action,
  b.r AS old_relation, a.r AS new_relation
FROM before b FULL JOIN after a ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey
WHERE b.r IS DISTINCT FROM a.r""")
def edge_changes(spark, sf_dir):
    items, key = table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"]
    before = items.filter("l_shipdate < timestamp_ntz '1999-01-01'").groupBy(*key).agg(F.max("l_returnflag").alias("r"))
    after = items.filter("l_shipdate >= timestamp_ntz '1998-01-01'").groupBy(*key).agg(F.max("l_returnflag").alias("r"))
    return K.edge_changes(before, after, key, "r")
