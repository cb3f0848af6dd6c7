"""Quality queries over ``lineitem``, ``orders``, ``documents``, ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import catalog as A
from corpusloom.operators import corpus as C
from corpusloom.operators import quality as Q
from corpusloom.plans import lexicon as LX
from corpusloom.plans.corpus import SEGMENTS, document_lines
from corpusloom.plans.registry import query, sql_text, table

STRIP = sql_text(T.STRIP_CHARS)
MARKS = "[éèêçñßäöü]"

# Raw segments: lines 1..5 of every order. Results: the lines of the order, placed by part number.
RECON = """
raw AS (SELECT o_orderkey AS k, unnest(range(1, 6)) AS id FROM orders),
got AS (SELECT l_orderkey AS k, l_linenumber AS id, count(*) AS n, max(CASE WHEN l_tax > 0.01 THEN 1 ELSE 0 END) AS filled,
    min(CASE WHEN l_returnflag = 'R' THEN 'x' ELSE 's' || l_linenumber END) AS sid, min(l_partkey) AS pos FROM lineitem GROUP BY 1, 2),
known AS (SELECT g.k, g.id, row_number() OVER (PARTITION BY g.k ORDER BY g.id) AS a, row_number() OVER (PARTITION BY g.k ORDER BY pos, g.id) AS b
  FROM got g JOIN raw r ON r.k = g.k AND r.id = g.id),
faults AS (
  SELECT r.k, r.id, 'missing' AS fault FROM raw r LEFT JOIN got g ON g.k = r.k AND g.id = r.id WHERE g.k IS NULL
  UNION ALL SELECT g.k, g.id, 'extra' FROM got g LEFT JOIN raw r ON g.k = r.k AND g.id = r.id WHERE r.k IS NULL
  UNION ALL SELECT k, id, 'duplicate' FROM got WHERE n > 1
  UNION ALL SELECT k, id, 'empty' FROM got WHERE filled = 0
  UNION ALL SELECT g.k, g.id, 'segment_id' FROM got g JOIN raw r ON g.k = r.k AND g.id = r.id WHERE sid <> 's' || g.id
  UNION ALL SELECT k, id, 'out_of_order' FROM known WHERE a <> b)
"""


def order_segments(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("id")).withColumn(
        "segment_id", F.concat(F.lit("s"), "id")).withColumn("text", F.lit("x"))
    refined = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("pos"),
        F.when(F.col("l_returnflag") == "R", "x").otherwise(F.concat(F.lit("s"), "l_linenumber")).alias("segment_id"),
        F.when(F.col("l_tax") > 0.01, "t").otherwise(" ").alias("text"))
    return raw, refined


@query("q1_reconcile", f"WITH {RECON} SELECT k, id, fault FROM faults")
def reconcile(spark, sf_dir):
    return Q.reconcile(*order_segments(spark, sf_dir), ["k"])


@query("q1_count_faults", """
SELECT o_orderkey AS k, 5 AS raw_segments, count(l_orderkey) AS refined_segments FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey HAVING count(l_orderkey) <> 5""")
def count_faults(spark, sf_dir):
    return Q.count_faults(*order_segments(spark, sf_dir), ["k"])


@query("q2_lock_violations", f"""
WITH {LX.LOCKS},
seg AS (SELECT doc_id, source, text AS raw_text, CASE WHEN doc_id % 4 = 0 THEN '' ELSE replace(text, 'the', 'Target0 Target2 Target4 Target6 Target8') END AS refined FROM documents)
SELECT doc_id, raw, target FROM seg JOIN locks ON contains(raw_text, raw)
WHERE "group" = 'characters' AND length(raw) > 1 AND NOT contains(refined, target)""")
def lock_violations(spark, sf_dir):
    refined = F.when(F.col("doc_id") % 4 == 0, "").otherwise(
        F.replace("text", F.lit("the"), F.lit("Target0 Target2 Target4 Target6 Target8")))
    seg = table(spark, sf_dir, "documents").select("doc_id", "text", refined.alias("refined"))
    return Q.lock_violations(seg, LX.locks(spark, sf_dir), ["doc_id"])


@query("q3_length_faults", """
WITH r AS (SELECT conv_id, CASE WHEN role = 'assistant' THEN '' ELSE coalesce(text, '') END AS refined FROM conversations),
s AS (SELECT conv_id, count(*) AS segments, CAST(sum(length(refined)) + count(*) - 1 AS BIGINT) AS chars, max(trim(refined) <> '') AS filled FROM r GROUP BY 1)
SELECT conv_id, segments, chars, CASE WHEN NOT filled THEN 'empty' ELSE 'short' END AS fault FROM s WHERE NOT filled OR chars < 300""")
def length_faults(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select(
        "conv_id", F.when(F.col("role") == "assistant", "").otherwise(F.col("text")).alias("refined"))
    return Q.length_faults(talk, ["conv_id"], short=300)


@query("q4_residue_report", f"""
WITH c AS (SELECT source, doc_id, length(regexp_replace(text, '[^{MARKS[1:-1]}]', '', 'g')) AS c, length(text) AS l FROM documents),
t AS (SELECT source, CAST(sum(c) AS BIGINT) AS residue, count(*) FILTER (c > 0) AS bad_segments, round(sum(c) * 100 / (sum(l) + count(*) - 1), 1) AS share_percent FROM c GROUP BY 1)
SELECT t.*, (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM c WHERE c.source = t.source AND c.c > 0) WHERE n <= 5) AS sample
FROM t WHERE residue > 0""")
def residue_report(spark, sf_dir):
    return Q.residue_report(table(spark, sf_dir, "documents"), ["source"], "doc_id", "text", MARKS)


@query("p5_has_residue", f"""
SELECT doc_id, regexp_matches(text, '{MARKS}') AS residue, CAST(length(regexp_replace(text, '[^{MARKS[1:-1]}]', '', 'g')) AS BIGINT) AS hits FROM documents""")
def has_residue(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.has_residue(F.col("text"), MARKS).alias("residue"), T.residue_count(F.col("text"), MARKS).alias("hits"))


@query("p6_foreign_like", """
WITH n AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE c_mktsegment || ' ậ' END AS target FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(target, '[ậ]') THEN false ELSE length(regexp_replace(target, '[^A-Za-z]', '', 'g')) >= 2
  AND length(regexp_replace(target, '[^A-Za-z]', '', 'g')) / length(target) >= 0.55 END AS foreign_like FROM n""")
def foreign_like(spark, sf_dir):
    third = F.col("c_nationkey") % 3
    target = F.when(third == 0, F.col("c_name")).when(third == 1, F.col("c_mktsegment")).otherwise(
        F.concat("c_mktsegment", F.lit(" ậ")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.is_foreign_like(target).alias("foreign_like"))


@query("k6_residue_lines", rf"""
WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM l WHERE regexp_matches(line, '{MARKS}'))
SELECT doc_id, string_agg('L' || n || ': ' || substr(line, 1, 120), ' | ' ORDER BY n) AS hits FROM b WHERE r <= 5 GROUP BY 1""")
def residue_lines(spark, sf_dir):
    return Q.residue_lines(document_lines(spark, sf_dir), ["doc_id"], script=MARKS)


@query("q5_manifest_faults", f"""
WITH {SEGMENTS}
SELECT doc_id, id, CASE WHEN id % 7 = 0 THEN 'not_in_manifest' WHEN id % 5 = 0 THEN 'source_hash' ELSE 'segment_id' END AS fault
FROM segments WHERE id % 7 = 0 OR id % 5 = 0 OR id % 3 = 0""")
def manifest_faults(spark, sf_dir):
    made = C.segment_manifest(table(spark, sf_dir, "documents"), "doc_id")
    segments = made.select("doc_id", "id", "segment_id", "text")
    # A manifest with every seventh segment lost, every fifth hash and every third id damaged.
    stored = made.filter(F.col("id") % 7 != 0).select(
        "doc_id", "id", F.when((F.col("id") % 3 == 0) & (F.col("id") % 5 != 0), "other").otherwise(F.col("segment_id")).alias("segment_id"),
        F.when(F.col("id") % 5 == 0, F.md5("source_hash")).otherwise(F.col("source_hash")).alias("source_hash"))
    return Q.manifest_faults(segments, stored, ["doc_id"])


@query("q6_schema_gate", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'not an object' WHEN 'view' THEN 'name' WHEN 'click' THEN 'k' ELSE '' END AS faults,
  event_type NOT IN ('error', 'view', 'click') AS passed FROM events""")
def schema_gate(spark, sf_dir):
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    payload = (
        F.when(kind == "error", F.concat(F.lit("["), k, F.lit("]")))
        .when(kind == "view", F.col("props"))
        .when(kind == "click", F.concat(F.lit('{"k":"'), k, F.lit('","name":"a"}')))
        .otherwise(F.concat(F.lit('{"k":'), k, F.lit(',"name":"a"}'))))
    rows = table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    return Q.schema_gate(rows, ["event_id"], "payload", {"k": "int", "name": "string"})


@query("q6_segment_gate", """
WITH s AS (SELECT l_orderkey, CASE WHEN l_tax = 0 THEN NULL ELSE l_linenumber END AS id, CASE WHEN l_discount = 0 THEN ' ' ELSE 'x' END AS text FROM lineitem)
SELECT l_orderkey, count(*) AS segments, count(*) FILTER (id IS NULL) AS without_id, count(*) FILTER (text = ' ') AS blank,
  count(*) - count(*) FILTER (id IS NULL) - count(DISTINCT id) AS repeated,
  count(*) FILTER (id IS NULL) = 0 AND count(*) FILTER (text = ' ') = 0 AND count(*) = count(DISTINCT id) AS passed FROM s GROUP BY 1""")
def segment_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_tax") != 0, F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_discount") == 0, " ").otherwise("x").alias("text"))
    return Q.segment_gate(rows, ["l_orderkey"])


PUBLISH = """
toc AS (SELECT o_custkey, 'f' || o_orderkey AS file, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 't' || o_orderkey END AS translated_file FROM orders WHERE o_orderstatus = 'F'),
files AS (SELECT 't' || l_orderkey AS translated_file, CAST(sum(CASE WHEN l_tax > 0.02 THEN 1 ELSE 0 END) AS BIGINT) AS chars FROM lineitem GROUP BY 1),
timeline AS (SELECT DISTINCT 'f' || l_orderkey AS file FROM lineitem WHERE l_linenumber = 1),
pubfaults AS (
  SELECT o_custkey, file, 'no_file_name' AS fault FROM toc WHERE translated_file IS NULL
  UNION ALL SELECT o_custkey, file, 'file_missing' FROM toc WHERE translated_file IS NOT NULL AND translated_file NOT IN (SELECT translated_file FROM files)
  UNION ALL SELECT o_custkey, file, 'file_empty' FROM toc JOIN files USING (translated_file) WHERE chars = 0
  UNION ALL SELECT o_custkey, file, 'timeline_missing' FROM toc WHERE file NOT IN (SELECT file FROM timeline))
"""


@query("q7_publish_faults", f"WITH {PUBLISH} SELECT * FROM pubfaults")
def publish_faults(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    toc = orders.select(
        "o_custkey", "o_orderkey", F.concat(F.lit("f"), "o_orderkey").alias("file"),
        F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("t"), "o_orderkey")).alias("translated_file"))
    files = items.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_tax") > 0.02, 1).otherwise(0)).alias("chars")).select(
        F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("t"), "l_orderkey").alias("translated_file"), "chars")
    timeline = items.filter("l_linenumber = 1").select(
        F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("f"), "l_orderkey").alias("file"))
    faults = Q.publish_faults(toc, files, timeline, ["o_orderkey"])
    return faults.join(toc.select("o_orderkey", "o_custkey"), "o_orderkey").select("o_custkey", "file", "fault")


@query("q8_gate", f"""
WITH {RECON},
v AS (SELECT k, CASE WHEN fault IN ('segment_id', 'out_of_order') THEN 'warning' ELSE 'error' END AS level, fault || ' ' || id AS message FROM faults
  UNION ALL SELECT o_orderkey, 'error', 'segments 5/' || count(l_orderkey) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) <> 5
  UNION ALL SELECT l_orderkey, 'warning', 'short' FROM lineitem GROUP BY 1 HAVING count(*) * 2 - 1 < 10 AND max(l_tax) > 0.01
  UNION ALL SELECT l_orderkey, 'error', 'empty' FROM lineitem GROUP BY 1 HAVING max(l_tax) <= 0.01),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY message) AS n FROM v WHERE level = 'error')
SELECT k, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (level = 'error') = 0 AS passed,
  coalesce((SELECT string_agg(message, ' | ' ORDER BY message) FROM r WHERE r.k = v.k AND n <= 5), '') AS first_errors
FROM v GROUP BY k""")
def gate(spark, sf_dir):
    raw, refined = order_segments(spark, sf_dir)
    faults, counts = Q.reconcile(raw, refined, ["k"]), Q.count_faults(raw, refined, ["k"])
    short = Q.length_faults(refined, ["k"], "text")
    soft = F.when(F.col("fault").isin("segment_id", "out_of_order", "short"), "warning").otherwise("error")
    # Faults are dealt by their ids; the other checks give one row per chapter.
    cell, one = F.floor(F.col("id") / Q.CELL_IDS), F.lit(0)
    all_rows = Q.as_violations(faults, ["k"], soft, F.concat_ws(" ", "fault", "id"), cell).unionByName(
        Q.as_violations(counts, ["k"], "error", F.concat(F.lit("segments "), "raw_segments", F.lit("/"), "refined_segments"), one)
    ).unionByName(Q.as_violations(short, ["k"], soft, F.col("fault"), one))
    return Q.gate(all_rows, ["k"])


@query("q9_retry_list", """
WITH raw AS (SELECT o_orderkey AS k, unnest(range(1, 6)) AS id FROM orders),
got AS (SELECT l_orderkey AS k, l_linenumber AS id, max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS good FROM lineitem WHERE l_tax > 0 GROUP BY 1, 2)
SELECT r.k, r.id, CASE WHEN g.k IS NULL THEN 'missing' ELSE 'residue' END AS reason FROM raw r LEFT JOIN got g ON g.k = r.k AND g.id = r.id
WHERE g.k IS NULL OR good = 0""")
def retry_list(spark, sf_dir):
    raw, _ = order_segments(spark, sf_dir)
    refined = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"),
        F.when(F.col("l_tax") == 0, "").when(F.col("l_returnflag") == "R", "ab中").otherwise("ab").alias("text"))
    return Q.retry_list(raw.select("k", "id"), refined, ["k"])


@query("c13_parse_reply", """
SELECT event_id, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN 1 END AS segments,
  CASE WHEN event_type <> 'error' THEN 'k ' || CAST(json_extract(props, '$.k') AS VARCHAR) END AS first_text FROM events""")
def parse_reply(spark, sf_dir):
    kind = F.col("event_type")
    body = F.concat(F.lit('{"refined_segments":[{"id":1,"refined_translation":"k '), F.get_json_object("props", "$.k"), F.lit('"}]}'))
    reply = (
        F.when(kind == "error", "no object here").when(kind == "view", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == "click", F.concat(F.lit("Here it is: "), body)).otherwise(body))
    parsed = Q.parse_reply(table(spark, sf_dir, "events").select("event_id", reply.alias("reply")))
    return parsed.select(
        "event_id", "ok", F.when(F.col("ok"), F.size("reply.refined_segments")).alias("segments"),
        F.get(F.col("reply.refined_segments"), F.lit(0))["refined_translation"].alias("first_text"))


@query("j14_align_segments", """
SELECT u.conv_id, u.turn, length(u.text) AS raw_chars, length(a.text) AS refined_chars FROM conversations u
JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant' AND length(u.text) > 5 AND a.text <> ''""")
def align_segments(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    raw = talk.filter("role = 'user'").select("conv_id", "turn", "text")
    refined = talk.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return Q.align_segments(raw, refined, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.length("raw_text").alias("raw_chars"), F.length("refined_translation").alias("refined_chars"))


@query("a3_work_by_state", """
SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, 0 AS processing, 0 AS pending,
  CAST(floor(count(*) FILTER (o_orderstatus = 'F') * 100 / count(*)) AS BIGINT) AS percent FROM orders GROUP BY 1""")
def work_by_state(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "done").otherwise("open"))
    return A.progress(rows, ["o_orderpriority"])
