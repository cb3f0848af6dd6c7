"""Catalog, progress, queue and paging queries over ``orders``, ``lineitem``, ``events``, ``customer``, ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import catalog as A
from corpusloom.plans.registry import query, table
from corpusloom.session import work_dir
from corpusloom.sources import tables as S

# Every customer is a project, its orders are chapters: F done, P processing, O pending.
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'processing' ELSE 'pending' END"


def toc(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "processing").otherwise("pending")
    return table(spark, sf_dir, "orders").withColumn("status", status)


@query("a3_progress", f"""
WITH t AS (SELECT o_custkey, {STATUS} AS status FROM orders)
SELECT o_custkey, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'processing') AS processing,
  count(*) FILTER (status = 'pending') AS pending, CAST(floor(count(*) FILTER (status = 'done') * 100 / count(*)) AS BIGINT) AS percent
FROM t GROUP BY o_custkey""")
def progress(spark, sf_dir):
    return A.progress(toc(spark, sf_dir), ["o_custkey"])


@query("a4_queue_stats", """
SELECT status, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'blocked' ELSE 'queued' END AS status, count(*) AS n
  FROM events GROUP BY 1) GROUP BY 1""")
def queue_stats(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "click", "running").when(kind == "purchase", "done").when(kind == "error", "error").when(kind == "signup", "blocked")
    return A.queue_stats(table(spark, sf_dir, "events").select(status.alias("status")))


@query("a8_catalog", """
SELECT o_custkey, count(*) AS chapter_count, min(o_orderkey) AS first_chapter, arg_min(o_orderpriority, o_orderkey) AS first_title
FROM orders GROUP BY o_custkey""")
def catalog(spark, sf_dir):
    return A.catalog(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderpriority")


def order_parts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return A.catalog_parts(orders, ["o_custkey"], [F.col("o_orderkey")], F.floor(F.col("o_orderkey") / 4096),
                           ["o_orderkey", "o_orderpriority"], 4)


PARTS = """
SELECT o_custkey, CAST(floor((n - 1) / 4) AS BIGINT) AS part_no, string_agg(n || ':' || o_orderkey || ':' || o_orderpriority, ',' ORDER BY n) AS chapters
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1, 2"""


def flat_parts(parts):
    return parts.select("o_custkey", "part_no", F.array_join(F.transform("chapters", lambda c: F.concat_ws(
        ":", c["index"], c["o_orderkey"], c["o_orderpriority"])), ",").alias("chapters"))


@query("a8_catalog_parts", PARTS)
def catalog_parts(spark, sf_dir):
    return flat_parts(order_parts(spark, sf_dir))


@query("s9_write_catalog", PARTS)
def write_catalog(spark, sf_dir):
    parts, path = order_parts(spark, sf_dir), work_dir(spark, "catalog")
    S.write_catalog(parts, path)
    return flat_parts(spark.read.schema(parts.schema).json(path))


@query("s8_write_table", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem
WHERE NOT (l_returnflag = 'A' AND l_linestatus = 'F') GROUP BY 1, 2""")
def write_table(spark, sf_dir):
    items, path = table(spark, sf_dir, "lineitem"), work_dir(spark, "table")
    S.write_table(items, path, "l_returnflag")
    # Replace one partition only: flag A without its closed lines.
    S.write_table(items.filter("l_returnflag = 'A' and l_linestatus <> 'F'"), path, "l_returnflag")
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("s8_write_snapshot", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity,
  count(*) FILTER (NOT (l_returnflag = 'A' AND l_linestatus = 'F')) AS kept FROM lineitem GROUP BY 1, 2""")
def write_snapshot(spark, sf_dir):
    items, path = table(spark, sf_dir, "lineitem"), work_dir(spark, "snapshots")
    first = S.write_snapshot(items, path, "l_returnflag")
    S.write_snapshot(items.filter("l_returnflag = 'A' and l_linestatus <> 'F'"), path, "l_returnflag")
    # Both states are read: the first one is still whole, the second one lacks the closed lines of flag A.
    both = S.read_snapshot(spark, path, first).withColumn("_old", F.lit(1)).unionByName(
        S.read_snapshot(spark, path).withColumn("_old", F.lit(0)))
    return both.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("_old").alias("n"), F.sum(F.when(F.col("_old") == 1, F.col("l_quantity"))).cast("long").alias("quantity"),
        F.sum(1 - F.col("_old")).alias("kept"))


@query("a9_home", f"""
WITH t AS (SELECT *, {STATUS} AS status FROM orders)
SELECT o_custkey, count(*) FILTER (status = 'done') AS completed_chapters, count(*) FILTER (status <> 'done') > 0 AS ongoing, max(o_orderdate) AS updated_at
FROM t GROUP BY 1""")
def home(spark, sf_dir):
    return A.home(toc(spark, sf_dir), ["o_custkey"], "o_orderdate")


@query("a14_crawl_errors", """
WITH bad AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'error')
SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed,
  (SELECT string_agg(CAST(b.event_id AS VARCHAR), '; ' ORDER BY r) FROM bad b WHERE b.user_id = e.user_id AND r <= 5) AS sample
FROM events e GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') > 0""")
def crawl_errors(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return A.crawl_errors(events, ["user_id"], F.struct("ts", "event_id"), "event_id", F.col("event_type") == "error")


@query("j11_repair_toc", """
WITH files AS (
  SELECT o_custkey, o_orderkey AS file_no, CASE WHEN o_orderpriority = '5-LOW' THEN 'extra ' || o_orderkey || '.md' ELSE 'Chapter ' || printf('%07d', o_orderkey) || ' x.md' END AS file FROM orders),
toc AS (SELECT o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'extra ' || o_orderkey || '.md' ELSE 'Chapter ' || printf('%07d', o_orderkey) || ' x.md' END AS file,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'processing' ELSE 'blocked' END AS status FROM orders WHERE o_totalprice > 100000),
ready AS (SELECT o_custkey, o_orderkey AS idx, 'Chapter ' || o_orderkey || ' vi.md' AS translated_file FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 7 AND o_orderkey > 0 GROUP BY ALL),
placed AS (SELECT *, CASE WHEN file LIKE 'Chapter%' AND file_no > 0 THEN file_no ELSE row_number() OVER (PARTITION BY o_custkey ORDER BY file_no) END AS idx FROM files)
SELECT p.o_custkey, p.idx AS index, p.file, CASE WHEN r.idx IS NOT NULL THEN 'done' WHEN t.status IN ('processing', 'done') OR t.status IS NULL THEN 'pending' ELSE t.status END AS status, r.translated_file
FROM placed p LEFT JOIN toc t USING (o_custkey, file) LEFT JOIN ready r ON r.o_custkey = p.o_custkey AND r.idx = p.idx""")
def repair_toc(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("extra "), "o_orderkey", F.lit(".md"))).otherwise(
        F.format_string("Chapter %07d x.md", "o_orderkey"))
    files = orders.select("o_custkey", F.col("o_orderkey").alias("file_no"), name.alias("file"))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "processing").otherwise("blocked")
    old = orders.filter("o_totalprice > 100000").select("o_custkey", name.alias("file"), status.alias("status"))
    last = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7").select("l_orderkey").distinct()
    ready = orders.join(last, orders["o_orderkey"] == last["l_orderkey"], "left_semi").select(
        "o_custkey", F.concat(F.lit("Chapter "), "o_orderkey", F.lit(" vi.md")).alias("file"))
    return A.repair_toc(files, old, ready, ["o_custkey"])


@query("j12_crawl_gaps", """
WITH want AS (SELECT o_orderkey, unnest(range(1, 8)) AS index FROM orders)
SELECT o_orderkey, index FROM want w WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = index)""")
def crawl_gaps(spark, sf_dir):
    want = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("index"))
    have = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("index"))
    return A.crawl_gaps(want, have, ["o_orderkey"])


@query("j12_resume_points", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 6 END AS end_chapter, max(l_linenumber) + 1 AS next_chapter
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus
HAVING o_orderstatus <> 'O' OR max(l_linenumber) < 6""")
def resume_points(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", 6).alias("end_chapter"))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("index"))
    return A.resume_points(files, jobs, ["o_orderkey"])


@query("g10_backlog_head", f"""
WITH t AS (SELECT *, {STATUS} AS status, CASE WHEN o_totalprice > 400000 THEN 3 WHEN o_totalprice > 300000 THEN 1 END AS fail_count FROM orders)
SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM t WHERE status = 'pending' AND coalesce(fail_count, 0) < 3 GROUP BY 1""")
def backlog_head(spark, sf_dir):
    fails = F.when(F.col("o_totalprice") > 400000, 3).when(F.col("o_totalprice") > 300000, 1)
    rows = toc(spark, sf_dir).withColumn("fail_count", fails)
    return A.backlog_head(rows, ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("p11_open_work", """
SELECT event_id FROM events WHERE event_type IN ('view', 'error') OR (event_type = 'click' AND coalesce(CASE WHEN value > 20 THEN 3 WHEN value > 10 THEN 2 END, 0) < 3)""")
def open_work(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "view", "discovered").when(kind == "error", "error").when(kind == "click", "pending").otherwise("done")
    items = table(spark, sf_dir, "events").select(
        "event_id", status.alias("status"), F.when(F.col("value") > 20, 3).when(F.col("value") > 10, 2).alias("fail_count"))
    return A.open_work(items).select("event_id")


@query("p12_runnable", """
WITH locks AS (SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM supplier WHERE s_acctbal > 0)
SELECT s_suppkey FROM supplier JOIN locks USING (s_suppkey) WHERE flag""")
def runnable(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    third = F.col("s_nationkey") % 3
    locks = supplier.filter("s_acctbal > 0").select("s_suppkey", F.when(third == 0, True).when(third == 1, False).alias("flag"))
    return A.runnable(supplier.select("s_suppkey"), locks, "s_suppkey")


@query("p12_runnable_fallback", """
SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal > 0 AND s_nationkey % 3 = 1)""")
def runnable_fallback(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    locks = supplier.filter("s_acctbal > 0 and s_nationkey % 3 = 1").select("s_suppkey", F.lit(False).alias("flag"))
    return A.runnable(supplier.select("s_suppkey"), locks, "s_suppkey")


@query("g13_upsert_timeline", """
WITH rows AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INT) AS k, event_id, event_type, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS n FROM events)
SELECT user_id, k, arg_max(event_id, n * 1000000000 + event_id) AS event_id, arg_max(event_type, n * 1000000000 + event_id) AS event_type,
  CASE WHEN arg_max(event_type, n * 1000000000 + event_id) = 'error' THEN NULL ELSE k END AS chapter_index,
  CASE WHEN arg_max(event_type, n * 1000000000 + event_id) = 'error' THEN 1000000000 ELSE k END AS place
FROM rows GROUP BY user_id, k""")
def upsert_timeline(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id", "event_type")
    rows = events.withColumn("chapter_index", F.when(F.col("event_type") != "error", F.col("k")))
    return A.upsert_timeline(rows.filter("event_type <> 'view'"), rows.filter("event_type = 'view'"), ["user_id", "k"], "event_id")


HISTORY = """
history AS (SELECT user_id, 'novel' || CAST(json_extract(props, '$.k') AS VARCHAR) AS novel_id, max(ts) AS updated_at FROM events GROUP BY 1, 2)
"""


def history(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(
        "user_id", F.concat(F.lit("novel"), F.get_json_object("props", "$.k")).alias("novel_id")).agg(F.max("ts").alias("updated_at"))


@query("k2_recent_reading", f"""
WITH {HISTORY} SELECT user_id, novel_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, novel_id) AS rank FROM history) WHERE rank <= 3""")
def recent_reading(spark, sf_dir):
    return A.recent_reading(history(spark, sf_dir), ["user_id"]).select("user_id", "novel_id", F.col("rank").cast("long").alias("rank"))


@query("j15_valid_history", f"""
WITH {HISTORY} SELECT user_id, novel_id FROM history WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def valid_history(spark, sf_dir):
    projects = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return A.valid_history(history(spark, sf_dir), projects, "user_id").select("user_id", "novel_id")


@query("k3_page", """
SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 10 OFFSET 20""")
def page(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return A.page(part, [F.col("p_name"), F.col("p_partkey")], 2)


@query("k4_progress_list", f"""
WITH t AS (SELECT o_custkey, {STATUS} AS status FROM orders)
SELECT c_name, count(*) FILTER (status = 'done') AS done, count(*) AS total FROM t JOIN customer ON o_custkey = c_custkey
GROUP BY c_name ORDER BY lower(c_name), c_name LIMIT 20""")
def progress_list(spark, sf_dir):
    per = A.progress(toc(spark, sf_dir), ["o_custkey"])
    named = per.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_name", "done", "total")
    return A.progress_list(named, "c_name")


@query("p10_search_library", """
SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_name LIMIT 10""")
def search_library(spark, sf_dir):
    return A.search_library(table(spark, sf_dir, "part").select("p_name").distinct(), "p_name", "RING")


@query("k1_chapter_order", """
SELECT name, CASE WHEN name LIKE 'Chapter%' THEN page_id END AS chapter_index FROM (
  SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 'Chapter ' || printf('%05d', page_id) || '.md' ELSE 'note ' || page_id || '.md' END AS name FROM pages)
ORDER BY chapter_index NULLS LAST, name""")
def chapter_order(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    name = F.when(F.startswith("url", F.lit("https:")), F.format_string("Chapter %05d.md", "page_id")).otherwise(
        F.concat(F.lit("note "), "page_id", F.lit(".md")))
    return A.chapter_order(pages.select(name.alias("name")), "name")


@query("p8_clean_metadata", r"""
WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1) AS title, url FROM pages)
SELECT page_id, CASE WHEN trim(split_part(id, '_', 1)) = '' THEN id ELSE trim(split_part(id, '_', 1)) END AS title_vi,
  CASE WHEN trim(author) = '' OR lower(trim(author)) IN ('unknown', 'na', 'n/a') THEN 'Unknown' ELSE trim(author) END AS author_vi,
  CASE WHEN trim(title) = '' OR regexp_matches(title, '[{}]') THEN NULL ELSE trim(regexp_replace(title, '\s+', ' ', 'g')) END AS title
FROM (SELECT *, title || '_' || regexp_extract(url, '/([a-z]+)/[0-9]+', 1) AS id,
  regexp_extract(url, '/([a-z]+)/[0-9]+', 1) AS author FROM t)""")
def clean_metadata(spark, sf_dir):
    from corpusloom.functions.html import element

    title = element(F.col("html"), "title")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", title.alias("title"),
        F.concat(title, F.lit("_"), F.regexp_extract("url", "/([a-z]+)/[0-9]+", 1)).alias("novel_id"))
    return A.clean_metadata(pages, "novel_id", ["title"]).drop("novel_id")


@query("p9_explode_genres", """
SELECT p_partkey, genre FROM (SELECT p_partkey, unnest(string_split(p_type || ' ' || p_name, ' ')) AS genre FROM part) WHERE genre <> ''""")
def explode_genres(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.replace(F.concat_ws(" ", "p_type", "p_name"), F.lit(" "), F.lit("； ")), F.lit("|,")).alias("genres"))
    return A.explode_genres(part, "genres", ["p_partkey"])


# A draft's words carry their place, so a text aligns in one way; the final text has words replaced, left out and put in.
@query("a12_mine_edits", r"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\s\x0b]+'), lambda x: x <> '') AS a FROM conversations),
e AS (SELECT conv_id, turn, unnest(range(len(a))) AS i, unnest(a) AS w FROM w),
k AS (SELECT conv_id, turn, i, w || '_' || i AS old, CASE WHEN (7 * i + turn) % 37 = 0 THEN '' WHEN (7 * i + turn) % 23 < 2 THEN 'x' || w ELSE w || '_' || i END AS new,
  CASE WHEN (i + turn) % 29 = 0 THEN '+' || i END AS more FROM e),
g AS (SELECT *, count(*) FILTER (new = old) OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM k),
s AS (SELECT string_agg(old, ' ' ORDER BY i) FILTER (new <> old) AS original,
  string_agg(concat_ws(' ', CASE WHEN new <> old THEN nullif(new, '') END, more), ' ' ORDER BY i) FILTER ((new <> old AND new <> '') OR more IS NOT NULL) AS refined
  FROM g GROUP BY conv_id, turn, n)
SELECT original, refined, count(*) AS edits, count(*) >= 2 AS proposed FROM s WHERE length(original) BETWEEN 1 AND 29 AND length(refined) BETWEEN 1 AND 29 GROUP BY 1, 2""")
def mine_edits(spark, sf_dir):
    words = S.spread(table(spark, sf_dir, "conversations")).select("turn", F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "").alias("a"))

    def final(word, i):
        by = i * 7 + F.col("turn")
        new = F.when(by % 37 == 0, "").when(by % 23 < 2, F.concat(F.lit("x"), word)).otherwise(F.concat(word, F.lit("_"), i))
        return F.concat(new, F.when((i + F.col("turn")) % 29 == 0, F.concat(F.lit(" +"), i)).otherwise(""))

    both = words.select(F.array_join(F.transform("a", lambda w, i: F.concat(w, F.lit("_"), i)), " ").alias("draft"), F.array_join(F.transform("a", final), " ").alias("final"))
    return A.mine_edits(both, "draft", "final", 2)


JOBS = """
jobs AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'queued' END AS status,
  CASE WHEN value > 20 THEN 'Just a moment' ELSE 'timeout' END AS error FROM events)
"""


def job_events(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "click", "running").when(kind == "purchase", "done").when(kind == "error", "error").otherwise("queued")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", status.alias("status"), F.when(F.col("value") > 20, "Just a moment").otherwise("timeout").alias("error"))


SETTLED = f"""
{JOBS},
last AS (SELECT user_id, status, ts, error FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM jobs) WHERE n = 1),
finish AS (SELECT user_id, max(ts) AS done_at FROM jobs WHERE status = 'done' GROUP BY 1),
started AS (SELECT user_id, max(ts) AS started_at FROM jobs WHERE status = 'running' GROUP BY 1),
errors AS (SELECT j.user_id, count(*) AS n, max(ts) AS error_at FROM jobs j LEFT JOIN finish f ON f.user_id = j.user_id
  WHERE status = 'error' AND (done_at IS NULL OR ts > done_at) GROUP BY 1),
clock AS (SELECT max(ts) + INTERVAL 1 MINUTE AS now FROM jobs),
state AS (
  SELECT l.user_id, l.status, coalesce(e.n, 0) AS attempt_count, l.error, coalesce(s.started_at, l.ts) AS started_at, now,
    CASE WHEN l.status = 'error' THEN error_at + INTERVAL 1 SECOND * CAST(least(1800 * pow(2, least(e.n, 30) - 1), 21600) AS INT) END AS retry_at
  FROM last l LEFT JOIN errors e USING (user_id) LEFT JOIN started s USING (user_id), clock)
SELECT user_id, status, attempt_count, retry_at,
  CASE WHEN status = 'running' AND date_diff('microsecond', started_at, now) >= 301000000 THEN 'queued'
    WHEN status = 'error' AND retry_at <= now AND attempt_count >= 3 AND contains(lower(error), 'just a moment') THEN 'blocked'
    WHEN status = 'error' AND retry_at <= now THEN 'queued' ELSE status END AS new_status
FROM state
"""


@query("t2_job_status", f"WITH {SETTLED}")
def job_status(spark, sf_dir):
    events = job_events(spark, sf_dir)
    state = A.attempt_state(events, "user_id")
    newest = events.agg(F.max("ts")).first()[0]  # one scalar: the clock stands a minute after the last event
    return A.settle(state, "user_id", F.lit(newest).cast("timestamp_ntz") + F.expr("INTERVAL 1 MINUTE"))


@query("t2_chapter_status", f"""
WITH t AS (SELECT o_orderkey, {STATUS} AS status, o_orderdate AS started,
  CASE WHEN o_totalprice > 400000 THEN 3 ELSE 0 END AS fail_count FROM orders)
SELECT o_orderkey, status, CASE WHEN status = 'processing' AND (started < TIMESTAMP '1999-06-01 00:00:00') THEN 'pending'
  WHEN status = 'pending' AND fail_count >= 3 THEN 'blocked' ELSE status END AS new_status FROM t""")
def chapter_status(spark, sf_dir):
    rows = toc(spark, sf_dir).select(
        "o_orderkey", "status", F.col("o_orderdate").alias("processing_started_at"),
        F.when(F.col("o_totalprice") > 400000, 3).otherwise(0).alias("fail_count"))
    now = F.expr("timestamp_ntz '1999-06-01 00:59:59'")
    return A.settle_chapters(rows, now).select("o_orderkey", "status", "new_status")
