"""Catalogs, progress, queues, work lists, readers and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import differences
from corpusloom.functions.keyed import position, top_per_key
from corpusloom.functions.text import strip
from corpusloom.operators.corpus import file_index

# --- fixed values ---------------------------------------------------------------------------------------------
STATES = ("queued", "running", "done", "error")
STALE_RUNNING_SECONDS = 300
STALE_CHAPTER_SECONDS = 3600
RETRY_BASE_SECONDS = 1800
RETRY_MAX_SECONDS = 21600
BLOCK_AFTER = 3
PERMANENT_MARKERS = (
    "cloudflare challenge", "không tìm thấy danh sách chương", "khong tim thay danh sach chuong", "just a moment",
    "enable javascript and cookies",
)
BAD_VALUES = ("unknown", "đang cập nhật", "dang cap nhat", "n/a", "na")
GENRE_BREAK = "[,，/|;；]"
SEARCH_LIMIT = 10
PAGE_SIZE = 10
PROGRESS_LIMIT = 20
RECENT_LIMIT = 3
ERROR_SAMPLE = 5
SITE_CAP = 20
CATALOG_PART = 1000
LAST_PLACE = 1_000_000_000
# --- end of fixed values --------------------------------------------------------------------------------------


def progress(toc: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Chapters per state and whole percent done."""
    counted = toc.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col(status) == "done").alias("done"),
        F.count_if(F.col(status) == "processing").alias("processing"),
        F.count_if(F.col(status) == "pending").alias("pending"))
    return counted.withColumn("percent", F.floor(F.col("done") * 100 / F.col("total")))


def queue_stats(jobs: DataFrame, status: str = "status") -> DataFrame:
    """Jobs per state; a job without state counts as queued, the usual states are always listed."""
    listed = jobs.sparkSession.createDataFrame([(s, 0) for s in STATES], "status string, n bigint")
    rows = jobs.groupBy(F.coalesce(F.col(status), F.lit(STATES[0])).alias("status")).agg(F.count("*").alias("n"))
    return rows.unionByName(listed).groupBy("status").agg(F.sum("n").alias("n"))


def catalog(chapters: DataFrame, keys: list[str], order: str, title: str) -> DataFrame:
    """One row per novel: chapter count, first chapter, first title."""
    return chapters.groupBy(*keys).agg(
        F.count("*").alias("chapter_count"), F.min(order).alias("first_chapter"), F.min_by(title, order).alias("first_title"))


def catalog_parts(chapters: DataFrame, keys: list[str], order: list[Column], bucket: Column, item: list[str],
                  size: int = CATALOG_PART) -> DataFrame:
    """Nested chapter lists, at most ``size`` chapters per row: (keys, part_no, chapters).

    The list of a very long novel is spread over several rows, none of which outgrows a task.
    """
    numbered = position(chapters, keys, order, bucket, "index")
    return numbered.withColumn("part_no", F.floor((F.col("index") - 1) / F.lit(size))).groupBy(*keys, "part_no").agg(
        F.array_sort(F.collect_list(F.struct("index", *item))).alias("chapters"))


def home(toc: DataFrame, keys: list[str], updated: str, status: str = "status") -> DataFrame:
    """Home catalog: completed chapters, whether the novel goes on, last update."""
    return toc.groupBy(*keys).agg(
        F.count_if(F.col(status) == "done").alias("completed_chapters"),
        (F.count_if(F.col(status) != "done") > 0).alias("ongoing"), F.max(updated).alias("updated_at"))


def crawl_errors(attempts: DataFrame, keys: list[str], order: Column, label: str, failed: Column,
                 n: int = ERROR_SAMPLE) -> DataFrame:
    """Failed chapters per novel with the first five as a sample; only the sample is collected."""
    bad = attempts.filter(failed)
    totals = attempts.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"))
    first = top_per_key(bad, keys, [order], n, "_r").groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", F.col(label).cast("string").alias("l")))), lambda s: s["l"]), "; "
    ).alias("sample"))
    return totals.filter("failed > 0").join(first, keys)


def repair_toc(files: DataFrame, toc: DataFrame, translated: DataFrame, keys: list[str], bucket_width: int = 4096) -> DataFrame:
    """Contents table rebuilt from the source files: state kept, corrected by what is really translated.

    ``files``: keys, file, file_no (order of the files). ``toc``: keys, file, status. ``translated``: keys, file.
    """
    placed = position(files, keys, [F.col("file_no"), F.col("file")], F.floor(F.col("file_no") / F.lit(bucket_width)), "_pos")
    indexed = placed.withColumn("index", F.coalesce(F.nullif(file_index(F.col("file")), F.lit(0)), F.col("_pos")))
    old = toc.groupBy(*keys, "file").agg(F.max("status").alias("_old"))
    ready = translated.withColumn("index", file_index(F.col("file"))).filter("index > 0").groupBy(*keys, "index").agg(
        F.max("file").alias("translated_file"))
    joined = indexed.join(old, [*keys, "file"], "left").join(ready, [*keys, "index"], "left")
    status = (
        F.when(F.col("translated_file").isNotNull(), "done")
        .when(F.col("_old").isin("processing", "done") | F.col("_old").isNull(), "pending")
        .otherwise(F.col("_old")))
    return joined.select(*keys, "index", "file", status.alias("status"), "translated_file")


def crawl_gaps(selected: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Selected chapters without a file."""
    return selected.join(existing.select(*keys, "index").distinct(), [*keys, "index"], "left_anti")


def resume_points(files: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Next chapter of crawls that stopped early: last file + 1, when the job's end is open or not reached."""
    last = files.groupBy(*keys).agg(F.max("index").alias("_last"))
    return jobs.join(last, keys).filter(
        (F.col("_last") > 0) & (F.col("end_chapter").isNull() | (F.col("_last") < F.col("end_chapter")))
    ).withColumn("next_chapter", F.col("_last") + 1).drop("_last")


def backlog_head(toc: DataFrame, keys: list[str], order: list[Column], most_failures: int = BLOCK_AFTER) -> DataFrame:
    """First pending chapter per project that has not failed too often."""
    waiting = toc.filter((F.col("status") == "pending") & (F.coalesce("fail_count", F.lit(0)) < most_failures))
    return top_per_key(waiting, keys, order, 1)


def open_work(items: DataFrame) -> DataFrame:
    """Work still to do: discovered or error items, and pending ones with fewer than three failures."""
    return items.filter(
        F.col("status").isin("discovered", "error")
        | ((F.col("status") == "pending") & (F.coalesce("fail_count", F.lit(0)) < BLOCK_AFTER)))


def runnable(projects: DataFrame, locks: DataFrame, key: str) -> DataFrame:
    """Projects allowed to run: with any explicit permission only those, without one all that are not refused.

    An empty permission table allows none. ``locks``: key, flag.
    """
    any_allowed = locks.agg(F.max("flag")).scalar()
    filled = locks.agg(F.count("*") > 0).scalar()
    joined = projects.join(locks.select(key, "flag"), key, "left")
    return joined.filter(filled & F.coalesce("flag", ~any_allowed, F.lit(True))).select(*projects.columns)


def cap_per_site(found: DataFrame, site: str, order: list[Column], n: int = SITE_CAP) -> DataFrame:
    """First items of each site, as many as one scan takes."""
    return top_per_key(found, [site], order, n)


def upsert_timeline(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest event per chapter; a new row replaces the old one. Adds the sort key ``place``."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    values = [c for c in rows.columns if c not in (*keys, "_new")]
    best = F.max_by(F.struct(*values), F.struct("_new", order)).alias("_v")
    return rows.groupBy(*keys).agg(best).select(*keys, "_v.*").withColumn(
        "place", F.coalesce(F.col("chapter_index").cast("long"), F.lit(LAST_PLACE)))


def recent_reading(history: DataFrame, user: list[str], n: int = RECENT_LIMIT) -> DataFrame:
    """Last read novels per user, newest first."""
    return top_per_key(history, user, [F.col("updated_at").desc(), F.col("novel_id")], n, "rank")


def valid_history(history: DataFrame, projects: DataFrame, key: str) -> DataFrame:
    """Reading history of projects that still exist."""
    return history.join(projects.select(key).distinct(), key, "left_semi")


def page(df: DataFrame, order: list[Column], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 0) of the ordered rows."""
    return df.orderBy(*order).offset(number * size).limit(size)


def progress_list(rows: DataFrame, name: str, n: int = PROGRESS_LIMIT) -> DataFrame:
    """First rows by name, ignoring case."""
    return rows.orderBy(F.lower(name), F.col(name)).limit(n)


def search_library(library: DataFrame, name: str, text: str, n: int = SEARCH_LIMIT) -> DataFrame:
    """First names that contain the text, ignoring case."""
    return library.filter(F.contains(F.lower(name), F.lower(F.lit(text)))).orderBy(name).limit(n)


def chapter_order(files: DataFrame, name: str) -> DataFrame:
    """Chapter files in reading order: numbered ones first by number, then by name."""
    return files.withColumn("chapter_index", file_index(F.col(name))).orderBy(
        F.col("chapter_index").asc_nulls_last(), F.col(name))


def is_bad_value(value: Column) -> Column:
    """Placeholder or broken metadata value."""
    text = strip(F.coalesce(value, F.lit("")))
    low = F.lower(text)
    return (text == "") | low.isin(*BAD_VALUES) | F.contains(low, F.lit("object object")) | text.rlike("[{}]")


def clean_metadata(df: DataFrame, novel_id: str, columns: list[str]) -> DataFrame:
    """Title and author from the novel id (``title_author``), other fields cleaned or null when placeholders."""
    parts = F.split(F.col(novel_id), "_", 2)
    title = F.coalesce(F.nullif(strip(F.get(parts, F.lit(0))), F.lit("")), F.col(novel_id))
    author = strip(F.get(parts, F.lit(1)))
    out = df.withColumn("title_vi", title).withColumn(
        "author_vi", F.when(is_bad_value(author), "Unknown").otherwise(author))
    for name in columns:
        clean = strip(F.regexp_replace(F.regexp_replace(F.col(name), "�", ""), r"(?U)\s+", " "))
        out = out.withColumn(name, F.when(~is_bad_value(F.col(name)), clean))
    return out


def explode_genres(df: DataFrame, column: str, keys: list[str], breaks: str = GENRE_BREAK) -> DataFrame:
    """Delimited or array genres as rows."""
    kind = df.schema[column].dataType.typeName()
    items = F.col(column) if kind == "array" else F.split(F.col(column), breaks)
    return df.select(*keys, F.explode(F.transform(items, strip)).alias("genre")).filter("genre <> ''")


def attempt_state(events: DataFrame, job: str, at: str = "ts", status: str = "status", tie: str = "event_id") -> DataFrame:
    """Per job: last event, start of the running attempt, errors since the last other finish.

    Two grouped passes with map-side combine; no job's events are gathered.
    """
    finished = (F.col(status) != "error") & F.col(status).isin("done", "blocked")
    stamp = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"))
    last = events.groupBy(job).agg(
        F.max_by(F.struct(F.col(status).alias("status"), F.col(at).alias("updated_at"), F.col("error").alias("error")), stamp)
        .alias("_last"),
        F.max(F.when(finished, stamp)).alias("_done"),
        F.max(F.when(F.col(status) == "running", F.col(at))).alias("started_at"))
    errors = (
        events.filter(F.col(status) == "error").join(last.select(job, "_done"), job)
        .filter(F.col("_done").isNull() | (stamp > F.col("_done")))
        .groupBy(job).agg(F.count("*").alias("attempt_count"), F.max(at).alias("_error_at")))
    return last.join(errors, job, "left").select(
        job, "_last.status", "_last.updated_at", "_last.error", "started_at",
        F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"), "_error_at")


def settle(state: DataFrame, job: str, now: Column, stale_seconds: int = STALE_RUNNING_SECONDS) -> DataFrame:
    """State of each job at ``now``: stale runs and due errors go back to the queue, hopeless errors are blocked.

    The wait after error n is min(base * 2^(n-1), maximum).
    """
    wait = F.least(F.lit(float(RETRY_BASE_SECONDS)) * F.pow(F.lit(2.0), F.least(F.col("attempt_count"), F.lit(30)) - 1),
                   F.lit(float(RETRY_MAX_SECONDS))).cast("int")
    retry_at = F.when((F.col("status") == "error"), F.timestamp_add("SECOND", wait, F.col("_error_at")))
    permanent = F.lit(False)
    for marker in PERMANENT_MARKERS:
        permanent = permanent | F.contains(F.lower(F.coalesce("error", F.lit(""))), F.lit(marker))
    due = retry_at <= now
    stale = F.timestamp_diff("SECOND", F.coalesce("started_at", "updated_at"), now) > stale_seconds
    settled = (
        F.when((F.col("status") == "running") & stale, "queued")
        .when((F.col("status") == "error") & due & (F.col("attempt_count") >= BLOCK_AFTER) & permanent, "blocked")
        .when((F.col("status") == "error") & due, "queued")
        .otherwise(F.col("status")))
    return state.withColumn("retry_at", retry_at).withColumn("new_status", settled).select(
        job, "status", "new_status", "attempt_count", "retry_at")


def settle_chapters(chapters: DataFrame, now: Column, force: bool = False,
                    stale_seconds: int = STALE_CHAPTER_SECONDS) -> DataFrame:
    """Chapters in work without a start, or for too long, go back; three failures block a chapter."""
    age = F.timestamp_diff("SECOND", F.col("processing_started_at"), now)
    stale = F.lit(force) | F.col("processing_started_at").isNull() | (age > stale_seconds)
    settled = (
        F.when((F.col("status") == "processing") & stale, "pending")
        .when((F.col("status") == "pending") & (F.coalesce("fail_count", F.lit(0)) >= BLOCK_AFTER), "blocked")
        .otherwise(F.col("status")))
    return chapters.withColumn("new_status", settled)


def kpi_terms(mentions: DataFrame) -> DataFrame:
    """New characters, new terms and the share of raw forms with a single target."""
    per_raw = mentions.groupBy("raw").agg(
        F.count_distinct("target").alias("targets"), F.max(F.col("type") == "name").alias("is_name"),
        F.max(F.col("type") != "name").alias("is_term"))
    return per_raw.agg(
        F.count_if(F.col("is_name")).alias("new_characters"), F.count_if(F.col("is_term")).alias("new_terms"),
        F.round(F.count_if(F.col("targets") == 1) / F.count("*"), 4).alias("consistency"))


def kpi_table(coverage: DataFrame, hits: DataFrame, aligned: DataFrame, mentions: DataFrame) -> DataFrame:
    """Indicators as rows (metric, value) from the small results of the other jobs.

    ``coverage``: total_units, matched_units. ``hits``: segments, hits. ``aligned``: draft, final. ``mentions``: raw,
    target, type.
    """
    share = lambda part, whole: F.round(part / whole, 4).cast("double")
    parts = [
        coverage.agg(share(F.sum("matched_units"), F.sum("total_units")).alias("graph_coverage")),
        hits.agg(share(F.sum("hits"), F.sum("segments")).alias("memory_hit_rate")),
        aligned.agg(share(F.count_if(F.col("draft") != F.col("final")), F.count("*")).alias("correction_rate")),
        kpi_terms(mentions).select(*[F.col(c).cast("double").alias(c) for c in ("new_characters", "new_terms", "consistency")]),
    ]
    out = None
    for part in parts:
        rows = part.unpivot([], part.columns, "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def mine_edits(aligned: DataFrame, draft: str, final: str, threshold: int = 3, longest: int = 30) -> DataFrame:
    """Replaced stretches of words between draft and final, short on both sides, counted; frequent pairs are proposals.

    All stretches of a pair count, wherever they stand: the words are aligned with the fewest changes inside the row.
    Pure insertions and deletions are no replacements. Meant for segments: work grows with a pair's changes squared.
    """
    words = aligned.select(*[F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "").alias(n) for c, n in ((draft, "a"), (final, "b"))])
    changed = words.filter((F.size("a") > 0) & (F.size("b") > 0)).select(
        "a", "b", F.explode(differences(F.col("a"), F.col("b"))).alias("s"))
    cut = lambda c: F.array_join(F.slice(c, F.col(f"s.{c}_from") + 1, F.col(f"s.{c}_to") - F.col(f"s.{c}_from")), " ")
    found = changed.select(cut("a").alias("original"), cut("b").alias("refined"))
    short = found.filter(F.length("original").between(1, longest - 1) & F.length("refined").between(1, longest - 1))
    return short.groupBy("original", "refined").agg(F.count("*").alias("edits")).withColumn(
        "proposed", F.col("edits") >= threshold)
