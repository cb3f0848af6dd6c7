"""Structured Streaming jobs. Each poll loop over files becomes a stream with a checkpoint.

Results that merge over time (job state, memory, counts) are kept as a log of per-batch partial results: a batch
writes ``batch=<id>`` and nothing else, so a retried batch replaces its own part and no state is rewritten. Readers
merge the partials with a grouped aggregate; the merge is exact for any order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import catalog as A
from corpusloom.operators import corpus as C
from corpusloom.operators import memory as M
from corpusloom.sources.tables import CORPUS_GLOB, named_texts, plain_texts

# --- fixed values ---------------------------------------------------------------------------------------------
POLL = "300 seconds"
# --- end of fixed values --------------------------------------------------------------------------------------


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream of files, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A stream starts from a folder or a pattern, so one file is named by a pattern that only it fits.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def start_log(stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
              once: bool = True, poll: str = POLL, mode: str = "append") -> StreamingQuery:
    """Run ``reduce`` on every batch and keep its result under ``path/batch=<id>``. ``mode`` is the stream's output mode."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll)).start()


def start_append(stream: DataFrame, path: str, checkpoint: str, once: bool = True, poll: str = POLL) -> StreamingQuery:
    """Append the rows of a streaming query to files."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll)).start()


def stream_corpus(spark: SparkSession, folder: str, path: str, checkpoint: str, rules=C.HEADING_RULES,
                  once: bool = True, poll: str = POLL) -> StreamingQuery:
    """New files of a folder and its sub-folders, each taken once, named and flattened as ``read_corpus`` does, split into
    chapters."""
    files = spark.readStream.option("pathGlobFilter", CORPUS_GLOB).option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return start_append(C.split_chapters(plain_texts(named_texts(files)), rules), path, checkpoint, once, poll)


def stream_chapters(texts: DataFrame, path: str, checkpoint: str, rules, key: str, once: bool = True) -> StreamingQuery:
    """Chapters of a stream of whole texts."""
    return start_append(C.split_chapters(texts, rules, key), path, checkpoint, once)


def reduce_job_events(batch: DataFrame, job: str, tie: str = "event_id") -> DataFrame:
    """The events of a batch that can still matter: all errors, and the last of every other state per job."""
    errors = batch.filter("status = 'error'")
    columns = [c for c in batch.columns if c not in (job, "status")]
    last = batch.filter("status <> 'error'").groupBy(job, "status").agg(
        F.max_by(F.struct(*columns), F.struct("ts", tie)).alias("_v")).select(job, "status", "_v.*")
    return errors.unionByName(last)


def stream_job_status(events: DataFrame, job: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep a reduced event log; ``job_status_at`` turns it into states."""
    return start_log(events, lambda batch: reduce_job_events(batch, job), path, checkpoint, once)


def job_status_at(log: DataFrame, job: str, now) -> DataFrame:
    """State of every job at ``now`` from the log: stale runs, due retries and blocked jobs included."""
    return A.settle(A.attempt_state(log, job), job, now)


def reduce_pairs(batch: DataFrame, scope: str) -> DataFrame:
    pairs = M.memory_pairs(batch, F.col(scope))
    newest = F.struct("seen_at", "translated_text", "project_scope")
    return pairs.groupBy("raw_hash").agg(
        F.min_by("raw_text", "seen_at").alias("raw_text"), F.max(newest).alias("_n"), F.min("seen_at").alias("first_at"),
        F.count("*").alias("hits")).select(
        "raw_hash", "raw_text", F.col("_n.translated_text").alias("translated_text"),
        F.col("_n.project_scope").alias("project_scope"), "first_at", F.col("_n.seen_at").alias("last_at"), "hits")


def stream_memory(pairs: DataFrame, scope: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Translation pairs (raw_text, refined_translation, seen_at, scope) into the memory log."""
    return start_log(pairs, lambda batch: reduce_pairs(batch, scope), path, checkpoint, once)


def memory_from_log(log: DataFrame) -> DataFrame:
    """Current memory: last write per hash, birth and number of sightings over all batches."""
    newest = F.struct("last_at", "translated_text", "project_scope")
    return log.groupBy("raw_hash").agg(
        F.min_by("raw_text", "first_at").alias("raw_text"), F.max(newest).alias("_n"), F.min("first_at").alias("first_at"),
        F.sum("hits").alias("hit_count")).select(
        "raw_hash", "raw_text", F.col("_n.translated_text").alias("translated_text"),
        F.col("_n.project_scope").alias("project_scope"), "first_at", F.col("_n.last_at").alias("last_at"), "hit_count")


def stream_new_urls(found: DataFrame, known: DataFrame | None, path: str, checkpoint: str, once: bool = True,
                    at: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Addresses not in the catalog, each once. With ``at`` the remembered addresses expire behind a watermark."""
    fresh = found.join(known.select("url").distinct(), "url", "left_anti") if known is not None else found
    once_each = fresh.withWatermark(at, delay).dropDuplicatesWithinWatermark(["url"]) if at else fresh.dropDuplicates(["url"])
    return start_append(once_each, path, checkpoint, once)


def stream_progress(events: DataFrame, keys: list[str], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Counts per key of every batch; ``progress_from_log`` adds them up."""
    return start_log(events, lambda batch: batch.groupBy(*keys).agg(F.count("*").alias("n")), path, checkpoint, once)


def progress_from_log(log: DataFrame, keys: list[str]) -> DataFrame:
    return log.groupBy(*keys).agg(F.sum("n").alias("n"))


def start_live(counts: DataFrame, path: str, checkpoint: str, once: bool = True, poll: str = POLL) -> StreamingQuery:
    """Running totals of a streaming aggregate in update mode, open windows included: a batch keeps the totals that it
    changed. ``live_totals`` reads them at any time."""
    return start_log(counts, lambda batch: batch, path, checkpoint, once, poll, "update")


def live_totals(log: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """The latest total of every key."""
    return log.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def hourly_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", delay: str = "10 minutes") -> DataFrame:
    """Events per hour and type: final once the hour is behind the watermark, changing before that (``start_live``)."""
    return events.withWatermark(at, delay).groupBy(F.window(at, "1 hour").alias("w"), kind).agg(
        F.count("*").alias("n")).select(F.col("w.start").alias("hour"), kind, "n")


def sessions(events: DataFrame, user: str, at: str = "ts", gap: str = "6 hours", delay: str = "10 minutes") -> DataFrame:
    """Runs of activity per user, closed after a silence of ``gap``."""
    return events.withWatermark(at, delay).groupBy(user, F.session_window(at, gap).alias("w")).agg(
        F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
