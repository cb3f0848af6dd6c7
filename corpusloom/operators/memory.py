"""Translation memory: exact-text lookup, build, upsert and hit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

# --- fixed values ---------------------------------------------------------------------------------------------
MIN_RAW_LENGTH = 5
SET_BY_WRITE = ("confidence", "reviewed")
# --- end of fixed values --------------------------------------------------------------------------------------


def raw_hash(text: Column) -> Column:
    """Key of the memory: MD5 of the stripped text."""
    return F.md5(strip(text))


def tm_lookup(segments: DataFrame, tm: DataFrame, text: str = "text", scope: str = "scope") -> DataFrame:
    """Segments with the remembered translation, the row of the own project first, else any project's row.

    The memory is reduced to one row per (hash, project) and one per hash first, so no join multiplies rows however many
    copies of a text exist. Only distinct hashes are looked up; the segments then meet what was found in one join.
    """
    rank = F.struct(F.coalesce("project_scope", F.lit("")), F.col("translated_text"))
    own = tm.filter(F.col("project_scope").isNotNull()).groupBy(
        "raw_hash", F.col("project_scope").alias(scope)).agg(F.min("translated_text").alias("_own"))
    anyone = tm.groupBy("raw_hash").agg(F.min_by("translated_text", rank).alias("_any"))
    keyed = segments.withColumn("raw_hash", raw_hash(F.col(text)))
    found = keyed.select("raw_hash", scope).distinct().join(anyone, "raw_hash").join(own, ["raw_hash", scope], "left").select(
        F.col("raw_hash").alias("_hash"), F.col(scope).alias("_scope"), "_own", "_any")
    return (
        keyed.join(found, (F.col("raw_hash") == F.col("_hash")) & F.col(scope).eqNullSafe(F.col("_scope")), "left")
        .withColumn("translated_text", F.coalesce("_own", "_any"))
        .withColumn("match", F.when(F.col("_own").isNotNull(), "project").when(F.col("_any").isNotNull(), "any"))
        .drop("_hash", "_scope", "_own", "_any")
    )


def tm_from_segments(context: DataFrame, order: list[Column]) -> DataFrame:
    """Memory rows from old segments, the first per hash kept."""
    values = [c for c in context.columns if c != "source_hash"]
    first = F.min_by(F.struct(*values), F.struct(*order)).alias("_v")
    return context.groupBy("source_hash").agg(first).select(F.col("source_hash").alias("raw_hash"), "_v.*")


def memory_pairs(aligned: DataFrame, scope: Column, raw: str = "raw_text", refined: str = "refined_translation",
                 at: str = "seen_at") -> DataFrame:
    """Aligned pairs worth remembering: source longer than the minimum, translation not empty."""
    return aligned.filter((F.length(raw) > MIN_RAW_LENGTH) & (F.col(refined) != "")).select(
        raw_hash(F.col(raw)).alias("raw_hash"), strip(F.col(raw)).alias("raw_text"),
        strip(F.col(refined)).alias("translated_text"), scope.alias("project_scope"), F.col(at))


def tm_upsert(tm: DataFrame, new: DataFrame, at: str = "seen_at") -> DataFrame:
    """Memory after saving ``new``: the last write sets the translation, project, ``confidence`` and ``reviewed``; chapter
    and birth stay.

    Both tables: (raw_hash, raw_text, translated_text, project_scope, chapter_index, hit_count, seen_at), ``confidence``
    and ``reviewed`` where a table has them. One grouped pass with map-side combine; ``first_at`` and ``last_at`` span the
    writes.
    """
    rows = tm.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    oldest = F.struct("_new", at, "translated_text")
    newest = F.struct("_new", at, "translated_text")
    return rows.groupBy("raw_hash").agg(
        F.min_by("raw_text", oldest).alias("raw_text"),
        F.max_by("translated_text", newest).alias("translated_text"),
        F.max_by("project_scope", newest).alias("project_scope"),
        *[F.max_by(name, newest).alias(name) for name in SET_BY_WRITE if name in rows.columns],
        F.min_by("chapter_index", oldest).alias("chapter_index"),
        F.coalesce(F.min_by("hit_count", oldest), F.lit(1)).cast("long").alias("hit_count"),
        F.min_by(F.col(at), oldest).alias("first_at"),
        F.max_by(F.col(at), newest).alias("last_at"),
    )


def tm_hits(segments: DataFrame, tm: DataFrame, text: str = "text", at: str | None = None) -> DataFrame:
    """Hits per remembered hash and the time of the last one. Segments are counted per hash before the join."""
    last = F.max(at).alias("last_used_at") if at else F.lit(None).cast("timestamp").alias("last_used_at")
    used = segments.withColumn("raw_hash", raw_hash(F.col(text))).groupBy("raw_hash").agg(
        F.count("*").alias("hits"), last)
    return tm.select("raw_hash").distinct().join(used, "raw_hash", "left").withColumn(
        "hits", F.coalesce("hits", F.lit(0)))


def tm_hit_rate(segments: DataFrame, tm: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Share of segments found in the memory per group."""
    known = tm.select("raw_hash").distinct().withColumn("_hit", F.lit(1))
    counted = segments.withColumn("raw_hash", raw_hash(F.col(text))).groupBy(*keys, "raw_hash").agg(
        F.count("*").alias("_n"))
    return counted.join(known, "raw_hash", "left").groupBy(*keys).agg(
        F.sum("_n").alias("segments"), F.coalesce(F.sum(F.col("_n") * F.col("_hit")), F.lit(0)).alias("hits"),
    ).withColumn("hit_rate", F.round(F.col("hits") / F.col("segments"), 4))
