"""Line dedup by overlapping windows of three lines; DataFrame functions only.

Lines are what stands between line feeds. Every window of ``size`` consecutive lines of a document is hashed (two 64-bit
hashes, 128 bits together). Of equal windows, the one that starts first stays, by document id and then by line; every line covered
by another one goes, and the lines that are left are joined by line feeds again. Windows are judged on the input.

Hot windows are pre-aggregated to their first place before the shuffle; only windows that repeat are joined back, narrow
rows, in a join that Spark can split. Texts are moved once, to meet the spans of their document.

Cases: a null text stays null; texts of fewer than ``size`` lines have no window and stay whole, empty ones too; a
document whose lines all go keeps an empty text; rows with a null id stay whole and do not count; rows that repeat an id
and its text are one document and are cut alike; an id that comes with several texts is as many documents, of which the one
whose text has the smaller hash stands first; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, tid, line, a, b): start line and hashes of every window; ``tid`` tells the texts of an id apart."""
    lined = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("tid"), F.split(F.col(text_col).cast("string"), "\n").alias("lines")).filter(
        "id IS NOT NULL").filter(F.size("lines") >= size)
    # One hash per line, then the windows' hashes from neighbours: a line is read once, not once per window.
    hashed = lined.select(
        "id", "tid", F.transform("lines", lambda x: F.xxhash64(x, F.lit(1))).alias("x"),
        F.transform("lines", lambda x: F.xxhash64(x, F.lit(2), F.length(x))).alias("y"))

    def at(name, i):
        return [F.get(name, i + k) for k in range(size)]

    every = F.transform(
        F.sequence(F.lit(0), F.size("x") - size),
        lambda i: F.struct(i.alias("line"), F.xxhash64(*at("x", i)).alias("a"), F.xxhash64(*at("y", i)).alias("b")))
    return hashed.select("id", "tid", F.explode(every).alias("w")).select("id", "tid", "w.line", "w.a", "w.b")


def repeated_spans(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tid, starts array<int>): where the windows that occur earlier start."""
    every = windows(docs, size, id_col, text_col)
    place = F.struct("id", "tid", "line")
    firsts = every.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    later = every.join(firsts.select("a", "b", "first"), ["a", "b"]).filter(place > F.col("first"))
    return later.groupBy("id", "tid").agg(F.collect_set("line").alias("starts"))


def _kept(lines, starts, size: int):
    """The lines outside all windows; ``starts`` null: all of them. Slices between windows, so linear in the lines."""
    ordered = F.array_sort(starts)
    since = F.concat(F.array(F.lit(0)), F.transform(ordered, lambda s: s + size))
    until = F.concat(ordered, F.array(F.size(lines)))
    parts = F.zip_with(since, until, lambda a, b: F.when(b > a, F.slice(lines, a + 1, b - a)).otherwise(F.slice(lines, 1, 0)))
    return F.when(starts.isNull(), lines).otherwise(F.flatten(parts))


def dedup_lines(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text",
                length_col: str | None = None) -> DataFrame:
    """All documents with all their columns, in place of the text what is left of it; ``length_col`` (characters), if
    given, follows where lines went."""
    spans = repeated_spans(docs, size, id_col, text_col).select(F.col("id").alias("__of"), F.col("tid").alias("__tid"), F.col("starts").alias("__starts"))
    kept = _kept(F.split(F.col(text_col).cast("string"), "\n"), F.col("__starts"), size)
    joined = docs.join(spans, (F.col(id_col) == F.col("__of")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__tid")), "left")
    text = F.when(F.col("__starts").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    changed = joined.withColumn(text_col, text)
    if length_col is not None:
        length = F.when(F.col("__starts").isNull(), F.col(length_col)).otherwise(F.length(text_col))
        changed = changed.withColumn(length_col, length.cast(docs.schema[length_col].dataType))
    return changed.select(*docs.columns)


def report(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: lines, removed lines and the SHA-256 of what is left (no lines and a null digest for a null text)."""
    spans = repeated_spans(docs, size, id_col, text_col).withColumnsRenamed({"id": "of", "tid": "hash"})
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tid"), F.split(text, "\n").alias("lines"))
    joined = texts.join(spans, (F.col("id") == F.col("of")) & (F.col("tid") == F.col("hash")), "left")
    cut = joined.select("id", "lines", _kept(F.col("lines"), F.col("starts"), size).alias("kept"))
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    n_kept = F.when(F.col("lines").isNull(), 0).otherwise(F.size("kept"))
    return cut.select(
        F.col("id").alias(id_col), n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_removed"),
        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))
