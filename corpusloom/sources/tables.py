"""Reading and writing: corpora, knowledge tables, status JSON, page bytes, source lists, catalogs."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.html import BLOCK_PATTERN, ANY_TAG, drop_comments, drop_elements, unescape, SKIP_TAGS
from corpusloom.functions.text import elements, split_lines, strip, url_unquote

# --- fixed values ---------------------------------------------------------------------------------------------
CORPUS_GLOB = "*.{txt,html,htm,xhtml,md}"
EXCLUDED_SOURCES = ("cedict", "babylon")
CHARSET_HEAD_BYTES = 4096
GB_FAMILY = ("gb2312", "gbk", "gb18030")
OTHER_CHARSETS = ("big5", "shift_jis", "euc-kr", "iso-8859-1", "windows-1252")
# --- end of fixed values --------------------------------------------------------------------------------------


def spread(df: DataFrame) -> DataFrame:
    """On one machine: deal out the rows of a table that arrives in fewer pieces than there are cores.

    A text table written as one row group is read by one task, which would then do all the row-wise work alone. On a
    cluster nothing is moved; there, tables are written in row groups that tasks can share.
    """
    if not df.sparkSession.sparkContext.master.startswith("local["):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_corpus_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (novel_id, suffix, text). Bad bytes become the replacement character."""
    return named_texts(spark.read.option("pathGlobFilter", CORPUS_GLOB).option("recursiveFileLookup", "true").text(path, wholetext=True))


def named_texts(files: DataFrame) -> DataFrame:
    """Whole files, of a table or a stream, as (novel_id, suffix, text)."""
    return files.withColumn("_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)).select(
        F.regexp_replace(F.expr("url_decode(replace(_file, '+', '%2B'))"), r"\.[^.]*$", "").alias("novel_id"),
        F.lower(F.regexp_extract("_file", r"\.([^.]*)$", 1)).alias("suffix"),
        F.col("value").alias("text"),
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (novel_id, line_no, line); HTML is flattened first."""
    return text_lines(plain_texts(read_corpus_texts(spark, path)), "novel_id")


def plain_texts(texts: DataFrame) -> DataFrame:
    """(novel_id, suffix, text) with the text of HTML files flattened."""
    plain = F.when(F.col("suffix").isin("html", "htm", "xhtml"), flatten_html(F.col("text"))).otherwise(F.col("text"))
    return texts.withColumn("text", plain)


def text_lines(docs: DataFrame, key: str = "novel_id", text: str = "text") -> DataFrame:
    """Numbered lines of whole texts. Row-wise: no shuffle."""
    return docs.select(key, F.posexplode(split_lines(F.col(text))).alias("_pos", "line")).select(
        key, (F.col("_pos") + 1).cast("long").alias("line_no"), "line"
    )


def flatten_html(html: Column) -> Column:
    """HTML to plain text: skipped elements out, block tags to line breaks, other tags away, references decoded."""
    body = drop_elements(drop_comments(html), SKIP_TAGS)
    broken = F.regexp_replace(body, BLOCK_PATTERN, "\n")
    return unescape(F.regexp_replace(broken, ANY_TAG, ""))


def html_to_lines(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return text_lines(pages.withColumn("_text", flatten_html(F.col(html))), key, "_text")


def load_lexicon(nodes: DataFrame, translations: DataFrame, excluded=EXCLUDED_SOURCES) -> DataFrame:
    """Active translations of every node without the excluded glossary sources (an unknown source is dropped too)."""
    usable = translations.filter(F.col("is_active") & ~F.col("source_dict").isin(*excluded))
    return nodes.join(usable, nodes["id"] == usable["node_id"]).select(
        "key", F.col("vietnamese").alias("target"), "type", "pos", "priority", "source_dict", "tier", "scope"
    )


def load_lexicon_path(spark: SparkSession, path: str) -> DataFrame:
    return load_lexicon(spark.read.parquet(f"{path}/kb_node"), spark.read.parquet(f"{path}/kb_node_translation"))


def load_layer(entries: DataFrame, layer: str, scope: str | None = None) -> DataFrame:
    """A (key, target, pos, type) table as one lexicon layer."""
    return entries.select(
        F.lit(layer).alias("layer"), F.lit(scope).cast("string").alias("scope"), "key", "target", "pos", "type"
    )


def load_layer_path(spark: SparkSession, path: str, layer: str, scope: str | None = None) -> DataFrame:
    return load_layer(spark.read.parquet(path), layer, scope)


def read_status(spark: SparkSession, path: str, schema: str, items: str | None = None) -> DataFrame:
    """Status JSON files; a file that is broken or missing gives no rows. ``items`` names an array to unnest."""
    shape = f"{schema}, _bad string"
    try:
        raw = spark.read.schema(shape).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], shape)
    good = raw.filter(F.col("_bad").isNull()).drop("_bad")
    return good.select("*", F.explode_outer(items).alias("_item")).drop(items).select(
        *[c for c in good.columns if c != items], "_item.*"
    ) if items else good


def parse_status(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """The same for payloads held in a column: fields of the object next to the other columns, nulls when broken."""
    parsed = F.from_json(F.col(payload), schema, {"mode": "PERMISSIVE"})
    return df.withColumn("_parsed", parsed).select(*[c for c in df.columns if c != payload], "_parsed.*")


def read_page_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def decode_pages(pages: DataFrame, content: str = "content", header: Column | None = None) -> DataFrame:
    """Bytes to text by the declared charset (the gb family reads as gb18030), else UTF-8.

    A declared charset that does not fit the bytes falls back to UTF-8, then gb18030; UTF-8 validity decides. The session
    needs ``CHARSET_OPTIONS`` (``corpusloom.session``): gb18030 is outside the short list that Spark allows by default, and
    broken bytes shall read as replacement characters instead of failing the job.
    """
    head = F.decode(F.substring(F.col(content), 1, CHARSET_HEAD_BYTES), "ISO-8859-1")
    hints = F.concat_ws(" ", header if header is not None else F.lit(""), head)
    declared = F.lower(F.regexp_extract(hints, r"(?i)charset=[\"']?([\w\-]+)", 1))
    known = F.when(declared.isin(*GB_FAMILY), "gb18030").when(declared.isin(*OTHER_CHARSETS), declared)
    utf8 = F.is_valid_utf8(F.col(content).cast("string"))
    # A declared charset counts when it reads the bytes without a gap, or when UTF-8 does not read them either.
    clean = ~F.contains(F.expr(f"decode({content}, _known)"), F.lit("\ufffd"))
    charset = F.when(F.col("_known").isNotNull() & (clean | ~F.col("_utf8")), F.col("_known")).when(
        F.col("_utf8"), "UTF-8").otherwise("gb18030")
    tagged = pages.withColumn("_known", known).withColumn("_utf8", utf8).withColumn("charset", charset)
    return tagged.withColumn("html", F.expr(f"decode({content}, charset)")).drop(content, "_known", "_utf8")


def import_sources(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Source records of list files: an array, an object with ``bookSources`` or ``sources``, or one single object.

    Records without an address are dropped. The record itself is kept as a variant.
    """
    raw = strip(F.regexp_replace(F.col(payload), r"^\x{FEFF}", ""))

    def records(data):
        # One of the list forms, else the value itself; only records with an address count.
        items = F.coalesce(
            F.try_variant_get(data, "$", "array<variant>"), F.try_variant_get(data, "$.bookSources", "array<variant>"),
            F.try_variant_get(data, "$.sources", "array<variant>"), F.array(data))
        return F.filter(items, lambda v: F.length(strip(F.try_variant_get(v, "$.bookSourceUrl", "string"))) > 0)

    def sources(text):
        # Bound by a one-element transform, so the text is parsed once.
        return F.get(F.transform(F.array(F.try_parse_json(text)), records), F.lit(0))

    keep = [c for c in payloads.columns if c != payload]
    whole = payloads.select(*keep, raw.alias("_raw")).withColumn("_items", sources(F.col("_raw")))
    plain = whole.select(*keep, F.explode(elements(F.col("_items"))).alias("raw"))
    # The second look is only for texts that name sources without being a list themselves.
    other = whole.filter(F.col("_raw").rlike("bookSource|sources") & (F.size("_items") == 0)).select(
        *keep, F.array(F.col("_raw"), unescape(F.col("_raw")), url_unquote(F.col("_raw"))).alias("_texts"))
    tried = other.withColumn("_texts", F.flatten(F.transform("_texts", lambda t: F.array(
        t, F.regexp_extract(t, r"(?s)(\[\s*\{.*\}\s*\])", 1), F.regexp_extract(t, r"(?s)(\{.*\})", 1)))))
    found = tried.select(*keep, F.explode(F.get(F.filter(
        F.transform("_texts", sources), lambda x: F.size(x) > 0), F.lit(0))).alias("raw"))
    exploded = plain.unionByName(found)
    return exploded.select(
        *[c for c in exploded.columns if c != "raw"],
        F.try_variant_get("raw", "$.bookSourceUrl", "string").alias("source_url"),
        F.try_variant_get("raw", "$.bookSourceName", "string").alias("source_name"),
        "raw",
    )


def write_table(df: DataFrame, path: str, *partition: str) -> None:
    """Replace the touched partitions only; untouched ones stay."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def _snapshots(spark: SparkSession, path: str):
    """File system of the table, its folder of snapshots and their numbers, in order."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_snapshots")
    files = folder.getFileSystem(context)
    names = [f.getPath().getName() for f in files.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "*.json")) or []]
    return files, folder, sorted(int(n.removesuffix(".json")) for n in names)


def _listed(spark: SparkSession, path: str, number: int) -> dict[str, str]:
    return json.loads(spark.read.text(f"{path}/_snapshots/{number}.json", wholetext=True).first()[0])


def write_snapshot(df: DataFrame, path: str, *partition: str) -> int:
    """Replace the touched partitions (the table, if it has none) in one step; returns the number of the new snapshot.

    Files go to folders of their own, and a list of the folders that make up the table is put in place by renaming one
    file, so readers see the old table or the new one. A failed write leaves files that no list names. No rows touch no
    partition. For one writer at a time: a second one that ends later fails and changes nothing.
    """
    spark = df.sparkSession
    files, folder, numbers = _snapshots(spark, path)
    number = numbers[-1] + 1 if numbers else 1
    listed = _listed(spark, path, numbers[-1]) if numbers else {}
    token = f"s{number}-{uuid.uuid4().hex[:12]}"
    df.withColumn("_snapshot", F.lit(token)).write.mode("append").partitionBy(*partition, "_snapshot").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for found in files.globStatus(hadoop.Path("/".join([path, *["*"] * len(partition), f"_snapshot={token}"]))) or []:
        parts = found.getPath().toString().split("/")[-1 - len(partition):]
        listed["/".join(parts[:-1])] = "/".join(parts)
    draft, final = hadoop.Path(folder, f".{token}"), hadoop.Path(folder, f"{number}.json")
    out = files.create(draft)
    out.write(bytearray(json.dumps(listed), "utf-8"))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        raise RuntimeError(f"snapshot {number} of {path} was written by another job")
    return number


def read_snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as of a snapshot, the last one when None; later replacements do not reach the rows read."""
    last = _snapshots(spark, path)[2]
    if not last:
        raise FileNotFoundError(f"no snapshot below {path}")
    listed = _listed(spark, path, number or last[-1])
    return spark.read.option("basePath", path).parquet(*[f"{path}/{p}" for p in sorted(listed.values())]).drop("_snapshot")


def write_catalog(parts: DataFrame, path: str) -> None:
    """Nested catalog rows as JSON lines."""
    parts.write.mode("overwrite").json(path)
