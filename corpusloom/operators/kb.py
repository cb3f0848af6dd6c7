"""Knowledge-base consolidation: nodes, translations, attributes, edges, upserts and change rows.

There is no row-level update on plain files: every upsert is old + new, ranked per key, written back by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.keyed import top_per_key
from corpusloom.functions.text import LATIN, strip

# --- fixed values ---------------------------------------------------------------------------------------------
ENTITY_TYPES = {"person": "character", "organization": "sect"}
DEFAULT_TYPE = "term"
ATTRIBUTES = ("aliases", "description", "status")
EMPTY_ALIASES = "[]"
PROMOTION_SCORE = 3.0
OPEN_JOB_STATES = ("queued", "running")
CHANGES = ("create", "update", "delete")
# --- end of fixed values --------------------------------------------------------------------------------------


def node_type(entity_type: Column) -> Column:
    mapped = entity_type
    for old, new in ENTITY_TYPES.items():
        mapped = F.when(entity_type == old, new).otherwise(mapped)
    return F.coalesce(mapped, F.lit(DEFAULT_TYPE))


def node_id(key: Column) -> Column:
    """Id of a node, the same on every run: a 64-bit hash of its key."""
    return F.xxhash64(key)


def build_nodes(term: DataFrame, entity: DataFrame) -> DataFrame:
    """One node per key. Terms win over entities; inside a table the lowest tier, then scope, comes first."""
    rows = term.select(F.col("source").alias("key"), F.lit(DEFAULT_TYPE).alias("type"), "tier", "scope",
                       F.lit(0).alias("_rank")).unionByName(
        entity.select(F.col("source").alias("key"), node_type(F.col("entity_type")).alias("type"), "tier", "scope",
                      F.lit(1).alias("_rank")))
    first = F.min(F.struct("_rank", "tier", F.col("scope"), F.col("type"))).alias("_f")
    return rows.groupBy("key").agg(first).select(
        node_id(F.col("key")).alias("id"), "key", "_f.type", "_f.tier", "_f.scope")


def override_type(node: DataFrame, entity: DataFrame) -> DataFrame:
    """Type of a node replaced by the type of its entity; the entity with the highest tier, then lowest id, decides."""
    best = entity.groupBy(F.col("source").alias("key")).agg(
        F.min_by(node_type(F.col("entity_type")), F.struct(-F.col("tier"), F.col("id"))).alias("_type"))
    return node.join(best, "key", "left").withColumn("type", F.coalesce("_type", "type")).drop("_type")


def node_translations(term: DataFrame, node: DataFrame) -> DataFrame:
    """Translations attached to their node."""
    return term.join(node.select("key", F.col("id").alias("node_id")), term["source"] == node["key"]).select(
        "node_id", F.col("target").alias("vietnamese"), "confidence", "priority", "pos", "context_marker",
        F.col("type").alias("source_dict"))


def node_attributes(entity: DataFrame, node: DataFrame) -> DataFrame:
    """Attribute columns as long rows, empty ones dropped, first per (node, attribute) by entity id."""
    long = entity.unpivot(["id", "source"], list(ATTRIBUTES), "attr_key", "attr_value").filter(
        F.col("attr_value").isNotNull() & (F.col("attr_value") != "")
        & ~((F.col("attr_key") == ATTRIBUTES[0]) & (F.col("attr_value") == EMPTY_ALIASES)))
    # The node key is unique, so the reduction can run before the join and shrink it.
    first = long.groupBy("source", "attr_key").agg(F.min_by("attr_value", "id").alias("attr_value"))
    return first.join(node.select("key", F.col("id").alias("node_id")), first["source"] == node["key"]).select(
        "node_id", "attr_key", "attr_value")


def remap_edges(edge: DataFrame, entity: DataFrame, node: DataFrame) -> DataFrame:
    """Edges between entities become edges between nodes."""
    ids = entity.select(F.col("id").alias("_entity"), "source").join(
        node.select("key", F.col("id").alias("_node")), F.col("source") == F.col("key")).select("_entity", "_node")
    left = ids.select(F.col("_entity").alias("from_id"), F.col("_node").alias("source_id"))
    right = ids.select(F.col("_entity").alias("to_id"), F.col("_node").alias("target_id"))
    return edge.join(left, "from_id").join(right, "to_id").select(
        "source_id", "target_id", F.col("relation").alias("relationship"),
        F.coalesce("weight", F.lit(1.0)).alias("confidence"))


def prefix_table(lexicon: DataFrame, key: str = "key") -> DataFrame:
    """Longest key per first character, over all layers of the lexicon."""
    return lexicon.groupBy(F.substring(key, 1, 1).alias("head")).agg(F.max(F.length(key)).cast("long").alias("max_len"))


def reading_map(*ranked: DataFrame) -> DataFrame:
    """(key, value) tables merged, a later table overriding the earlier ones."""
    rows = None
    for rank, source in enumerate(ranked):
        tagged = source.filter(F.col("value").isNotNull() & (F.col("value") != "")).withColumn("_rank", F.lit(rank))
        rows = tagged if rows is None else rows.unionByName(tagged)
    return rows.groupBy("key").agg(F.max_by("value", F.struct("_rank", "value")).alias("value"))


def catalog_append(old: DataFrame, new: DataFrame, status: DataFrame | None = None, order: str = "change_no") -> DataFrame:
    """Old and new catalog rows; ``status`` (id, status, ``order``) sets the state of known ids, the last change of each."""
    rows = old.unionByName(new)
    if status is None:
        return rows
    change = status.groupBy("id").agg(F.max_by("status", F.struct(order, "status")).alias("_status"))
    return rows.join(change, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def add_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges kept once per (source, target, relationship); blank ends or names are dropped."""
    clean = new.select(*[strip(F.col(c)).alias(c) for c in ("source", "target", "relationship")]).filter(
        (F.col("source") != "") & (F.col("target") != "") & (F.col("relationship") != ""))
    return old.select("source", "target", "relationship").unionByName(clean).distinct()


def set_terms(entries: DataFrame, edits: DataFrame, key: list[str], order: str = "edit_no") -> DataFrame:
    """Dictionary after the edits: the last edit of a key wins, unknown keys are added."""
    rows = entries.withColumn(order, F.lit(-1).cast(edits.schema[order].dataType)).unionByName(edits)
    values = [c for c in rows.columns if c not in (*key, order)]
    last = F.max_by(F.struct(*values), F.struct(F.col(order), *values)).alias("_v")
    return rows.groupBy(*key).agg(last).select(*key, "_v.*")


def update_targets(entries: DataFrame, edits: DataFrame, key: list[str], order: str = "edit_no") -> DataFrame:
    """Targeted update: known keys take the last edited target, unknown keys are ignored."""
    last = edits.groupBy(*key).agg(F.max_by("target", F.struct(order, "target")).alias("_target"))
    return entries.join(last, key, "left").withColumn("target", F.coalesce("_target", "target")).drop("_target")


def append_entities(old: DataFrame, new: DataFrame, need: list[str]) -> DataFrame:
    """Entity log append; rows without the needed fields are dropped on both sides."""
    rows = old.unionByName(new)
    for name in need:
        rows = rows.filter(F.coalesce(strip(F.col(name).cast("string")), F.lit("")) != "")
    return rows


def enqueue(open_jobs: DataFrame, requests: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Requests that become jobs: no open job of the novel, and the first request of the novel only."""
    waiting = open_jobs.filter(F.col("status").isin(*OPEN_JOB_STATES)).select(key).distinct()
    return top_per_key(requests.join(waiting, key, "left_anti"), [key], order, 1)


def edge_changes(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Change rows between two edge snapshots: create, update, delete with the old and new relation."""
    b = before.select(*key, F.col(value).alias("old_relation"), F.lit(True).alias("_b"))
    a = after.select(*key, F.col(value).alias("new_relation"), F.lit(True).alias("_a"))
    action = (
        F.when(F.col("_b").isNull(), CHANGES[0])
        .when(F.col("_a").isNull(), CHANGES[2])
        .when(~F.col("old_relation").eqNullSafe(F.col("new_relation")), CHANGES[1])
    )
    return b.join(a, key, "full").withColumn("action", action).filter(F.col("action").isNotNull()).select(
        *key, "action", "old_relation", "new_relation")


def copy_dims(spark: SparkSession, tables: dict[str, DataFrame], path: str, columns: dict[str, list[str]]) -> dict[str, str]:
    """One-to-one copies of dimension tables into the knowledge base."""
    out = {}
    for name, frame in tables.items():
        out[name] = f"{path}/{name}"
        frame.select(*columns.get(name, frame.columns)).write.mode("overwrite").parquet(out[name])
    return out


def promote_candidates(mentions: DataFrame, entries: DataFrame, threshold: float = PROMOTION_SCORE) -> DataFrame:
    """Candidates (raw, target, type) with their sighting score and status.

    Approved from the threshold on unless the key already has an entry (rejected); an entry with a Latin target is
    never displaced by a non-Latin one, and a sighting equal to the entry is no candidate.
    """
    rows = mentions.select(*[strip(F.col(c)).alias(c) for c in ("raw", "target", "type")]).filter(
        (F.col("raw") != "") & (F.col("target") != ""))
    scored = rows.groupBy("raw", "target", "type").agg(F.count("*").cast("double").alias("score"))
    known = entries.select(F.col("key").alias("raw"), "type", F.col("target").alias("_known"))
    joined = scored.join(known, ["raw", "type"], "left")
    kept = joined.filter(
        F.col("_known").isNull()
        | ((F.col("_known") != F.col("target")) & ~(F.col("_known").rlike(LATIN) & ~F.col("target").rlike(LATIN))))
    # Several targets of one key: the best score is entered first, the others then meet an existing key.
    best = kept.groupBy("raw", "type").agg(
        F.max_by("target", F.struct("score", F.col("target"))).alias("_best"))
    status = (
        F.when(F.col("score") < threshold, "pending")
        .when(F.col("_known").isNotNull() | (F.col("_best") != F.col("target")), "rejected")
        .otherwise("approved")
    )
    return kept.join(best, ["raw", "type"]).withColumn("status", status).select(
        "raw", "target", "type", "score", "status")
