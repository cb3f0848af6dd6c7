"""Merkle manifest of a dataset by slot pivots: leaves, one tree for each source, one over the sources, a proof for each row.

A leaf is the SHA-256 of a row's columns; the leaves of a source stand in the order of their ids. Level by level every
``FANOUT`` neighbours become one node: conditional aggregates spread a parent's children into the columns c0, c1, c2, the
columns end to end are hashed to the parent, and the columns without a child's own are the child's siblings. The roots
of the sources are the leaves of one more tree. Digests are lower-case hex and are hashed as that text.

How it spreads: texts are read once and never move, only ids and digests do. A level is one aggregation by (source,
parent), which has at most ``FANOUT`` rows in a group, so a hot source is dealt out like any other; levels shrink
by ``FANOUT`` and are checkpointed. Places come from one global sort by range: a row's place is its place in its sorted
partition less the place where its source starts there, plus what earlier partitions hold of the source. Proofs are
handed down from the roots; a leaf meets its parent's siblings in an equi join, so a path moves once for three leaves.

Cases: a null column is ``-`` (an empty text is ``0:``); a null source is a source of its own and the first; rows with a
null id come first in their source and are never tampered with; rows that repeat an id are leaves of their own, ordered by
their digests; a lone leaf is its source's root and a lone source's root is the root, both with no siblings; an empty
table has no rows. Columns besides the hashed ones are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import checkpointed

FANOUT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def _field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def ranked(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``place``, their 0-based place by ``order`` among the rows of their (non-null) key, and ``n``, how many these are.

    Rows that ``order`` does not tell apart get their places in any order, and are still dealt out over the tasks.
    """
    lined = checkpointed(rows.withColumn("_no", F.monotonically_increasing_id()).sort(key, *order, "_no").drop("_no"))
    number = F.monotonically_increasing_id()
    lined = lined.withColumn("_part", F.shiftright(number, 33)).withColumn("_at", number.bitwiseAND(F.lit((1 << 33) - 1)))
    runs = lined.groupBy("_part", key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "_part", key, (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_size").over(whole).alias("n"))
    return lined.join(starts, ["_part", key]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _ceil(n: Column) -> Column:
    return F.floor((n + (FANOUT - 1)) / FANOUT).cast("long")


def grown(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the trees over (key, place, n, digest) and their roots.

    A level is (key, n, parent, c0, c1, ..): the children of each parent in their slots, n of them in the key. Roots are
    (key, digest), one row for each key.
    """
    levels, roots, nodes = [], [], leaves.select("key", "place", "n", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(nodes.filter("n = 1").select("key", "digest"))
        if most <= 1:
            break
        slot = F.col("place") % FANOUT
        level = checkpointed(
            nodes.filter("n > 1").groupBy("key", "n", F.floor(F.col("place") / FANOUT).cast("long").alias("parent")).agg(
                *[F.max(F.when(slot == i, F.col("digest"))).alias(f"c{i}") for i in range(FANOUT)]))
        levels.append(level)
        nodes = level.select("key", F.col("parent").alias("place"), _ceil(F.col("n")).alias("n"),
                             _hash(*[F.col(f"c{i}") for i in range(FANOUT)]).alias("digest"))
        most = -(-most // FANOUT)
    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more)
    return levels, checkpointed(every)


def _siblings(slot: int) -> Column:
    """What stands left and right of a slot."""
    return F.struct(F.concat_ws("", *[F.col(f"c{i}") for i in range(slot)]).alias("left"),
                    F.concat_ws("", *[F.col(f"c{i}") for i in range(slot + 1, FANOUT)]).alias("right"))


def proven(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``leaves`` with ``path``: what stands left and right of the leaf and of each node above it, up to the key's root."""
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    above = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        # Where at most FANOUT nodes are left their parent is the root, which has no path of its own.
        rows = level.filter(F.col("n") <= FANOUT).withColumn("path", nothing)
        if above is not None:
            rows = rows.unionByName(level.filter(F.col("n") > FANOUT).join(above, ["key", "parent"]))
        if depth:
            child = F.explode(F.array(*[
                F.struct((F.col("parent") * FANOUT + i).alias("place"), F.col(f"c{i}").alias("digest"), _siblings(i).alias("beside"))
                for i in range(FANOUT)]))
            above = rows.select("key", "path", child.alias("child")).filter("child.digest IS NOT NULL").select(
                "key", F.col("child.place").alias("parent"), F.concat(F.array("child.beside"), "path").alias("path"))
        else:
            above = rows.drop("n")
    if above is None:
        return leaves.withColumn("path", nothing)
    slot, beside = F.col("place") % FANOUT, F.lit(None)
    for i in range(FANOUT):
        beside = F.when(slot == i, _siblings(i)).otherwise(beside)
    met = leaves.withColumn("parent", F.floor(F.col("place") / FANOUT).cast("long")).join(above, ["key", "parent"], "left")
    path = F.when(F.col("path").isNull(), nothing).otherwise(F.concat(F.array(beside), "path"))
    return met.withColumn("path", path).drop("parent", *[f"c{i}" for i in range(FANOUT)])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings along its path give."""
    return F.aggregate(path, leaf, lambda node, beside: _hash(beside["left"], node, beside["right"]))


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", source_col: str = "source",
             other: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path, other_leaf) for each row; ``path`` is its proof from the leaf to the root.

    ``other`` gives columns in another state, for instance as they came back from a copy; ``other_leaf`` is the leaf that
    they give, which ``folded`` takes along the path of the manifest.
    """
    fields = [F.col(c) for c in columns]
    changed = [(other or {}).get(c, F.col(c)) for c in columns]
    # Null comes before every text, the empty one too.
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = checkpointed(docs.select(
        F.col(id_col).alias("id"), key.alias("key"), F.sha2(F.concat(*map(_field, fields)), 256).alias("digest"),
        F.sha2(F.concat(*map(_field, changed)), 256).alias("other_leaf")))
    leaves = checkpointed(ranked(rows, "key", [F.col("id").asc_nulls_first(), F.col("digest"), F.col("other_leaf")]))
    levels, subroots = grown(leaves)
    tops = checkpointed(ranked(subroots.select(F.lit("").alias("key"), F.col("key").alias("of"), "digest"), "key", [F.col("of")]))
    top_levels, roots = grown(tops)
    sources = checkpointed(proven(tops, top_levels).join(roots.select("key", F.col("digest").alias("root")), "key").select(
        F.col("of").alias("key"), F.col("digest").alias("subroot"), F.col("path").alias("onward"), "root"))
    return proven(leaves, levels).join(sources, "key").select(
        "id", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "onward").alias("path"), "other_leaf")


def report(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of each document, and whether the proof still holds where line ends were taken out of the text.

    Documents whose id's CRC-32 is even are tampered with; a document without line ends is unchanged by that and holds.
    """
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest(docs, other={"text": text})
    proof = F.concat_ws("", F.flatten(F.transform("path", lambda x: F.array(x["left"], x["right"]))))
    again = folded(F.col("other_leaf"), F.col("path"))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"),
        again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
