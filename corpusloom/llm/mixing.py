"""Mixing sources to target weights by weighted fair queueing.

Sources in code point order, null last, weigh 5, 2, 1 and so on in turn and share the words of all documents. A target
stops at ``most`` (3) times the words of its source; what is over is shared again by weight until no target is above.

Within a source the documents are shuffled by a hash of their id. Copy k of a document finishes at virtual time
(k * source words + words up to and with the document) / target; every source moves at the same virtual speed. All
copies are put in the order of that time over all sources, and the mix ends where the words reach the total. Documents
are taken whole, so a source misses its target by about one document; copies beyond ``most`` do not exist.

Running sums never put a hot source, or all rows, in one task: rows are cut into cells by the order's own value, cells
are summed first, and rows are added up inside their cell; see ``corpusloom.functions.keyed``. Texts are not moved.

Cases: a null or blank text has size 0 and is never taken; a source without words has target 0; rows that repeat an id
are documents of their own; a null id is a document like others; no words at all, or no rows, give targets of 0 and no
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.keyed import running_total
from corpusloom.llm.common import count_words
from corpusloom.session import checkpointed

#: Cells of an order: rows of one cell are added up in one task.
CELLS = 4096


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) from rows (source, size): one row for each source."""
    spark = sized.sparkSession
    sums = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("source_size")).sort(F.asc_nulls_last("source")))
    placed = sums.rdd.zipWithIndex().map(lambda r: (r[0]["source"], r[0]["source_size"], r[1]))
    shares = F.array(*[F.lit(float(w)) for w in weights])
    state = checkpointed(
        spark.createDataFrame(placed, "source string, source_size long, place long")
        .withColumn("weight", F.element_at(shares, (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("capped", F.col("source_size") == 0))
    limit = F.col("source_size") * F.lit(most)
    while True:
        row = state.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(F.col("capped"), limit)).alias("held"),
            F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("weights")).first()
        rest = (row["total"] or 0) - (row["held"] or 0)
        # The product comes before the division, as one would write it by hand.
        fair = F.lit(float(rest)) * F.col("weight") / F.lit(float(row["weights"] or 1))
        target = F.when(F.col("capped"), limit.cast("double")).otherwise(fair)
        now = state.withColumn("target", target)
        over = now.filter(~F.col("capped") & (F.col("target") > limit)).select("place")
        if over.isEmpty():
            return now.select("source", "source_size", "target")
        state = checkpointed(now.withColumn("capped", F.col("capped") | (F.col("target") > limit)).drop("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """Per document row: its size, the size and target of its source, and ``taken``, the words that the mix takes."""
    rows = checkpointed(docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
        count_words(F.col(text_col)).alias("size")))
    targets = checkpointed(source_targets(rows, weights, most))
    total = rows.agg(F.sum("size")).first()[0] or 0
    # Rows that repeat an id are told apart by their order only; which one comes first changes nothing.
    order = F.xxhash64(F.coalesce("id", F.lit(-1)), F.lit(seed))
    keyed = rows.withColumn("order", order).withColumn("source_key", F.struct(F.col("source")))
    queued = running_total(
        keyed, ["source_key"], [F.col("order"), F.col("id"), F.col("size")],
        F.floor(F.col("order") / F.lit(float(2**64 // CELLS))), F.col("size"), "upto")
    joined = queued.alias("q").join(targets.alias("t"), F.expr("q.source <=> t.source"))
    timed = joined.select("q.id", "q.source", "q.size", "q.order", "t.source_size", "t.target", "q.upto").withColumn(
        "no", F.monotonically_increasing_id())
    wanted = checkpointed(timed)
    epochs = F.least(F.lit(most), F.ceil(F.col("target") / F.col("source_size") + 0.5).cast("int"))
    copies = wanted.filter("size > 0 AND target > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), epochs - 1))).withColumn(
        "finish", (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target")).select(
        "no", "order", "size", "epoch", "finish", F.lit(0).alias("all"))
    lined_up = running_total(
        copies, ["all"], [F.col("finish"), F.col("order"), F.col("no"), F.col("epoch")],
        F.floor(F.col("finish") * F.lit(CELLS)), F.col("size"), "words")
    taken = lined_up.filter(F.col("words") <= total).groupBy("no").agg(F.sum("size").alias("taken"))
    return wanted.join(taken, "no", "left").select(
        F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("source").alias("source"))
