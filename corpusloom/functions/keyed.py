"""Per-key ranking and running totals that stay spread out when one key holds a large share of the rows.

Two shapes are used all over the jobs:

* ``top_per_key`` keeps the first n rows of each key. Catalyst turns the rank filter into a group limit that runs
  before the shuffle, so a hot key sends at most n rows per input partition.
* ``running_total`` / ``position`` number or sum *all* rows of a key. A plain window would sort a hot key in a
  single task, so rows are cut into (key, bucket) cells by a column that follows the order; cells are summed first
  (map-side combined), the short list of cell sums gets a running total per key, and rows are then ranked inside
  their own cell only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once: behind an explode of one row the optimiser cannot put an expression
    back into every place that names it, the steps of a fold included."""
    row = F.struct(*df.columns, *[c.alias(n) for n, c in columns.items()])
    return df.select(F.explode(F.array(row)).alias("_r")).select("_r.*")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
                rank: str | None = None) -> DataFrame:
    """First ``n`` rows of every key in the given order; ``rank`` keeps the rank as a column."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, value: Column,
                  name: str) -> DataFrame:
    """Inclusive running sum of ``value`` per key. ``bucket`` must not decrease along ``order``."""
    cells = (
        df.select(*keys, bucket.alias("_bucket"), value.alias("_value"))
        .groupBy(*keys, "_bucket")
        .agg(F.sum("_value").alias("_cell"))
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *keys, "_bucket", F.sum("_cell").over(before).alias("_value"), F.lit(0).alias("_row")
    ).filter(F.col("_value").isNotNull())
    # Each cell starts with one extra row that carries the sum of the cells before it. A union needs no join: the rows
    # are shuffled once, and null keys are a key like any other.
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value).withColumn("_row", F.lit(1))
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy("_row", *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    both = rows.unionByName(offsets, allowMissingColumns=True)
    return both.withColumn(name, F.sum("_value").over(inside)).filter(F.col("_row") == 1).drop("_bucket", "_value", "_row")


def position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str) -> DataFrame:
    """1-based position of every row inside its key; ``order`` has to be total."""
    return running_total(df, keys, order, bucket, F.lit(1).cast("long"), name)


def last_n_before(rows: DataFrame, events: DataFrame, keys: Sequence[str], at: str, when: str, n: int,
                  event_order: Sequence[Column], bucket_width: int, event: Column, name: str,
                  row_key: Sequence[str]) -> DataFrame:
    """For every row the last ``n`` events of its key with ``when < at``, oldest first, as an array.

    Events get their position per key, rows get the number of events before them, and the wanted positions are
    fetched by an equi join on (key, position) - no range join and no per-key list.
    """
    bucket = F.floor(F.col("_at") / F.lit(bucket_width))
    numbered = position(
        events.withColumn("_at", F.col(when)), keys, [F.col("_at"), *event_order], bucket, "_pos"
    ).select(*keys, "_pos", event.alias("_event"))
    marks = events.select(*keys, F.col(when).alias("_at"), F.lit(1).cast("long").alias("_one")).unionByName(
        rows.select(*keys, F.col(at).alias("_at")).distinct().withColumn("_one", F.lit(0).cast("long"))
    )
    # At equal order value the row comes first, so only strictly earlier events are counted.
    counted = running_total(marks, keys, [F.col("_at"), F.col("_one")], bucket, F.col("_one"), "_seen")
    seen = counted.filter(F.col("_one") == 0).select(*keys, F.col("_at").alias(at), "_seen")
    wanted = (
        rows.select(*keys, *[k for k in row_key if k not in keys and k != at], at)
        .join(seen, [*keys, at])
        .filter(F.col("_seen") > 0)
        .withColumn("_pos", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_seen") - (n - 1)), F.col("_seen"))))
    )
    found = (
        wanted.join(numbered, [*keys, "_pos"])
        .groupBy(*row_key)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_event"))), lambda s: s["_event"]).alias(name))
    )
    return rows.join(found, list(row_key), "left")
