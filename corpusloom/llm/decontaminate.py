"""Benchmark decontamination: a broadcast set of normalised test n-grams is searched in the windows of every document.

Words are [0-9a-z and everything beyond ASCII]+ after lower-casing A-Z. A window is ``n`` consecutive words of an item;
an item of fewer words, but not none, is one window. Hits are found by hash and verified by the words themselves.

The broadcast is bounded: the items' windows are cut into slices of at most ``slice_windows`` windows, and the
documents are scanned once for each slice; the spans of all slices meet per document. One slice is the usual case, and
nothing is shuffled then.

Cases: a null text or one without words has no windows and is never contaminated; null or empty items are no items;
an item id that comes twice counts once; a null item id takes no part; no items or no documents give no hits or no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, covered, documents, rows_of, runs

#: Bytes that belong to words after lower-casing: 0-9, a-z and all bytes of characters beyond ASCII.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in LOWER)
FACTOR = 0x9E3779B97F4A7C15
SPANS = "id long, text_hash long, n_words int, starts array<int>, ends array<int>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _windows(batches, n):
    for item, text in rows_of(batches, "id", "text"):
        words = words_of(text)
        if item is None or not words:
            continue
        size = min(n, len(words))
        for i in range(len(words) - size + 1):
            yield b" ".join(words[i:i + size]), str(item)


def item_windows(items: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(gram binary, items array<string>): the distinct windows of all items with the items that have them."""

    def cut(batches):
        for batch in batches:
            found = list(_windows([batch], n))
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in found], pa.binary()), pa.array([i for _, i in found], pa.string())], ["gram", "item"])

    grams = documents(items, id_col, text_col).mapInArrow(cut, "gram binary, item string")
    return grams.groupBy("gram").agg(F.collect_set("item").alias("items"))


class Grams:
    """Windows as sequences of word numbers, with a hash for each length."""

    def __init__(self, grams: dict[bytes, list[str]]):
        words = sorted({w for g in grams for w in g.split(b" ")})
        self.number = {w: i + 1 for i, w in enumerate(words)}
        self.items = {tuple(self.number[w] for w in g.split(b" ")): found for g, found in grams.items()}
        self.hashes = {
            size: np.unique(np.array([self.hash(np.array(k, np.uint64), size)[0] for k in self.items if len(k) == size], np.uint64))
            for size in {len(k) for k in self.items}
        }

    @staticmethod
    def hash(numbers: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(numbers) - size + 1, np.uint64)
        for j in range(size):
            out *= np.uint64(FACTOR)
            out += numbers[j:j + len(out)]
        out ^= out >> np.uint64(29)
        return out

    def search(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Starts and ends of all verified hits, and the items found."""
        starts, ends, found, get = [], [], set(), self.number.get
        numbers = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        for size, hashes in self.hashes.items():
            if size > len(words):
                continue
            # Only windows of known words can be hits.
            known = np.concatenate(([0], np.cumsum(numbers > 0)))
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            hashed = self.hash(numbers, size)[at]
            place = np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)
            for i in at[hashes[place] == hashed].tolist():
                items = self.items.get(tuple(numbers[i:i + size].tolist()))
                if items is not None:
                    starts.append(i)
                    ends.append(i + size)
                    found.update(items)
        return starts, ends, found


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "text_hash", "n_words", "starts", "ends", "items"])


def _scan(docs: DataFrame, shared) -> DataFrame:
    def scan(batches):
        grams = Grams(shared.value)
        for batch in batches:
            out = []
            for doc, key, text in rows_of([batch], "id", "text_hash", "text"):
                words = words_of(text)
                starts, ends, found = grams.search(words)
                if starts:
                    a, b = runs(covered(len(words), starts, ends))
                    out.append((doc, key, len(words), a.tolist(), b.tolist(), sorted(found)))
                else:
                    out.append((doc, key, len(words), [], [], []))
            yield _batch(out)

    return docs.mapInArrow(scan, SPANS)


def hits(docs: DataFrame, items: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text",
         slice_windows: int = 200_000) -> DataFrame:
    """Per document row: id, text_hash, n_words, starts and ends of the hit spans in words, items (sorted as strings)."""
    spark = docs.sparkSession
    grams = item_windows(items, n)
    total = grams.count()
    slices = max(1, -(-total // slice_windows))
    texts = documents(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    parts = []
    for k in range(slices):
        chosen = grams if slices == 1 else grams.filter(F.pmod(F.xxhash64("gram"), F.lit(slices)) == k)
        shared = spark.sparkContext.broadcast({bytes(r.gram): r["items"] for r in chosen.collect()})
        parts.append(_scan(texts, shared))
    if slices == 1:
        return parts[0]
    # A row's slices meet under its id and text; only spans and item lists are moved.
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    met = every.groupBy("id", "text_hash", "n_words").agg(
        F.collect_set(F.struct("starts", "ends")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"),
        (F.count(F.lit(1)) / slices).cast("int").alias("copies"))

    def merge(batches):
        for batch in batches:
            out = []
            for doc, key, n_words, spans, found, copies in rows_of(
                    [batch], "id", "text_hash", "n_words", "spans", "items", "copies"):
                starts = [x for s in spans for x in s["starts"]]
                ends = [x for s in spans for x in s["ends"]]
                a, b = runs(covered(n_words, starts, ends))
                out += [(doc, key, n_words, a.tolist(), b.tolist(), sorted(set(found)))] * copies
            yield _batch(out)

    return met.mapInArrow(merge, SPANS)


def contamination(docs: DataFrame, items: DataFrame, n: int = 13, share: int = 20, id_col: str = "doc_id",
                  text_col: str = "text", slice_windows: int = 200_000) -> DataFrame:
    """Per document: words, hit words, items found, and whether at least 1/``share`` of its words are hit."""
    found = hits(docs, items, n, id_col, text_col, slice_windows)
    n_hit = F.aggregate(
        F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    listed = F.array_sort("items")
    return found.withColumn("n_hit", n_hit).select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        F.arrays_zip("starts", "ends").alias("spans"))


def without_contaminated(docs: DataFrame, items: DataFrame, n: int = 13, share: int = 20, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, whole and with all their columns."""
    bad = contamination(docs, items, n, share, id_col, text_col).filter("contaminated").select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
