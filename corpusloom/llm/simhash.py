"""SimHash near-duplicates by anchor points of a covering code.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, 3-word shingles with repeats (fewer words: the whole
sequence), XXH64 with seed 42; a bit is 1 if more than half of the hashes set it. No words: fingerprint zero.

Anchors: bits 0-22 and 23-45 are each covered by the perfect binary Golay code (covering radius 3), the other bits by
one word. A fingerprint goes to every anchor that some fingerprint within ``distance`` (2) of it has as its nearest: in
each block, code words at distance 3 + extra, with the extras of both blocks adding up to 2 at most - 61 anchors on
average. Two linked fingerprints meet at the nearest anchor of either, so no link is lost. Only distinct fingerprints
are replicated; copies never make pairs.

Per anchor, neighbours in the sorted run are compared and joined to local components, of which a star is given out (at
most one link per replica, never all pairs). An anchor with more than ``limit`` fingerprints is not compared pairwise:
its members go to a second stage, where each takes its 65 words within one bit; two fingerprints differ in at most 2
bits exactly if they share such a word, so the smallest of each word's group makes the star. Nothing is capped.

Cases: null, empty and blank texts have fingerprint zero and are linked like others; a null id stays null and does not
name a component unless all ids of the component are null; repeated rows give repeated rows; no rows give no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, documents, rows_of
from corpusloom.llm.components import components
from corpusloom.session import checkpointed

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: The binary Golay code: length, degree of the generator polynomial, the polynomial, covering radius.
LENGTH, DEGREE, GENERATOR, RADIUS = 23, 11, 0b110001110101, 3
BLOCK = np.uint64((1 << LENGTH) - 1)


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined, size, digest = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if size <= SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, size)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:size - SHINGLE + 1].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:].tolist())]
    total = np.zeros(64, np.int64)
    every = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(every), 65536):  # very long texts: a bounded block of bits at a time
        total += np.unpackbits(every[i:i + 65536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the signed form of the unsigned fingerprint."""

    def scan(batches):
        for batch in batches:
            ids, fps = [], []
            for doc, text in rows_of([batch], "id", "text"):
                ids.append(doc)
                fps.append(fingerprint(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(scan, "id long, fp long")


class Covering:
    """Nearest code words and those a few bits farther, by syndrome."""

    def __init__(self):
        remainder = []
        for bit in range(LENGTH):
            value = 1 << bit
            for high in range(LENGTH - 1, DEGREE - 1, -1):
                if value >> high & 1:
                    value ^= GENERATOR << (high - DEGREE)
            remainder.append(value)
        patterns = [
            (sum(1 << b for b in bits), max(0, weight - RADIUS))
            for weight in range(RADIUS + DISTANCE + 1) for bits in itertools.combinations(range(LENGTH), weight)
        ]
        self.remainder = np.array(remainder, np.uint64)
        pattern = np.array([p for p, _ in patterns], np.uint64)
        extra = np.array([e for _, e in patterns])
        syndrome = self.syndrome(pattern)
        self.lists = []
        for wanted in range(DISTANCE + 1):
            of = np.flatnonzero(extra == wanted)
            of = of[np.argsort(syndrome[of], kind="stable")]
            count = np.bincount(syndrome[of].astype(np.int64), minlength=1 << DEGREE)
            self.lists.append((pattern[of], np.cumsum(count) - count, count))

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        for bit in range(LENGTH):
            out ^= self.remainder[bit] * (words >> np.uint64(bit) & np.uint64(1))
        return out

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into fps and anchor of every replica."""
        parts = [fps & BLOCK, fps >> np.uint64(LENGTH) & BLOCK]
        syndromes = [self.syndrome(p).astype(np.int64) for p in parts]
        index, anchor = [], []
        for first, second in itertools.product(range(DISTANCE + 1), repeat=2):
            if first + second > DISTANCE:
                continue
            (pa_, sa, ca), (pb, sb, cb) = self.lists[first], self.lists[second]
            a, b = ca[syndromes[0]], cb[syndromes[1]]
            each = a * b
            of = np.repeat(np.arange(len(fps)), each)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            wa = parts[0][of] ^ pa_[sa[syndromes[0]][of] + nth // b[of]]
            wb = parts[1][of] ^ pb[sb[syndromes[1]][of] + nth % b[of]]
            index.append(of)
            anchor.append(wa | wb << np.uint64(LENGTH))
        return np.concatenate(index), np.concatenate(anchor)


def _replicas(fps: DataFrame) -> DataFrame:
    def replicate(batches):
        covering = Covering()
        for batch in batches:
            every = np.asarray(batch.column(0)).view(np.uint64)
            for i in range(0, len(every), 4096):
                part = every[i:i + 4096]
                index, anchor = covering.anchors(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(part[index].view(np.int64))], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(replicate, "anchor long, fp long")


def _links(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the local components of rows sorted by anchor; an anchor's rows are all here."""
    label, lag, at = np.arange(len(fp)), 1, np.arange(len(fp))
    left, right = [], []
    while True:
        at = at[at < len(fp) - lag]
        at = at[anchor[at] == anchor[at + lag]]
        if not len(at):
            break
        near = at[np.bitwise_count((fp[at] ^ fp[at + lag]).view(np.uint64)) <= DISTANCE]
        left.append(near)
        right.append(near + lag)
        lag += 1
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    while True:
        before = label.copy()
        np.minimum.at(label, b, label[a])
        np.minimum.at(label, a, label[b])
        label = label[label]
        if (label == before).all():
            break
    of = np.flatnonzero(label != np.arange(len(fp)))
    return fp[of], fp[label[of]]


def _compare(replicas: DataFrame, limit: int) -> DataFrame:
    """(a, b): links per anchor; b null: a is at an anchor with more than ``limit`` fingerprints."""

    def batch_of(a, b=None):
        b = pa.array(b) if b is not None else pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), b], ["a", "b"])

    def compare(batches):
        anchor, fp, crowded = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                anchor = np.concatenate((anchor, np.asarray(batch.column(0))))
                fp = np.concatenate((fp, np.asarray(batch.column(1))))
                if not len(anchor):
                    continue
                done = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            else:
                done = len(anchor)
            size = np.unique(anchor[:done], return_counts=True)
            over = np.isin(anchor[:done], size[0][size[1] > limit])
            if crowded is not None:
                over |= anchor[:done] == crowded
            if over.any():
                yield batch_of(fp[:done][over])
            a, b = _links(anchor[:done][~over], fp[:done][~over])
            if len(a):
                yield batch_of(a, b)
            anchor, fp = anchor[done:], fp[done:]
            if len(anchor) > limit:  # an open anchor is not held beyond the limit
                crowded = anchor[0]
                yield batch_of(fp)
                anchor, fp = anchor[:0], fp[:0]
            if crowded is not None and len(anchor) and anchor[0] != crowded:
                crowded = None

    dealt = replicas.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "a long, b long")


def links(fps: DataFrame, limit: int = 512) -> DataFrame:
    """(a, b): links that join all distinct fingerprints within the distance; no all-pairs lists."""
    found = checkpointed(_compare(_replicas(fps), limit).distinct())
    crowded = found.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    near = crowded.withColumn("flip", F.explode(flips)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    least = near.groupBy("word").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    stars = near.join(least.select("word", "low"), "word").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return found.filter("b IS NOT NULL").unionByName(stars.filter("a <> b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id it is linked with."""
    found = checkpointed(fingerprints(docs, id_col, text_col))
    classes = found.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components(links(classes, limit))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return found.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole documents, the one with the smallest id of each component. Rows that share an id are one document and stay or
    go together; rows without an id stay."""
    other = near_duplicates(docs, id_col, text_col).filter(F.col(id_col) != F.col("component_id")).select(id_col)
    return docs.join(other, id_col, "left_anti").select(*docs.columns)
