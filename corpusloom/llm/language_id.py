"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point alone. A trigram (a, b, c) of letters is
the product of a's vector rotated twice, b's rotated once and c's; the text before and after a word counts as a space.
The vectors of a text's trigrams are added up; the sum over the training texts of a language is its prototype. A text is
given the language whose prototype has the largest cosine with its own sum, after the mean direction of all prototypes
(what the languages share) is taken from both; ties go to the first language by code point.

Letters are what Unicode calls letters, lower-cased; everything else separates words. Training sums are added inside the
tasks, so a task sends one vector per language; what the driver holds is one vector per language, at most
``MAX_LANGUAGES`` of them.

Cases: a null text and one without letters is ``und`` with score 0; a null language is not learned; with nothing to
learn from, all is ``und``; very long texts are counted in pieces, whole; rows that repeat count as often as they come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import mixed, rows_of

DIMENSIONS, MAX_LANGUAGES = 512, 5000
UNKNOWN = "und"
#: Code points of Unicode end at 0x10FFFF; 21 bits hold each.
BITS = np.uint64(21)
SPACE = 0x20
#: Trigrams of a batch are counted in groups of documents of about so many letters.
GROUP = 400_000


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """(letters, DIMENSIONS) of +1 and -1 from the code points."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    seeds = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + words[None, :] * np.uint64(0xD1B54A32D192ED03)
    bits = np.unpackbits(mixed(mixed(seeds) + np.uint64(1)).view(np.uint8).reshape(len(points), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << 21) - 1)
    parts = [codes >> (BITS * np.uint64(2)), codes >> BITS & low, codes & low]
    points, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    vectors = letter_vectors(points)
    a, b, c = np.split(inverse, 3)
    return np.roll(vectors, 2, axis=1)[a] * np.roll(vectors, 1, axis=1)[b] * vectors[c]


#: Letter or not, and the lower-cased letter, of the code points below 0x10000; the rest is asked one by one.
class Letters:
    def __init__(self):
        self.table = np.array([self.fold(i) for i in range(0x10000)], np.uint64)

    @staticmethod
    def fold(point: int) -> int:
        char = chr(point)
        if not char.isalpha():
            return SPACE
        lower = char.lower()
        return ord(lower) if len(lower) == 1 else point

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        high = points > 0xFFFF
        out = self.table[np.where(high, 0x20, points)]
        if high.any():
            found, inverse = np.unique(points[high], return_inverse=True)
            out[high] = np.array([self.fold(int(p)) for p in found], np.uint64)[inverse]
        return out


def trigrams(letters: np.ndarray) -> np.ndarray:
    """Codes of the trigrams around or inside words; none for a text without letters."""
    letters = letters[np.concatenate(([True], (letters[1:] != SPACE) | (letters[:-1] != SPACE)))] if len(letters) else letters
    if not (letters != SPACE).any():
        return np.empty(0, np.uint64)
    padded = np.concatenate(([SPACE], letters, [SPACE])).astype(np.uint64)
    codes = padded[:-2] << (BITS * np.uint64(2)) | padded[1:-1] << BITS | padded[2:]
    return codes[padded[1:-1] != SPACE]


def _groups(batches, letters, *names):
    """Rows with trigram codes in groups: lists of the other values and one matrix of counts over distinct codes."""
    rest, codes, held = [], [], 0
    for text, *values in rows_of(batches, "text", *names):
        found = trigrams(letters(text or ""))
        rest.append(values)
        codes.append(found)
        held += len(found)
        if held >= GROUP or len(rest) >= 512:
            yield rest, codes
            rest, codes, held = [], [], 0
    if rest:
        yield rest, codes


def _sums(codes: list[np.ndarray], owner: np.ndarray, owners: int) -> np.ndarray:
    """(owners, DIMENSIONS): sums of the trigram vectors of each owner."""
    distinct, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    if not len(distinct):
        return np.zeros((owners, DIMENSIONS), np.float32)
    of = np.repeat(owner, [len(c) for c in codes])
    counts = np.bincount(of * len(distinct) + inverse, minlength=owners * len(distinct)).reshape(owners, -1)
    out = np.zeros((owners, DIMENSIONS), np.float32)
    for i in range(0, len(distinct), 16384):
        out += counts[:, i:i + 16384].astype(np.float32) @ trigram_vectors(distinct[i:i + 16384])
    return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language in ``docs``."""

    def add(batches):
        letters, sums = Letters(), {}
        for rest, codes in _groups(batches, letters, "lang"):
            langs = sorted({lang for lang, in rest})
            place = {lang: i for i, lang in enumerate(langs)}
            found = _sums(codes, np.array([place[lang] for lang, in rest]), len(langs))
            for lang, i in place.items():
                sums[lang] = sums.get(lang, 0) + found[i].astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            ["lang", "total"])

    pairs = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    parts = pairs.filter("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(add, "lang string, total array<double>")
    totals = parts.select("lang", F.posexplode("total").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("total")).limit(
        MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    # Sums of whole numbers are exact, so the order in which tasks end does not change them.
    return {r["lang"]: np.array(r["total"]) for r in sorted(rows, key=lambda r: r["lang"]) if any(r["total"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): score is the cosine, 0 where it is negative."""
    names = sorted(prototypes)
    units = np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]).reshape(len(names), DIMENSIONS)
    mean = units.mean(0) if len(names) > 1 else np.zeros(DIMENSIONS)
    own = units - mean
    shared = docs.sparkSession.sparkContext.broadcast(
        (names, own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12), mean))

    def scan(batches):
        letters = Letters()
        langs, profiles, common = shared.value
        for rest, codes in _groups(batches, letters, "id"):
            sums = _sums(codes, np.arange(len(rest)), len(rest)).astype(np.float64)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            unit = sums / np.maximum(size, 1e-12) - common
            cosine = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12) @ profiles.T
            known = np.array([len(c) > 0 for c in codes]) & bool(langs)
            best = cosine.argmax(1) if langs else np.zeros(len(rest), int)
            score = np.clip(cosine.max(1), 0, 1) if langs else np.zeros(len(rest))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, in rest], pa.int64()),
                 pa.array([langs[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                 pa.array(np.where(known, score, 0.0))], ["id", "lang_pred", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(scan, "id long, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), "lang_pred", "score")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for the fold that is not learned from: CRC-32 of the id as text, remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the other folds, predict every document."""
    prototypes = learn(docs.filter(~held_out(id_col)), text_col, lang_col)
    return predict(docs, prototypes, id_col, text_col).withColumn("held_out", held_out(id_col)).select(
        id_col, "held_out", "lang_pred", "score")
