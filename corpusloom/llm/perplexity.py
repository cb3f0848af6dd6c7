"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Model: n-grams of ``ORDER`` characters (letters lower-cased, digits as 0, white space as one space), counted over all
trusted documents outside the calibration fold; lower orders use continuation counts, every order its own three
discounts. Context totals, discounts and lower orders meet the n-grams in shuffle joins on the n-gram's own prefix and
suffix, so the counts are never in one place.

Scoring: the finished probabilities and back-off weights are cut into shards of at most ``SHARD_ENTRIES`` entries by the
two characters before the predicted one, the same for an n-gram and for all that it backs off to. All shards are broadcast;
a task scans its documents once and holds one shard at a time, which scores the places that fall in it. So a row stays a
row, its characters' values stand side by side, and results do not depend on the number of shards.

Decision: a document's mean surprise (nats a character) is drawn towards its language's by ``PRIOR`` characters, so that
a few characters decide nothing. The mean of its most surprising ``STRETCH`` characters in a row is drawn alike, so that a
few odd words in a long text are not averaged away. It is rejected if either is above the ``QUANTILE`` of the same of the
trusted documents of its language in the calibration fold, which the model has not seen. A language's mean and quantile
are drawn towards those of all languages together, which count as much as ``POOLED`` documents: there is no least number
of documents, and a language without any takes the pooled limit.

Cases: null, empty and blank texts have no characters, null perplexity, and are kept; a null language is a language of
its own; a label that comes twice counts as trusted if all its rows say so; without trusted text nothing is rejected;
rows that repeat an id are scored each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.common import mixed, rows_of
from corpusloom.session import checkpointed

ORDER = 5
QUANTILE, PRIOR, POOLED, FOLDS = 0.999, 100, 50, 5
#: Characters of the stretch that is judged besides the whole text.
STRETCH = 16
#: Symbols scored at a time with one shard and with several, n-grams counted in a task before they are sent, entries of a
#: shard, ids that are broadcast.
CHUNK, GROUP, HELD, SHARD_ENTRIES, BROADCAST_IDS = 1_000_000, 8_000_000, 400_000, 4_000_000, 1_000_000
START, SPACE = 1, 32
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                    0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


class Symbols:
    """Characters of the model; code points beyond 0xFFFF stay as they are."""

    def __init__(self):
        self.table = np.array([self.fold(i) for i in range(0x10000)], np.uint32)

    @staticmethod
    def fold(point: int) -> int:
        char = chr(point)
        if point <= SPACE or char.isspace():
            return SPACE
        if char.isdigit():
            return ord("0")
        lower = char.lower()
        return ord(lower) if len(lower) == 1 else point

    def __call__(self, text: str | None) -> np.ndarray:
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.where(points > 0xFFFF, points, self.table[np.minimum(points, 0xFFFF)])
        blank = out == SPACE
        keep = ~blank
        if len(out):
            keep[1:] |= blank[1:] & ~blank[:-1]
            first = int(np.argmax(~blank)) if not blank.all() else len(out)
            keep[:first] = False
        return out[keep]


def keys(columns: list[np.ndarray], tag: int) -> np.ndarray:
    """Hash of symbols given last first; ``tag`` parts n-grams from contexts."""
    total = np.full(len(columns[0]), 2 * len(columns) + tag, np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    for symbol, factor in zip(columns, FACTORS):
        total += symbol.astype(np.uint64) * factor
    return mixed(total)


def _laid_out(texts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of documents end to end, each behind order - 1 starts, and the places that are scored."""
    start = np.full(order - 1, START, np.uint32)
    pieces = [x for t in texts for x in (start, t)]
    scored = np.concatenate([x for t in texts for x in (np.zeros(order - 1, bool), np.ones(len(t), bool))])
    return np.concatenate(pieces), np.flatnonzero(scored)


def _groups(batches, symbols, names, limit):
    rest, texts, held = [], [], 0
    for text, *values in rows_of(batches, "text", *names):
        found = symbols(text)
        rest.append(values)
        texts.append(found)
        held += len(found)
        if held >= limit or len(rest) >= 20_000:
            yield rest, texts
            rest, texts, held = [], [], 0
    if rest:
        yield rest, texts


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram string, n long) over the column ``text``; added up in the tasks before they are sent."""

    def count(batches):
        symbols, held = Symbols(), {}

        def sent():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])

        for _, found in _groups(batches, symbols, (), CHUNK):
            line, at = _laid_out(found, order)
            if not len(at):
                continue
            key = keys([line[at - j] for j in range(order)], 0)
            _, first, times = np.unique(key, return_index=True, return_counts=True)
            place = at[first]
            chars = np.stack([line[place - j] for j in range(order - 1, -1, -1)], axis=1).astype("<u4")
            grams = chars.tobytes().decode("utf-32-le", "surrogatepass")
            for i, n in enumerate(times.tolist()):
                gram = grams[i * order:(i + 1) * order]
                held[gram] = held.get(gram, 0) + n
            if len(held) > HELD:
                yield sent()
                held.clear()
        yield sent()

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram string, n long").groupBy("gram").agg(
        F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> list[float]:
    """Discounts for counts of 1, 2 and more from the counts of counts."""
    row = grams.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
    n = [row[f"n{i}"] for i in range(1, 5)]
    if not n[0]:
        return [0.5, 0.5, 0.5]
    base = n[0] / (n[0] + 2 * n[1])
    found = [k + 1 - (k + 2) * base * n[k + 1] / n[k] if n[k] else float(k + 1) for k in range(3)]
    return [min(max(d, 0.05), k + 1.0) for k, d in enumerate(found)]


def train(texts: DataFrame, order: int = ORDER) -> tuple[DataFrame, float]:
    """(gram, context boolean, value): log probability of n-grams and log back-off weight of contexts; and the log
    probability of an unknown character."""
    counts = checkpointed(count_grams(texts, order))
    by_order = {order: counts}
    for k in range(order - 1, 0, -1):
        by_order[k] = checkpointed(
            by_order[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    entries, lower, unknown = [], None, 0.0
    for k in range(1, order + 1):
        grams = by_order[k]
        one, two, more = _discounts(grams)
        discount = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
        prefixed = grams.withColumn("prefix", F.substring("gram", 1, k - 1))
        contexts = prefixed.groupBy("prefix").agg(
            F.sum("n").cast("double").alias("total"), F.sum(discount).alias("taken")).select(
            "prefix", "total", (F.col("taken") / F.col("total")).alias("backoff"))
        if k == 1:
            row = contexts.first()
            if row is None:
                return texts.sparkSession.createDataFrame([], "gram string, context boolean, value double"), 0.0
            size = grams.count() + 1
            uniform = row["backoff"] / size
            unknown = math.log(uniform)
            found = grams.select("gram", ((F.col("n") - discount) / row["total"] + uniform).alias("p"))
        else:
            found = prefixed.join(contexts, "prefix").withColumn("suffix", F.substring("gram", 2, k - 1)).join(
                lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix").select(
                "gram", ((F.col("n") - discount) / F.col("total") + F.col("backoff") * F.col("below")).alias("p"))
            entries.append(contexts.select(
                F.col("prefix").alias("gram"), F.lit(True).alias("context"), F.log("backoff").alias("value")))
        lower = checkpointed(found)
        entries.append(lower.select("gram", F.lit(False).alias("context"), F.log("p").alias("value")))
    model = entries[0]
    for part in entries[1:]:
        model = model.unionByName(part)
    return checkpointed(model), unknown


class Shard:
    """Keys in order (see ``ordered``) with values; looked up through the start of each key's bucket."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.shift = np.uint64(64 - max(8, len(key).bit_length() + 1))
        buckets = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)
        self.first = np.searchsorted(key >> self.shift, buckets).astype(np.int32)
        self.key = np.append(key, np.uint64(0))
        self.value = np.append(value, np.float32(0))

    @staticmethod
    def ordered(keys: bytes, values: bytes) -> tuple[bytes, bytes]:
        key, value = np.frombuffer(keys, np.uint64), np.frombuffer(values, np.float32)
        order = np.argsort(key)
        return key[order].tobytes(), value[order].tobytes()

    @classmethod
    def of(cls, shared) -> Shard:
        """The shard of a broadcast, whose bytes the worker does not hold on to."""
        keys, values = shared.value
        if getattr(shared, "_path", None):  # the worker's file, which is read again when the value is asked for
            vars(shared).pop("_value", None)
        return cls(np.frombuffer(keys, np.uint64), np.frombuffer(values, np.float32))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = (key >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        hit = (at < end) & (self.key[at] == key)
        place = at
        open_ = np.flatnonzero(~hit & (at + 1 < end))
        while len(open_):
            at[open_] += 1
            good = self.key[at[open_]] == key[open_]
            hit[open_[good]] = True
            rest = open_[~good]
            open_ = rest[at[rest] + 1 < end[rest]]
        return hit, self.value[place]


def _owner(last: np.ndarray, before: np.ndarray, shards: int) -> np.ndarray:
    """Shard of the two characters before the predicted one."""
    return (keys([last, before], 2) % np.uint64(shards)).astype(np.int64)


def _blobs(model: DataFrame, shards: int) -> DataFrame:
    """(shard, keys binary, values binary) of the model's entries; short ones go to every shard."""

    def pack(batches):
        for batch in batches:
            out = {}
            for gram, context, value in rows_of([batch], "gram", "context", "value"):
                out.setdefault((len(gram), context), []).append((gram, value))
            for (size, context), rows in out.items():
                chars = np.frombuffer("".join(g for g, _ in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)
                key = keys([chars[:, size - 1 - j] for j in range(size)], int(context))
                value = np.array([v for _, v in rows], np.float32)
                known = size - (0 if context else 1)  # characters before the predicted one
                if known < 2 or shards == 1:
                    parts = [(s, slice(None)) for s in range(shards)]
                else:
                    owner = _owner(chars[:, known - 1], chars[:, known - 2], shards)
                    parts = [(s, owner == s) for s in range(shards)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in parts], pa.int32()), pa.array([key[p].tobytes() for _, p in parts], pa.binary()),
                     pa.array([value[p].tobytes() for _, p in parts], pa.binary())], ["shard", "keys", "values"])

    return model.mapInArrow(pack, "shard int, keys binary, values binary")


def _peaks(value: np.ndarray, size: np.ndarray, width: int = STRETCH) -> np.ndarray:
    """Of texts of ``size`` characters, end to end, the largest sum over ``width`` neighbours; shorter texts' whole sums."""
    edge = np.cumsum(size)
    out, first = np.zeros(len(size)), edge - size
    for i in np.flatnonzero((size > 0) & (size < width)).tolist():
        out[i] = value[first[i]:edge[i]].sum()
    long = np.flatnonzero(size >= width)
    if len(long):
        sums = np.lib.stride_tricks.sliding_window_view(value, width).sum(axis=1)
        bounds = np.stack([first[long], edge[long] - width + 1], axis=1).ravel()
        out[long] = np.maximum.reduceat(np.append(sums, -np.inf), bounds)[::2]
    return out


def _score(line: np.ndarray, at: np.ndarray, shard: Shard, order: int, unknown: float) -> np.ndarray:
    """Log probability at the places."""
    out, left = np.zeros(len(at), np.float64), np.arange(len(at))
    for k in range(order, 0, -1):
        if not len(left):
            break
        place = at[left]
        columns = [line[place - j] for j in range(k)]
        hit, value = shard.find(keys(columns, 0))
        out[left[hit]] += value[hit]
        left = left[~hit]
        if k > 1:
            hit, value = shard.find(keys([c[~hit] for c in columns[1:]], 1))
            out[left[hit]] += value[hit]
    out[left] += unknown
    return out


def surprise(docs: DataFrame, model: DataFrame, unknown: float, order: int = ORDER, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``docs`` (text, ..) to (.., nats, n, peak): a document row's surprise, its characters and the surprise of its most
    surprising stretch, one row for each row."""
    spark = docs.sparkSession
    shards = max(1, -(-model.count() // shard_entries))
    blobs = checkpointed(_blobs(model, shards))
    kept = [c for c in docs.columns if c != "text"]
    every = []
    for s in range(shards):
        rows = blobs.filter(F.col("shard") == s).select("keys", "values").collect()
        every.append(spark.sparkContext.broadcast(
            Shard.ordered(b"".join(r["keys"] for r in rows), b"".join(r["values"] for r in rows))))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")

    def score(batches):
        symbols, only = Symbols(), Shard.of(every[0]) if shards == 1 else None

        def nats_of(line, at):
            if shards == 1:
                return -_score(line, at, only, order, unknown)
            out, owner = np.zeros(len(at)), _owner(line[at - 1], line[at - 2], shards)
            for s, shared in enumerate(every):
                mine = np.flatnonzero(owner == s)
                if len(mine):
                    out[mine] = -_score(line, at[mine], Shard.of(shared), order, unknown)
            return out

        # Shards are loaded anew for every group, so groups are larger then.
        for rest, texts in _groups(batches, symbols, kept, CHUNK if shards == 1 else GROUP):
            line, at = _laid_out(texts, order)
            size = np.array([len(t) for t in texts], np.int64)
            value, first = nats_of(line, at), np.cumsum(size) - size
            nats, full = np.zeros(len(texts)), size > 0
            if full.any():
                nats[full] = np.add.reduceat(value, first[full])
            columns = [pa.array(c, k) for c, k in zip(zip(*rest), kinds)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(nats), pa.array(size), pa.array(_peaks(value, size))], [*kept, "nats", "n", "peak"])

    kinds = [to_arrow_type(docs.schema[c].dataType) for c in kept]
    return docs.mapInArrow(score, f"{schema}, nats double, n long, peak double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose labels all say good and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("good_id")).agg(
        F.min(F.coalesce(good, F.lit(False))).alias("all_good")).filter("all_good").select("good_id")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           order: int = ORDER, quantile: float = QUANTILE, prior: float = PRIOR, pooled: float = POOLED,
           shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(id, n_chars, perplexity, score, limit, peak, peak_limit, keep) for every document row."""
    good = checkpointed(trusted_ids(labels))
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text")).join(good, F.col("id") == F.col("good_id"), "left")
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(FOLDS))
    marked = rows.select("id", "lang", "text", F.col("good_id").isNotNull().alias("trusted")).withColumn(
        "calibrates", F.col("trusted") & (fold == 0))
    model, unknown = train(marked.filter("trusted AND NOT calibrates"), order)
    scored = checkpointed(surprise(marked.select("id", "lang", "calibrates", "text"), model, unknown, order, shard_entries))
    if model.isEmpty():
        scored = scored.withColumn("n", F.lit(0).cast("long"))
    return decided(scored, quantile, prior, pooled).withColumnRenamed("id", id_col)


def decided(scored: DataFrame, quantile: float = QUANTILE, prior: float = PRIOR, pooled: float = POOLED) -> DataFrame:
    """``judged``'s columns from (id, lang, calibrates, nats, n, peak): the limits and what they keep."""
    mean = F.sum("nats") / F.sum("n")
    seen = scored.filter("calibrates AND n > 0")
    means = seen.groupBy(F.col("lang").alias("of")).agg(mean.alias("own"), F.count(F.lit(1)).alias("docs"))
    overall = seen.agg(mean.alias("mean")).first()["mean"]
    of_lang = F.col("lang").eqNullSafe(F.col("of"))

    def towards(own, all_together):
        """A language's value of ``docs`` documents, drawn towards the pooled one."""
        docs = F.coalesce("docs", F.lit(0))
        return (F.coalesce(F.col(own) * docs, F.lit(0.0)) + F.lit(all_together).cast("double") * pooled) / (docs + pooled)

    def drawn_to(nats, n):
        """Mean of ``n`` characters, drawn towards the language's."""
        return F.when((F.col("n") > 0) & F.col("mean").isNotNull(), (F.col(nats) + F.col("mean") * prior) / (n + prior))

    drawn = scored.join(means, of_lang, "left").withColumn("mean", towards("own", overall)).withColumn(
        "score", drawn_to("nats", F.col("n"))).withColumn(
        "peak", drawn_to("peak", F.least("n", F.lit(STRETCH)))).select("id", "lang", "calibrates", "nats", "n", "score", "peak")
    drawn = checkpointed(drawn)
    calibrating = drawn.filter("calibrates AND score IS NOT NULL")
    quantiles = [F.percentile_approx(c, quantile, 10000).alias(name) for c, name in (("score", "q"), ("peak", "p"))]
    together = calibrating.agg(*quantiles).first()
    own = calibrating.groupBy(F.col("lang").alias("of")).agg(*quantiles, F.count(F.lit(1)).alias("docs"))
    out = drawn.join(own, of_lang, "left").select(
        "id", "n", "nats", "score", "peak", *[towards(c, together[c]).alias(name) for c, name in (("q", "limit"), ("p", "peak_limit"))])
    return out.select(
        "id", F.col("n").alias("n_chars"), F.when(F.col("n") > 0, F.exp(F.col("nats") / F.col("n"))).alias("perplexity"),
        F.exp("score").alias("score"), F.exp("limit").alias("limit"), F.exp("peak").alias("peak"), F.exp("peak_limit").alias("peak_limit"),
        F.coalesce((F.col("score") <= F.col("limit")) & (F.col("peak") <= F.col("peak_limit")), F.lit(True)).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that are kept, whole and with all their columns; rows that share an id go if one of them does."""
    bad = judged(docs, labels, id_col, **options).filter("NOT keep").select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
