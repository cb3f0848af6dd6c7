"""Exact removal of repeated word windows behind a count-min prefilter.

A window is ``n`` (13) consecutive words ``[^\\x20\\x09-\\x0D]+`` of one document. A word goes if a window that covers it
also starts in a document with a smaller id; windows are judged on the input.

1. Every chunk of documents counts the hashes of its windows, once per document, in a sketch; see ``sketch``.
2. Chunks hash their windows again and keep those estimated to be repeated. Inside the chunk the document with the
   smallest id settles all others, so a chunk sends one document per window at most, however hot the window is.
3. Windows are grouped exactly, by 96 bits of hash, and lose to the smallest id of their group. They travel in packed
   pieces, one per chunk and bucket of hashes; the number of buckets follows the bytes of all texts. A bucket is merged
   piece by piece and holds the first document of each of its windows only, so a hot window takes no more room.
4. Lost windows come back to their document as spans; its words are cut in one pass.

Cases: a null text has no words; texts of fewer than ``n`` words stay whole; rows with a null id are neither cut nor
counted against others; rows that repeat an id and its text are the same document and are cut alike; no rows, no rows.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import covered, documents, mixed, packed, rows_of, runs, unpacked
from corpusloom.llm.sketch import SKETCH, repeated, sketch_of

#: Windows held by a task at a time.
CHUNK = 1_500_000
#: Bytes of text for each bucket of windows (a power of two of buckets).
BUCKET_BYTES = 1 << 22
#: Rows of a bucket that are taken together into its merge.
MERGED = 400_000
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, n: int, factor: int) -> np.ndarray:
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out *= np.uint64(factor)
        out += words[j:j + len(out)]
    return mixed(out)


def _chunks(batches, n, size):
    """Ids, numbers of windows and word hashes of documents that have windows, up to about ``size`` windows together."""
    ids, hashes, held = [], [], 0
    for doc, text in rows_of(batches, "id", "text"):
        words = word_hashes(text) if doc is not None else ()
        if len(words) < n:
            continue
        ids.append(doc)
        hashes.append(words)
        held += len(words)
        if held >= size:
            yield ids, hashes
            ids, hashes, held = [], [], 0
    if ids:
        yield ids, hashes


def _laid_out(ids, hashes, n):
    """Windows of a chunk: id, start in the document and word hashes end to end with the places of the windows."""
    words = np.concatenate(hashes)
    sizes = np.array([len(h) for h in hashes])
    first = np.cumsum(sizes) - sizes
    count = sizes - n + 1
    doc = np.repeat(np.array(ids, np.int64), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return words, np.repeat(first, count) + start, doc, start


def _first_in_group(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys: index of the first row of each row's group."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _settled(h, second, doc, start):
    """Windows sorted by hash: those of the smallest document of each group, and (document, start) of all others."""
    order = np.lexsort((doc, second, h))
    h, second, doc, start = h[order], second[order], doc[order], start[order]
    lost = doc > doc[_first_in_group(h, second)]
    return tuple(column[~lost] for column in (h, second, doc, start)), (doc[lost], start[lost])


def _joined(doc, start, n):
    """(document, span) of windows, spans of windows that follow each other as one: start << 32 | end, in words."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc))[:len(begin)] - 1
    return doc[begin], start[begin] << 32 | start[last] + n


def _bucket_bounds(h: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Where the buckets of sorted hashes begin and end; a bucket is the leading ``bits`` bits."""
    bucket = h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(h) else np.empty(0, np.int64)
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)]))


#: The columns of a piece: hash, second hash, document, start.
PIECE = (np.uint64, np.uint32, np.int64, np.uint32)


def _piece(h, second, doc, start) -> bytes:
    """Rows sorted by hash as bytes: gaps of the hashes, then the other columns, byte by byte of equal weight."""
    low = doc.min()
    columns = (np.diff(h, prepend=np.uint64(0)), second, doc - low, start)
    flat = b"".join(c.astype(k).view(np.uint8).reshape(len(h), -1).T.tobytes() for c, k in zip(columns, PIECE))
    return int(low).to_bytes(8, "little", signed=True) + len(h).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(flat, asbytes=True)


def _rows(data: bytes) -> tuple[np.ndarray, ...]:
    """The columns of a piece."""
    low, size = int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:16], "little")
    widths = [np.dtype(k).itemsize for k in PIECE]
    flat = np.frombuffer(pa.decompress(data[16:], size * sum(widths), "zstd", asbytes=True), np.uint8)
    columns, at = [], 0
    for kind, width in zip(PIECE, widths):
        columns.append(np.ascontiguousarray(flat[at:at + size * width].reshape(width, size).T).view(kind).ravel())
        at += size * width
    gaps, second, doc, start = columns
    return np.cumsum(gaps, dtype=np.uint64), second.astype(np.uint64), doc + np.int64(low), start.astype(np.int64)


def lost_spans(docs: DataFrame, n: int = 13, chunk: int = CHUNK, bucket_bytes: int = BUCKET_BYTES,
               merged: int = MERGED) -> DataFrame:
    """(id, spans array<long>): start << 32 | end, in words, of what goes from documents (id, text)."""

    def count(batches):
        for ids, hashes in _chunks(batches, n, chunk):
            words, place, doc, _ = _laid_out(ids, hashes, n)
            h = window_hashes(words, n, FACTORS[0])[place]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            once = np.arange(len(h)) == _first_in_group(h, doc)  # windows count once per document
            yield sketch_of(h[once])

    may = docs.sparkSession.sparkContext.broadcast(repeated(docs.mapInArrow(count, SKETCH)))

    bits = max(0, ((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes).bit_length())

    def choose(batches):
        for ids, hashes in _chunks(batches, n, chunk):
            words, place, doc, start = _laid_out(ids, hashes, n)
            h = window_hashes(words, n, FACTORS[0])[place]
            at = np.flatnonzero(may.value.may(h))
            if not len(at):
                continue
            h, doc, start = h[at], doc[at], start[at]
            second = window_hashes(words, n, FACTORS[1])[place[at]] >> np.uint64(32)
            kept, lost = _settled(h, second, doc, start)
            bounds = _bucket_bounds(kept[0], bits)
            data = [_piece(*(column[a:b] for column in kept)) for a, b in bounds]
            buckets = [int(kept[0][a]) >> (64 - bits) if bits else 0 for a, _ in bounds]
            # What is settled here goes as spans; any bucket can carry them.
            spans = _joined(*lost, n)
            data.append(np.concatenate(spans).tobytes())
            buckets.append(ids[0] % (1 << bits))
            settled = [False] * len(bounds) + [True]
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets, pa.int32()), pa.array(settled), pa.array(data, pa.binary())], ["bucket", "settled", "data"])

    def merge(batches):
        def given(doc, span):
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(span)], ["id", "span"])

        now, firsts, waiting, held = None, None, [], 0
        for bucket, settled, data in itertools.chain(rows_of(batches, "bucket", "settled", "data"), [(None, False, None)]):
            if waiting and (bucket != now or held >= merged):
                every = [np.concatenate(c) for c in zip(*([firsts] if firsts else []), *waiting)]
                firsts, lost = _settled(*every)
                waiting, held = [], 0
                yield given(*_joined(*lost, n))
            if bucket != now:
                now, firsts = bucket, None
            if settled:
                yield given(*np.frombuffer(data, np.int64).reshape(2, -1))
            elif data is not None:
                waiting.append(_rows(data))
                held += len(waiting[-1][0])

    pieces = docs.mapInArrow(choose, "bucket int, settled boolean, data binary")
    gone = pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "id long, span long")
    return gone.groupBy("id").agg(F.collect_list("span").alias("spans"))


def cut(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
        bucket_bytes: int = BUCKET_BYTES, merged: int = MERGED) -> DataFrame:
    """(id, n_words, n_removed, kept binary, removed array of (start, end)) for every document row."""
    texts = documents(docs, id_col, text_col)
    spans = lost_spans(texts, n, chunk, bucket_bytes, merged)

    def apply(batches):
        for batch in batches:
            out = []
            for doc, text, spans in rows_of([batch], "id", "text", "spans"):
                words = (unpacked(text) or b"").split()
                if spans:
                    packed = np.array(spans, np.int64)
                    gone = covered(len(words), packed >> 32, packed & 0xFFFFFFFF)
                    a, b = runs(gone)
                    kept = b" ".join(itertools.compress(words, (~gone).tolist()))
                    out.append((doc, len(words), int(gone.sum()), kept, [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())]))
                else:
                    out.append((doc, len(words), 0, b" ".join(words), []))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "n_words", "n_removed", "kept", "removed"])

    joined = packed(texts).join(spans.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select("id", "text", "spans")
    return joined.mapInArrow(
        apply, "id long, n_words long, n_removed long, kept binary, removed array<struct<start: int, end: int>>")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result of ``cut`` with the kept text as SHA-256."""
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
