"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A-Z to a-z over bytes; every other byte stays.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, text binary): all that the text operators read, whatever other columns there are."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of Arrow batches, row by row."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def packed(texts: DataFrame) -> DataFrame:
    """(id, text binary) with compressed texts, for a shuffle; ``unpacked`` gives a text back. Null stays null."""

    def pack(batches):
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            out = [
                None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True)
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "text"])

    return texts.select("id", "text").mapInArrow(pack, "id long, text binary")


def unpacked(data: bytes | None) -> bytes | None:
    if data is None:
        return None
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd factors), so that the high bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def covered(n: int, starts, ends) -> np.ndarray:
    """Boolean mask over n places: inside any [start, end)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.asarray(starts, np.int64), 1)
    np.add.at(change, np.asarray(ends, np.int64), -1)
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def count_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text, 0 for null; JVM only."""
    plain = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    inner = F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1
    return F.coalesce(F.when(plain == "", 0).otherwise(inner), F.lit(0)).cast("long")
