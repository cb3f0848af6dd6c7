"""A count-min prefilter for hashes: which hashes may occur more than once, over all data, with none of those lost.

Every task counts its hashes in a sketch of 2**``CELL_BITS`` cells and sends it, as sorted cell numbers with 8 or 16-bit
gaps, in ``RANGES`` ranges. Sketches are merged range by range in counters that stop at 2. Cells that reach 2 are folded
into a bitmap whose size follows their number up to ``MAX_BITMAP_BITS`` (64 MB, the bound of what is broadcast); folding
and collisions only ever add hashes, so the filter overestimates and the exact pass after it stays whole. When a corpus
has far more repeated hashes than bits, more hashes pass and the exact pass moves more, but results do not change.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import rows_of
from corpusloom.session import checkpointed

CELL_BITS, RANGE_BITS = 32, 8
RANGES, IN_RANGE = 1 << RANGE_BITS, 1 << (CELL_BITS - RANGE_BITS)
MIN_BITMAP_BITS, MAX_BITMAP_BITS = 16, 29
SKETCH = "part int, counted int, cells binary, wide int"


def _packed(part: int, counted: int, cells: np.ndarray) -> tuple:
    gaps = np.diff(cells, prepend=0)
    top = int(gaps.max())
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    return part, counted, gaps.astype(kind).tobytes(), np.dtype(kind).itemsize


def _unpacked(data: bytes, wide: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[wide]), dtype=np.int64)


def sketch_of(hashes: np.ndarray) -> pa.RecordBatch:
    """The sketch of a task's 64-bit hashes; each hash counts as often as it is given."""
    cells = np.sort((hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64))
    first = np.ones(len(cells), bool)
    first[1:] = cells[1:] != cells[:-1]
    again = np.zeros(len(cells), bool)
    again[1:] = first[:-1] & ~first[1:]
    rows = []
    for counted, chosen in enumerate((cells[first], cells[again])):
        bounds = np.searchsorted(chosen, np.arange(RANGES + 1) * IN_RANGE)
        rows += [
            _packed(part, counted, chosen[a:b] - part * IN_RANGE)
            for part, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if a < b
        ]
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.int32()))],
        ["part", "counted", "cells", "wide"])


def _merge(batches):
    """Per range: the cells that reach two."""

    def given(part, counts):
        cells = np.flatnonzero(counts > 1)
        row = _packed(part, len(cells), cells) if len(cells) else (part, 0, b"", 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.int32()))],
            ["part", "counted", "cells", "wide"])

    now, counts = None, None
    for part, cells, wide in rows_of(batches, "part", "cells", "wide"):
        if part != now:
            if now is not None:
                yield given(now, counts)
            now, counts = part, np.zeros(IN_RANGE, np.uint8)
        at = _unpacked(cells, wide)
        counts[at] = np.minimum(counts[at] + 1, 2)
    if now is not None:
        yield given(now, counts)


class Repeated:
    """The broadcast bitmap; ``may`` says for hashes whether they may occur more than once."""

    def __init__(self, bits: int, bitmap: np.ndarray):
        self.bits, self.bitmap = bits, bitmap

    def may(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 != 0


def repeated(sketches: DataFrame) -> Repeated:
    """Merge the tasks' sketches and bring the folded bitmap, bounded by ``MAX_BITMAP_BITS``, to the driver."""
    spark = sketches.sparkSession
    merged = checkpointed(
        sketches.repartition("part").sortWithinPartitions("part").mapInArrow(_merge, SKETCH))
    total = merged.agg(F.sum("counted")).first()[0] or 0
    bits = min(MAX_BITMAP_BITS, max(MIN_BITMAP_BITS, (64 * total).bit_length()))

    def fold(batches):
        for part, cells, wide in rows_of(batches, "part", "cells", "wide"):
            piece = np.zeros(1 << (bits - RANGE_BITS), np.uint8)
            piece[_unpacked(cells, wide) >> (CELL_BITS - bits)] = 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([np.packbits(piece, bitorder="little").tobytes()])], ["part", "piece"])

    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (bits - 3 - RANGE_BITS)
    for row in merged.filter("counted > 0").mapInArrow(fold, "part int, piece binary").collect():
        bitmap[row.part * size:(row.part + 1) * size] = np.frombuffer(row.piece, np.uint8)
    return Repeated(bits, bitmap)
