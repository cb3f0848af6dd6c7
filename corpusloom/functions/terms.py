"""Which terms of a bounded list stand in a text, and replacements in it: Arrow helpers that take a batch of texts at once.

UTF-8 keeps places apart, so a term stands in a text when its bytes do. For every length that terms have, the bytes from each
place on are one number; a table of slots leaves the places where a term may start, and equal numbers settle them (terms of
over 16 bytes are compared byte by byte there). Work is linear in the bytes and in the places found. Terms without blanks are
looked for in the distinct words of some texts instead of in every byte: texts repeat their words, and such a term stands inside one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text looked at together, and pairs of row and term that are marked in one table.
PIECE = 1 << 20
MARKS = 1 << 26
#: Bytes of texts whose words are gathered together, and the last byte that parts words.
GATHERED = 1 << 23
BLANK = 0x20
#: Pairs of terms that share a number of bits.
CELL = 64
#: Bytes of replaced texts that are given back together.
GIVEN = 1 << 26
SLOT_BITS = 18
ODD = np.uint64(0x9E3779B97F4A7C15)


def _numbers(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number; ``data`` ends in eight bytes more."""
    return np.ndarray((data.size - 8,), "<u8", data, strides=(1,)).copy()


def _mixed(head: np.ndarray, tail: np.ndarray | None) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = head * ODD if tail is None else (head * ODD ^ tail) * ODD
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


class _OfLength:
    """The terms of one length in bytes, by the slot of their first and last eight bytes."""

    def __init__(self, size: int, ids: np.ndarray, terms: list[bytes]):
        self.size, self.ids, self.longer = size, ids, {int(i): np.frombuffer(terms[i], np.uint8) for i in ids} if size > 16 else None
        self.mask = np.uint64((1 << 8 * min(size, 8)) - 1)
        # The tail of a long term ends at its sixteenth byte.
        self.shift = max(min(size, 16) - 8, 0)
        first = np.array([int.from_bytes(terms[i][:8], "little") for i in ids], np.uint64)
        last = np.array([int.from_bytes(terms[i][self.shift:self.shift + 8], "little") for i in ids], np.uint64)
        self.first, self.last = np.zeros(len(terms), np.uint64), np.zeros(len(terms), np.uint64)
        self.first[ids], self.last[ids] = first, last
        slots = _mixed(first, last if self.shift else None)
        self.filled = np.zeros(1 << SLOT_BITS, bool)
        self.filled[slots] = True
        # Terms that share a slot stand in layers of their own.
        self.layers = []
        while ids.size:
            _, kept = np.unique(slots, return_index=True)
            layer = np.full(1 << SLOT_BITS, -1, np.int32)
            layer[slots[kept]] = ids[kept]
            self.layers.append(layer)
            ids, slots = np.delete(ids, kept), np.delete(slots, kept)

    def places(self, data: np.ndarray, eight: np.ndarray, row: np.ndarray, starts: int, near: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, term) of the places before ``starts`` where a term stands inside one row; ``near``: the only places to look at."""
        count = min(starts, row.size - self.size + 1)
        if count <= 0:
            return
        near = near if near is None else near[:np.searchsorted(near, count)]
        head = eight[:count] & self.mask if near is None else eight[near] & self.mask
        tail = None if not self.shift else eight[self.shift:self.shift + count] if near is None else eight[near + self.shift]
        slots = _mixed(head, tail)
        kept = np.flatnonzero(self.filled[slots])
        at = kept if near is None else near[kept]
        inside = row[at] == row[at + self.size - 1]
        kept, at = kept[inside], at[inside]
        head, tail, slots = head[kept], None if tail is None else tail[kept], slots[kept]
        for layer in self.layers:
            term = layer[slots]
            same = (term >= 0) & (self.first[term] == head)
            if tail is not None:
                same &= self.last[term] == tail
            found, term = at[same], term[same]
            if self.longer:
                same = np.fromiter((np.array_equal(data[p:p + self.size], self.longer[t]) for p, t in zip(found.tolist(), term.tolist())), bool, found.size)
                found, term = found[same], term[same]
            yield found, term


def _by_length(terms: list[bytes], kept: np.ndarray | None = None) -> list[_OfLength]:
    sizes = np.array([len(t) for t in terms], np.int64)
    sizes = sizes if kept is None else np.where(kept, sizes, 0)
    return [_OfLength(int(size), np.flatnonzero(sizes == size), terms) for size in np.unique(sizes) if size]


def _distinct(codes: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in order, each once. (``np.unique`` hashes them, which takes many times longer.)"""
    codes = np.sort(codes)
    return codes[np.flatnonzero(np.diff(codes, prepend=-1))]


def _laid_out(texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array without nulls, and where its values start and end in them."""
    _, places, values = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8), offsets


def _places(lengths: list[_OfLength], data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, ...]]]]:
    """For every piece of a batch: its rows from one to before another, and all (row from the first, place, term) where a term starts in
    it. Pieces overlap by the longest term, so no place is lost between two."""
    longest, end = max((n.size for n in lengths), default=1), int(offsets[-1])
    # Terms of eight bytes and more are looked for only where the first eight of one stand.
    long = [n for n in lengths if n.size >= 8]
    heads = np.zeros(1 << SLOT_BITS, bool)
    for n in long:
        heads[_mixed(n.first[n.ids], None)] = True
    for start in range(int(offsets[0]), end, PIECE):
        stop = min(start + PIECE, end)
        upto = min(stop + longest - 1, end)
        low = int(np.searchsorted(offsets, start, "right")) - 1
        high = int(np.searchsorted(offsets, upto, "left"))
        ends = np.clip(offsets[low:high + 1], start, upto) - start
        row = np.repeat(np.arange(high - low, dtype=np.int32), np.diff(ends))
        piece = np.concatenate([data[start:upto], np.zeros(16, np.uint8)])
        eight = _numbers(piece)
        near = np.flatnonzero(heads[_mixed(eight[:stop - start], None)]) if long else None
        yield low, high, ((row[place], place + start, term) for n in lengths
                          for place, term in n.places(piece, eight, row, stop - start, near if n.size >= 8 else None))


def _pairs(lengths: list[_OfLength], count: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted distinct row * count + term of a batch."""
    out = []
    for low, high, found in _places(lengths, data, offsets):
        marks = np.zeros((high - low) * count, bool) if (high - low) * count <= MARKS else None
        for row, _, term in found:
            code = row.astype(np.int64) * count + term
            if marks is None:
                out.append(_distinct(code) + low * count)
            else:
                marks[code] = True
        if marks is not None:
            out.append(np.flatnonzero(marks) + low * count)
    return _distinct(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _of_each(first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the entries of all ``ids``, an id's being from ``first`` of it up to that of the next, and how many each has."""
    size = np.diff(first)[ids]
    return np.arange(size.sum()) + np.repeat(first[ids] - np.cumsum(size) + size, size), size


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray, np.ndarray]:
    """Where the words of a batch start (and the last ends), the distinct ones, and which each is. A word goes up to the next byte that
    is no blank after one that is, so what has no blanks stands in a text when it stands in one of its words."""
    low, high = int(offsets[0]), int(offsets[-1])
    blank, starts = data[low:high] <= BLANK, np.zeros(high - low + 1, bool)
    starts[1:-1] = blank[:-1] & ~blank[1:]
    starts[offsets - low] = True
    cuts = np.flatnonzero(starts) + low
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), cuts.size - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    return cuts, words.dictionary, words.indices.to_numpy()


def _pairs_by_word(lengths: list[_OfLength], count: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The pairs of ``_pairs`` for terms without blanks; each distinct word is looked at once."""
    cuts, words, ids = _words(data, offsets)
    distinct = _laid_out(words)
    # Where few words come again (or are not parted by blanks), the texts themselves are hardly more to look at.
    if 2 * int(distinct[1][-1]) > int(offsets[-1] - offsets[0]):
        return _pairs(lengths, count, data, offsets)
    word, term = np.divmod(_pairs(lengths, count, *distinct), count)
    first = np.searchsorted(word, np.arange(len(words) + 1))
    row = np.repeat(np.arange(offsets.size - 1), np.diff(np.searchsorted(cuts, offsets)))
    upto, out = np.cumsum(np.diff(first)[ids]), []
    steps = np.searchsorted(upto, np.arange(0, upto[-1] if upto.size else 0, PIECE), "right").tolist()
    for start, stop in zip(steps, [*steps[1:], ids.size]):
        at, size = _of_each(first, ids[start:stop])
        out.append(_distinct(np.repeat(row[start:stop] * count, size) + term[at]))
    return _distinct(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _found(inside: list[_OfLength], across: list[_OfLength], count: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted distinct row * count + term of a batch; ``inside``: the terms without blanks, ``across``: the others."""
    out, low = [_pairs(across, count, data, offsets)] if across else [], 0
    while inside and low < offsets.size - 1:
        high = max(int(np.searchsorted(offsets, offsets[low] + GATHERED, "right")) - 1, low + 1)
        out.append(_pairs_by_word(inside, count, data, offsets[low:high + 1]) + low * count)
        low = high
    return _distinct(np.concatenate(out)) if out else np.zeros(0, np.int64)


class _Terms:
    """Terms laid out for the search, and the places of the list where each of them stands; empty ones are none."""

    def __init__(self, listed: list[str]):
        self.terms = sorted({t.encode() for t in listed if t})
        known = {t: i for i, t in enumerate(self.terms)}
        ids = np.array([known.get(t.encode(), len(known)) for t in listed], np.int64)
        self.places = np.argsort(ids, kind="stable")
        self.first = np.searchsorted(ids[self.places], np.arange(len(known) + 1))
        blank = np.array([min(t) <= BLANK for t in self.terms], bool)
        self.inside, self.across = _by_length(self.terms, ~blank), _by_length(self.terms, blank)

    def found(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and term of the distinct pairs of a batch, in order."""
        data, offsets = _laid_out(batch.fill_null("").cast(pa.large_binary()))
        return np.divmod(_found(self.inside, self.across, len(self.terms), data, offsets), max(len(self.terms), 1))

    def cells(self, batch: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Every row's cells (row * ``width`` + cell) of ``CELL`` places of the list where a term is found, with a bit for each."""
        row, term = self.found(batch)
        at, size = _of_each(self.first, term)
        code = np.sort(np.repeat(row * (width * CELL), size) + self.places[at])
        start = np.flatnonzero(np.diff(code // CELL, prepend=-1))
        bits = np.left_shift(np.int64(1), code % CELL)
        return code[start] // CELL, np.bitwise_or.reduceat(bits, start) if start.size else bits


def terms_in(text: Column, terms: list[str]) -> Column:
    """The distinct ``terms`` (none of them empty) that a text contains, as an array; none for null."""

    @F.arrow_udf("array<string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        wanted = _Terms(terms)
        names = pa.array([t.decode() for t in wanted.terms], pa.string())
        for batch in batches:
            row, term = wanted.found(batch)
            ends = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(term)))

    # A filter on the array, as ``explode`` brings one along, would else look at the texts a second time, below other steps.
    return found.asNondeterministic()(text)


def packed(row: np.ndarray, term: np.ndarray, count: int) -> pa.BinaryArray:
    """Each row's numbers in order, as a binary of the steps from one to the next (the first from -1): as many bytes of 255 as there
    are in it, and the rest."""
    step = np.where(np.diff(row, prepend=-1) == 0, np.diff(term, prepend=-1), term + 1)
    ends = np.cumsum(np.concatenate([[0], step // 255 + 1]))
    data = np.full(ends[-1], 255, np.uint8)
    data[ends[1:] - 1] = step % 255
    offsets = ends[np.searchsorted(row, np.arange(count + 1))].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def numbers(binaries: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Place in the array and number of all that binaries of ``numbers_in`` hold; null ones hold none."""
    data, offsets = _laid_out(binaries.fill_null(b"").cast(pa.large_binary()))
    low = int(offsets[0])
    data = data[low:int(offsets[-1])]
    last, total = np.flatnonzero(data != 255), np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
    row = np.searchsorted(offsets - low, last, "right") - 1
    return row, total[last + 1] - total[offsets[row] - low] - 1


def numbers_in(text: Column, terms: list[str]) -> Column:
    """Which of ``terms`` (distinct, in order of their bytes, none empty) a text contains: their places in the list as a binary that
    ``numbers`` reads, about a byte for each; an empty one for null."""

    @F.arrow_udf("binary")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        wanted = _Terms(terms)
        for batch in batches:
            yield packed(*wanted.found(batch), len(batch))

    return found.asNondeterministic()(text)


def merged_numbers(binaries: Column) -> Column:
    """All numbers of an array of binaries of ``numbers_in``, each once, as one such binary."""

    @F.arrow_udf("binary")
    def merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            which, number = numbers(lists.flatten())
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())[which]
            count = int(number.max(initial=0)) + 1
            yield packed(*np.divmod(_distinct(row * count + number), count), len(lists))

    return merged(binaries)


def pairs_in(text: Column, other: Column, pairs: list[tuple[str, str]]) -> Column:
    """Which of numbered pairs of terms stand in two texts: an array of (cell, first, second), with the bits of ``CELL`` pairs of which
    ``text`` contains the first term and ``other`` the second. Cells without a bit are left out; nulls and empty terms give none."""

    @F.arrow_udf("array<struct<cell: int, first: bigint, second: bigint>>")
    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        sides, width = [_Terms([p[i] for p in pairs]) for i in (0, 1)], -(-len(pairs) // CELL) or 1
        for batch in batches:
            marked = [side.cells(texts, width) for side, texts in zip(sides, batch)]
            cells = _distinct(np.concatenate([cell for cell, _ in marked]))
            bits = np.zeros((2, cells.size), np.int64)
            for of, (cell, given) in zip(bits, marked):
                of[np.searchsorted(cells, cell)] = given
            ends = np.searchsorted(cells, np.arange(len(batch[0]) + 1) * width).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array((cells % width).astype(np.int32)), *map(pa.array, bits)], ["cell", "first", "second"])
            yield pa.ListArray.from_arrays(pa.array(ends), rows)

    return found.asNondeterministic()(text, other)


def _bytes(values: pa.Array) -> list[bytes | None]:
    """The values as bytes; equal ones are one object."""
    coded = values.cast(pa.large_binary()).dictionary_encode()
    known = [*coded.dictionary.to_pylist(), None]
    return [known[i] for i in coded.indices.fill_null(len(known) - 1).to_pylist()]


def replaced_in(text: Column, pairs: Column) -> Column:
    """A text after the replacements ``pairs`` (src, dst; an array, never null), one after the other, each at every place from the left.

    A pair with a null or an empty src replaces nothing. Null texts stay null.
    """

    @F.arrow_udf("string")
    def done(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            offsets = lists.offsets.to_pylist()
            given = [(s, d) if s and d is not None else None for s, d in zip(_bytes(lists.values.field(0)), _bytes(lists.values.field(1)))]
            out, size = [], 0
            for row, data in enumerate(texts.cast(pa.large_binary())):
                value = data.as_py()
                if value is not None:
                    for pair in given[offsets[row]:offsets[row + 1]]:
                        if pair:
                            # Most pairs are there, so one pass that cuts is less than one that counts and one that replaces.
                            value = pair[1].join(value.split(pair[0]))
                    size += len(value)
                out.append(value)
                if size > GIVEN:
                    yield pa.array(out, pa.binary()).cast(pa.string(), safe=False)
                    out, size = [], 0
            yield pa.array(out, pa.binary()).cast(pa.string(), safe=False)

    return done.asNondeterministic()(text, pairs)
