"""Keys of a bounded lexicon in a text, and the cheapest cover of a text by spans: Arrow helpers over whole batches.

Spark deals the rows, gathers the spans and builds the tokens; a helper sees one text's units, or its numbers, at a time and works
linearly in units and spans.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Java's ``(?U)\s`` has it; ``str.split`` cuts at four control characters more.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CONTROLS = re.compile("[\x1c-\x1f]")
#: Marks of a unit that no span covers: in the script, or outside it.
UNKNOWN, PASS = -1, -2
#: Its rank among covers of equal cost; spans have smaller ones.
LAST = 3000

NUMBERS = {"i": pa.int32(), "q": pa.int64()}


def _tokens(text: str) -> list[str]:
    return [t for t in SPACE.split(text) if t] if CONTROLS.search(text) else text.split()


def _column(values: array) -> pa.Array:
    kind = NUMBERS[values.typecode]
    return pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(values.tobytes())])


def _lists(ends: list[int], **fields: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _texts(values: list[str]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # bytes that are no UTF-8 go back as they came
        return pa.array([v.encode("utf-8", "surrogateescape") for v in values], pa.binary()).cast(pa.string(), safe=False)


class _Finder:
    """Keys by their first unit: a place tries the lengths that keys of its unit have."""

    def __init__(self, keys: list[tuple], unit: str):
        self.char, self.numbers, self.lengths = unit == "char", {}, {}
        for number, (key, _, _, *_) in enumerate(keys):
            self.numbers[key] = (*self.numbers.get(key, ()), number)
        for head, n in sorted({(head, n) for _, head, n, *_ in keys}):
            self.lengths[head] = (*self.lengths.get(head, ()), n)

    def units(self, data: bytes | None) -> list[str] | str:
        text = (data or b"").decode("utf-8", "surrogateescape")
        return text if self.char else _tokens(text)

    def __call__(self, units: list[str] | str) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(place, units, numbers of the key) along the text."""
        count, numbers, of_head, char = len(units), self.numbers.get, self.lengths.get, self.char
        for i, head in enumerate(units):
            for n in of_head(head, ()):
                if i + n > count:
                    break
                found = numbers(head if n == 1 else units[i:i + n] if char else " ".join(units[i:i + n]))
                if found:
                    yield i, n, found


def spans_in(text: Column, keys: list[tuple[str, str, int]], unit: str) -> Column:
    """Where ``keys`` (key, its first unit, its units; distinct) stand in a text: array of (pos, n_units, key); none for null."""

    @F.arrow_udf("array<struct<pos:bigint,n_units:bigint,key:string>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find, values = _Finder(keys, unit), pa.array([k for k, _, _ in keys], pa.string())
        for batch in batches:
            pos, size, key, ends = array("q"), array("q"), array("i"), [0]
            for data in batch.cast(pa.large_binary()):
                for i, n, (number,) in find(find.units(data.as_py())):
                    pos.append(i + 1)
                    size.append(n)
                    key.append(number)
                ends.append(len(pos))
            yield _lists(ends, pos=_column(pos), n_units=_column(size), key=values.take(_column(key)))

    # A filter on the array, as ``explode`` brings one along, would else look at the texts a second time, below other steps.
    return found.asNondeterministic()(text)


def covered_by(text: Column, own: Column, entries: list[tuple], unit: str, unknown: int) -> Column:
    """The cheapest cover of a text by entries: array of (pos, n_units, src, tgt, kind); see ``cover``.

    ``entries``: (key, its first unit, its units, cost, ord, target), kind ``dict``; a key may have many.
    """
    entries = sorted(entries, key=lambda e: (e[3], e[4], e[2], e[5] is not None, e[5] or ""))

    @F.arrow_udf("array<struct<pos:bigint,n_units:bigint,src:string,tgt:string,kind:string>>")
    def tokens(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        find, kinds = _Finder(entries, unit), pa.array(["dict", "pass", "unknown"], pa.string())
        keys, _, sizes, costs, orders, targets = zip(*entries) if entries else ((),) * 6
        for texts, own in batches:
            pos, size, kind, src, tgt, ends = array("q"), array("q"), array("i"), [], [], [0]
            offsets, flags = own.offsets.to_pylist(), own.values.to_numpy(zero_copy_only=False)
            for row, data in enumerate(texts.cast(pa.large_binary())):
                units = find.units(data.as_py())
                # Entries of one place stand in the order of their numbers.
                placed = sorted((i, e) for i, _, numbers in find(units) for e in numbers)
                at, entry = [i for i, _ in placed], [e for _, e in placed]
                mine = flags[offsets[row]:offsets[row + 1]].tolist()
                for i, pick in _cover(mine, at, [sizes[e] for e in entry], [costs[e] for e in entry], [orders[e] for e in entry], unknown):
                    pos.append(i + 1)
                    if pick >= 0:
                        e = entry[pick]
                        size.append(sizes[e])
                        kind.append(0)
                        src.append(keys[e])
                        tgt.append(targets[e])
                    else:
                        size.append(1)
                        kind.append(2 if pick == UNKNOWN else 1)
                        src.append(units[i])
                        tgt.append(units[i])
                ends.append(len(pos))
            yield _lists(ends, pos=_column(pos), n_units=_column(size), src=_texts(src), tgt=_texts(tgt), kind=kinds.take(_column(kind)))

    return tokens.asNondeterministic()(text, own)


def _cover(own: list[bool], at: list[int], size: list[int], cost: list[int], order: list[int], unknown: int) -> Iterator[tuple[int, int]]:
    """(place, span) of the cheapest cover, from the left. Equal totals fall to the least ``order``, then to the first span."""
    count, s = len(own), len(at) - 1
    total, picked = [0] * (count + 1), [PASS] * count
    for i in range(count - 1, -1, -1):
        if own[i]:
            best, pick = total[i + 1] + unknown, UNKNOWN
        else:
            best, pick = total[i + 1], PASS
        rank = LAST
        while s >= 0 and at[s] > i:
            s -= 1
        while s >= 0 and at[s] == i:
            end = i + size[s]
            # A span that runs over the end of the segment does not count.
            if end <= count:
                this = cost[s] + total[end]
                if this < best or (this == best and order[s] <= rank):
                    best, pick, rank = this, s, order[s]
            s -= 1
        total[i], picked[i] = best, pick
    i = 0
    while i < count:
        pick = picked[i]
        yield i, pick
        i += size[pick] if pick >= 0 else 1


def cover(own: Column, spans: str, unknown: int) -> Column:
    """The cheapest cover of a row's units: array of (at, span), places and spans from 0, ``UNKNOWN`` or ``PASS`` where no span is taken.

    ``own`` tells which units are in the script: they cost ``unknown`` where no span covers them, the others nothing. ``spans``
    names an array, never null, of (at, n, cost, ord, ..) in order of place, cost and whatever else tells them apart.
    """

    @F.arrow_udf("array<struct<at:int,span:int>>")
    def covered(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            (own, *rest), at, span, ends = columns, array("i"), array("i"), [0]
            parts = [(c.offsets.to_pylist(), c.values.to_numpy(zero_copy_only=False)) for c in (own, *rest)]
            for row in range(len(own)):
                mine = [values[offsets[row]:offsets[row + 1]].tolist() for offsets, values in parts]
                for place, pick in _cover(*mine, unknown):
                    at.append(place)
                    span.append(pick)
                ends.append(len(at))
            yield _lists(ends, at=_column(at), span=_column(span))

    fields = [F.col(f"{spans}.{name}") for name in ("at", "n", "cost", "ord")]
    return covered.asNondeterministic()(own, *fields)
