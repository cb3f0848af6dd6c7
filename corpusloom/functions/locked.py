"""Locked names written into texts: an Arrow helper that takes a batch of texts with the locks of their chapters at once.

Replacements go one after the other, those of long sources first. Where no source of a chapter can reach from what is written into
what stands beside it, this is the same as to choose places of sources in the text, in that order and from the left, none of which meets
one chosen before, and to write each target, in which the later replacements of the chapter have been made likewise. So the places are
looked for once, in the distinct words of some texts (a source without blanks stands inside a word), and a text is put together from
pieces of words and written targets. All other texts are written by one pass for each replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.terms import BLANK, PIECE, _by_length, _distinct, _laid_out, _of_each, _places, _words, numbers

#: Bytes of texts whose words are gathered together, and of written texts that are given back together.
GATHERED = 1 << 21
GIVEN = 1 << 26
#: Rows times sources that are marked in one table.
TABLE = 1 << 24
#: Places of sources of a text that are chosen together with those of others, as bytes of text; longer texts are written one by one.
CHOSEN = 1 << 20
#: Written targets that are kept for the next texts.
KEPT = 1 << 22


class _Part:
    """Texts of some rows as pieces of a table: where each row's start in ``at``, and how many bytes come before each piece."""

    def __init__(self, rows: np.ndarray, first: np.ndarray, at: np.ndarray, table: pa.LargeBinaryArray):
        self.rows, self.at, self.table = rows, at, table
        before = np.concatenate([[0], np.cumsum(np.diff(_laid_out(table)[1])[at])])
        self.first, self.ends = first, before[first]

    def texts(self, low: int, high: int) -> pa.LargeBinaryArray:
        """Of the rows from the one at place ``low`` to before ``high``."""
        data, offsets = _laid_out(self.table.take(pa.array(self.at[self.first[low]:self.first[high]])))
        ends = self.ends[low:high + 1] - self.ends[low] + int(offsets[0])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(ends), pa.py_buffer(data)])


class _Writer:
    """Replacement pairs in their order, and how they are written into texts."""

    def __init__(self, pairs: list[tuple[str, str]], of: list[list[int]]):
        self.pairs = [(s.encode(), d.encode()) for s, d in pairs]
        # The pairs of each raw form, one list after the other, and pairs with one source, which stand next to each other.
        self.listed = np.array([p for own in of for p in own], np.int64)
        self.first = np.cumsum([0, *map(len, of)])
        new = np.array([i == 0 or s != pairs[i - 1][0] for i, (s, _) in enumerate(pairs)], bool)
        self.source = np.cumsum(new) - 1
        sources = [s for (s, _), one in zip(self.pairs, new) if one]
        self.size = np.array([len(s) for s in sources], np.int64)
        self.blank = np.array([min(s) <= BLANK for s in sources], bool)
        self.lengths = _by_length(sources)
        # Sources of one length in characters stand next to each other.
        chars = np.array([len(s) for (s, _), one in zip(pairs, new) if one], np.int64)
        self.levels = np.flatnonzero(np.diff(chars, prepend=-1, append=-1))
        self.reaching, self.reached = self._beside(pairs)
        # The places of later sources in each target.
        data, ends = self._joined([d for _, d in self.pairs])
        pair, place, term = self._found(data, ends)
        later = term > self.source[pair]
        pair, place, term = pair[later], place[later], term[later]
        order = np.lexsort((place, term, pair))
        self.inner = list(zip((place - ends[pair])[order].tolist(), term[order].tolist()))
        self.inner_of = np.searchsorted(pair[order], np.arange(len(pairs) + 1)).tolist()
        # What is written for a pair depends on the chapter's targets of these sources only.
        self.deep = np.unique(term)
        self.forget()

    def forget(self) -> None:
        self.signs, self.spelled, self.known = {}, [], np.zeros((0, len(self.pairs)), np.int32)

    @staticmethod
    def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(values), np.uint8), np.cumsum([0, *map(len, values)])

    @staticmethod
    def _beside(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Two bit sets of each pair that share a bit if the source of one can reach into what stands beside the target of the other: it
        holds the target's first character after its own first, or the last before its last. An empty target makes its neighbours meet."""
        opens, closes = {d[:1] for _, d in pairs}, {d[-1:] for _, d in pairs}
        late, early = {c for s, _ in pairs for c in s[1:]}, {c for s, _ in pairs for c in s[:-1]}
        bit = {c: i for i, c in enumerate(sorted([(0, c) for c in opens & late] + [(1, c) for c in closes & early]))}
        empty = len(bit)
        target, source = np.zeros((len(pairs), empty + 1), bool), np.zeros((len(pairs), empty + 1), bool)
        for i, (s, d) in enumerate(pairs):
            target[i, [bit[x] for x in ((0, d[:1]), (1, d[-1:])) if x in bit]] = True
            source[i, [bit[x] for x in {*((0, c) for c in s[1:]), *((1, c) for c in s[:-1])} if x in bit]] = True
            target[i, empty] = source[i, empty] = not d
        return np.packbits(target, axis=1), np.packbits(source, axis=1)

    def used(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and pair of all that is to be replaced, in order; of several targets of a source only the least."""
        row, number = numbers(found)
        at, size = _of_each(self.first, number)
        row, pair = np.divmod(_distinct(np.repeat(row * len(self.pairs), size) + self.listed[at]), max(len(self.pairs), 1))
        other = (np.diff(row, prepend=-1) != 0) | (np.diff(self.source[pair], prepend=-1) != 0)
        return row[other], pair[other]

    def _found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, place and source of all places where a source starts."""
        out = [(row + low, place, term) for low, _, found in _places(self.lengths, data, offsets) for row, place, term in found]
        return tuple(np.concatenate([x[i] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64) for i in range(3))

    def _chosen(self, place: np.ndarray, term: np.ndarray, size: int) -> np.ndarray:
        """Which places are replaced, of those of all sources in ``size`` bytes: by source, from the left, none that meets one before."""
        taken, chosen = bytearray(size), np.zeros(place.size, bool)
        marks = np.frombuffer(taken, np.uint8)
        order = np.argsort(term * size + place)
        upto = np.searchsorted(term[order], self.levels)
        for start, stop in zip(upto, upto[1:]):
            at = order[start:stop]
            # One taken before is not shorter, so it lies over the first or the last character.
            at = at[(marks[place[at]] | marks[place[at] + self.size[term[at]] - 1]) == 0]
            from_left = at[np.argsort(place[at])]
            meets = place[from_left][:-1] + self.size[term[from_left]][:-1] > place[from_left][1:]
            beside = np.zeros(at.size, bool)
            beside[:-1] |= meets
            beside[1:] |= meets
            free = from_left[~beside]
            chosen[free] = True
            for i in range(int(self.size[term[free]].max(initial=0))):
                marks[place[free][self.size[term[free]] > i] + i] = 1
            contested = np.zeros(place.size, bool)
            contested[from_left[beside]] = True
            at = at[contested[at]]
            for i, low, high in zip(at.tolist(), place[at].tolist(), (place[at] + self.size[term[at]]).tolist()):
                if not (taken[low] or taken[high - 1]):
                    taken[low:high] = b"\1" * (high - low)
                    chosen[i] = True
        return chosen

    def _pieces(self, data: np.ndarray, offsets: np.ndarray, place: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces start (and the last ends) when texts are cut around the chosen places, the source of each (-1: none), and the first
        piece of each text."""
        low, high = int(offsets[0]), int(offsets[-1])
        chosen = self._chosen(place - low, term, high - low)
        place, term = place[chosen], term[chosen]
        cut = np.zeros(high - low + 1, bool)
        for x in (offsets, place, place + self.size[term]):
            cut[x - low] = True
        cut[-1] = True
        cuts = np.flatnonzero(cut) + low
        of = np.full(cuts.size - 1, -1, np.int64)
        of[np.searchsorted(cuts, place)] = term
        return cuts, of, np.searchsorted(cuts, offsets)

    def _part(self, rows: np.ndarray, texts: tuple[np.ndarray, np.ndarray], pieces: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray,
              row: np.ndarray, table: np.ndarray, sign: np.ndarray) -> _Part:
        """The texts of ``rows`` out of the pieces of their words ``ids``, which are of the rows ``row`` (in order)."""
        cuts, of, first = pieces
        at, size = _of_each(first, ids)
        row = np.repeat(row, size)
        source = of[at]
        named = np.flatnonzero(source >= 0)
        written = self._written(sign[row[named]], table[row[named], source[named]])
        at[named] = written + cuts.size - 1
        plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), cuts.size - 1, [None, pa.py_buffer(cuts), pa.py_buffer(texts[0])])
        return _Part(rows, np.searchsorted(row, [*rows, rows[-1] + 1]), at, pa.concat_arrays([plain, pa.array(self.spelled, pa.large_binary())]))

    def _signs(self, table: np.ndarray) -> np.ndarray:
        """A number for each row's targets of the sources that stand in targets."""
        sign = np.array([self.signs.setdefault(own.tobytes(), len(self.signs)) for own in table[:, self.deep]], np.int64)
        more = np.full((len(self.signs) - len(self.known), len(self.pairs)), -1, np.int32)
        self.known = np.concatenate([self.known, more]) if more.size else self.known
        return sign

    def _written(self, sign: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Numbers in ``spelled`` of what is written for pairs."""
        wanted = np.zeros(self.known.shape, bool)
        wanted[sign, pair] = True
        wanted &= self.known < 0
        signs, of_sign, targets = list(self.signs), -1, {}
        for one, of in np.argwhere(wanted).tolist():
            if one != of_sign:
                of_sign, targets = one, dict(zip(self.deep.tolist(), np.frombuffer(signs[one], np.int32).tolist()))
            # Targets that stand in it come first; each is of a later source.
            open_ = [of]
            while open_:
                last = open_[-1]
                if self.known[one, last] < 0:
                    inside = self._inside(last, targets)
                    missing = [p for _, _, p in inside if self.known[one, p] < 0]
                    if missing:
                        open_ += missing
                        continue
                    value, out, end = self.pairs[last][1], [], 0
                    for low, high, p in inside:
                        out += value[end:low], self.spelled[self.known[one, p]]
                        end = high
                    self.known[one, last] = len(self.spelled)
                    self.spelled.append(b"".join([*out, value[end:]]))
                open_.pop()
        return self.known[sign, pair].astype(np.int64)

    def _inside(self, pair: int, targets: dict[int, int]) -> list[tuple[int, int, int]]:
        """Start, end and pair of the places of a pair's target that are replaced."""
        out, taken = [], set()
        for low, term in self.inner[self.inner_of[pair]:self.inner_of[pair + 1]]:
            span = range(low, low + len(self.pairs[targets[term]][0])) if targets[term] >= 0 else ()
            if span and taken.isdisjoint(span):
                taken.update(span)
                out.append((low, span.stop, targets[term]))
        return sorted(out)

    def one_by_one(self, data: bytes, used: np.ndarray) -> bytes:
        for source, target in map(self.pairs.__getitem__, used.tolist()):
            # Most pairs are there, so one pass that cuts is less than one that counts and one that replaces.
            data = target.join(data.split(source))
        return data

    def _parts(self, texts: pa.LargeBinaryArray, row: np.ndarray, pair: np.ndarray) -> list[_Part]:
        """The texts that can be put together; those without replacements are none of them."""
        count, size = len(texts), np.diff(_laid_out(texts)[1])
        if not row.size:
            return []
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        reach = np.bitwise_or.reduceat(self.reaching[pair], starts) & np.bitwise_or.reduceat(self.reached[pair], starts)
        whole = np.zeros(count, bool)
        whole[row[starts]] = ~reach.any(axis=1)
        whole &= size <= CHOSEN
        across = np.zeros(count, bool)
        across[row[self.blank[self.source[pair]]]] = True
        table = np.full((count, self.size.size), -1, np.int32)
        table[row, self.source[pair]] = pair
        sign, out = self._signs(table), []
        shared = np.flatnonzero(whole & ~across)
        if shared.size:
            laid = _laid_out(texts.take(pa.array(shared)))
            cuts, words, ids = _words(*laid)
            distinct = _laid_out(words)
            # Where few words come again (or are not parted by blanks), the texts themselves are hardly more to look at.
            if 2 * int(distinct[1][-1]) <= int(laid[1][-1] - laid[1][0]):
                of = np.repeat(shared, np.diff(np.searchsorted(cuts, laid[1])))
                word, place, term = self._found(*distinct)
                across |= self._others(word, term, ids, of, table)
                kept = ~across[of]
                if kept.any():
                    out.append(self._part(shared[~across[shared]], distinct, self._pieces(*distinct, place, term), ids[kept], of[kept], table, sign))
            else:
                across[shared] = True
        own = np.flatnonzero(whole & across)
        for some in np.split(own, np.flatnonzero(np.diff(np.cumsum(size[own]) // CHOSEN)) + 1) if own.size else ():
            laid = _laid_out(texts.take(pa.array(some)))
            at, place, term = self._found(*laid)
            there = table[some[at], term] >= 0
            out.append(self._part(some, laid, self._pieces(*laid, place[there], term[there]), np.arange(some.size), some, table, sign))
        return out

    def _others(self, word: np.ndarray, term: np.ndarray, ids: np.ndarray, of: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Rows in whose words sources stand that are not theirs; ``of``: the rows of the words ``ids``."""
        word, term = np.divmod(_distinct(word * self.size.size + term), self.size.size)
        first = np.searchsorted(word, np.arange(ids.max(initial=-1) + 2))
        others, upto = np.zeros(len(table), bool), np.cumsum(np.diff(first)[ids])
        steps = np.searchsorted(upto, np.arange(0, upto[-1] if upto.size else 0, PIECE), "right").tolist()
        for start, stop in zip(steps, [*steps[1:], ids.size]):
            at, size = _of_each(first, ids[start:stop])
            row = np.repeat(of[start:stop], size)
            others[row[table[row, term[at]] < 0]] = True
        return others

    def _some(self, texts: pa.LargeBinaryArray, row: np.ndarray, pair: np.ndarray) -> Iterator[pa.LargeBinaryArray]:
        if self.known.size + len(self.spelled) > KEPT:
            self.forget()
        parts, first = self._parts(texts, row, pair), np.searchsorted(row, np.arange(len(texts) + 1))
        sizes = np.full(len(texts), -1, np.int64)
        for part in parts:
            sizes[part.rows] = np.diff(part.ends)
        low, size, single = 0, 0, {}
        for i, known in enumerate(sizes.tolist()):
            if known < 0:
                single[i] = self.one_by_one(texts[i].as_py(), pair[first[i]:first[i + 1]])
            size += known if known >= 0 else len(single[i])
            if size > GIVEN or i == len(texts) - 1:
                rows, out = [np.array([*single], np.int64)], [pa.array(single.values(), pa.large_binary())]
                for part in parts:
                    start, stop = np.searchsorted(part.rows, [low, i + 1])
                    if start < stop:
                        rows.append(part.rows[start:stop])
                        out.append(part.texts(start, stop))
                rows, out = np.concatenate(rows), pa.concat_arrays(out) if len(single) or len(out) != 2 else out[1]
                yield out if (np.diff(rows) > 0).all() else out.take(pa.array(np.argsort(rows)))
                low, size, single = i + 1, 0, {}

    def written(self, texts: pa.Array, found: pa.Array) -> Iterator[pa.Array]:
        data = texts.fill_null("").cast(pa.large_binary())
        ends, low = _laid_out(data)[1], 0
        if not len(texts):
            yield texts
        while low < len(texts):
            high = int(np.searchsorted(ends, ends[low] + GATHERED, "right")) - 1
            count = max(min(high, low + TABLE // max(self.size.size, 1), len(texts)), low + 1) - low
            for some in self._some(data.slice(low, count), *self.used(found.slice(low, count))):
                given = some.cast(pa.binary()).cast(pa.string(), safe=False)
                null = texts.slice(low, len(given)).is_null()
                yield pc.if_else(null, pa.scalar(None, pa.string()), given) if texts.null_count else given
                low += len(given)


def locked_in(text: Column, found: Column, pairs: list[tuple[str, str]], of: list[list[int]]) -> Column:
    """A text after the replacements of its locks, one after the other, each at every place from the left.

    ``found``: the numbers of ``numbers_in`` for a text's chapter (null: none). ``of`` has for each of its numbers the
    places of its replacements in ``pairs`` (source, target), which are distinct and ordered by length of the source, longest first,
    source and target. Of several targets of a source the first is written. Null texts stay null.
    """

    @F.arrow_udf("string")
    def done(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        writer = _Writer(pairs, of)
        for texts, found in batches:
            yield from writer.written(texts, found)

    return done.asNondeterministic()(text, found)
