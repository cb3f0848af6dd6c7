"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if a string of ``size`` (100) bytes that covers it also starts earlier: in a document with a smaller id, or
earlier in the same one. Strings never cross documents and are judged on the input.

1. Candidates. Each string is named by the smallest hash of its 32-byte substrings, so equal strings have equal names.
   Runs of neighbouring strings with one name are a segment. A count-min sketch of the places that give names says which
   names may occur twice; no other segment can hold a repeated string. See ``sketch``.
2. Segments of those names are sent with their bytes. Equal segments of a task keep only their first, which loses to
   nothing but an earlier one; the later ones are settled as spans at once.
3. Segments with equal names meet in one task, in jobs of bounded size. A job cuts its segments into shards, sorts the
   rotations of each shard, and merges the shards' transforms by refining their interleave: from the order by the first
   t bytes follows the order by the first t + 16, by a stable sort on the 16 bytes before each rotation, until ``size``
   bytes are compared (the last steps take what is left over). No rotations are sorted again. Neighbours not split by then have a common prefix of ``size``
   bytes: a repeated interval, in which all but the first start are removed.
4. Segments of a name with more than ``CROWDED`` bytes are cut into their single strings. A second sketch drops those that
   come once; of equal ones a task sends one, so a passage inside any number of documents is a few rows a task. They
   meet by a hash of all their bytes and are compared by the bytes.

Hash collisions only add candidates; equality is decided by the transforms on the bytes themselves.

Cases: a null text has no bytes; shorter texts stay whole; rows with a null id stay whole and do not count; rows that
repeat an id and its text are one document and are cut alike; no rows give no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import covered, documents, mixed, packed, rows_of, runs, unpacked
from corpusloom.llm.sketch import SKETCH, repeated, sketch_of
from corpusloom.session import checkpointed

GRAM, WORD, STRIDE = 32, 8, 16
#: What closes a rotation; strings that run over it are never compared.
CLOSE = bytes(1)
#: Rows given out at a time.
GIVEN = 4096
#: Bytes of text hashed at a time, strings of a segment, bytes of a merge job, of one of its shards, and of a crowded name.
CHUNK, RUN, JOB, SHARD, CROWDED = 2_000_000, 2048, 130_000, 65_000, 8_000_000

#: Odd factors of the doubling steps.
FACTORS = {
    1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xC2B2AE3D27D4EB4F), 4: np.uint64(0x165667B19E3779F9),
    8: np.uint64(0xD6E8FEB86659FD93), 16: np.uint64(0xA0761D6478BD642F),
}


def gram_hashes(data: np.ndarray, salt: int) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling; mixed, so that the smallest is a fair choice."""
    letters = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * salt))
    out, width = letters[data], 1
    while width < GRAM:
        factor = FACTORS[width] + np.uint64(2 * salt)
        out = out[:-width] * factor + out[width:]
        width *= 2
    return mixed(out)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


class Chunk:
    """Documents end to end with the name of every string; names of strings over an end are left out."""

    def __init__(self, ids: list[int], texts: list[bytes], size: int, salt: int):
        self.ids, self.size = np.array(ids, np.int64), size
        self.text = b"".join(texts)
        self.data = np.frombuffer(self.text, np.uint8)
        lengths = np.array([len(t) for t in texts])
        self.first = np.cumsum(lengths) - lengths
        self.hashes = gram_hashes(self.data, salt)
        self.names = sliding(self.hashes, size - GRAM + 1, np.minimum)
        count = lengths - size + 1
        inside = np.zeros(len(self.names) + size, np.int8)
        inside[self.first] += 1
        np.add.at(inside, self.first + count, -1)
        self.inside = np.cumsum(inside[:len(self.names)], dtype=np.int8) > 0

    def places(self) -> np.ndarray:
        """Hashes at the places that give some string its name, once for each such place; mixed, as the smallest crowd low."""
        width = self.size - GRAM + 1
        named = np.where(self.inside, self.names, np.uint64(0))
        edge = np.zeros(width - 1, np.uint64)
        most = sliding(np.concatenate((edge, named, edge)), width, np.maximum)
        return mixed(self.hashes[self.hashes == most[:len(self.hashes)]])

    def segments(self, may) -> tuple[np.ndarray, ...]:
        """Names, document indexes, starts in the text and numbers of strings of runs that may hold repeated strings."""
        start = np.ones(len(self.names), bool)
        start[1:] = (self.names[1:] != self.names[:-1]) | ~self.inside[:-1]
        start[np.minimum(self.first, len(start) - 1)] = True
        begin = np.flatnonzero(start & self.inside)
        if not len(begin):
            return (begin,) * 4
        edges = np.flatnonzero(start | ~self.inside)
        after = np.searchsorted(edges, begin, "right")
        end = np.append(edges, len(self.names))[after]
        chosen = may(mixed(self.names[begin]))
        begin, end = begin[chosen], end[chosen]
        pieces = -(-(end - begin) // RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, end = np.repeat(begin, pieces) + nth * RUN, np.repeat(end, pieces)
        count = np.minimum(end - begin, RUN)
        return self.names[begin], np.searchsorted(self.first, begin, "right") - 1, begin, count


def _chunks(batches, size, limit, salt=0):
    ids, texts, held = [], [], 0
    for doc, text in rows_of(batches, "id", "text"):
        if doc is None or text is None or len(text) < size:
            continue
        ids.append(doc)
        texts.append(text)
        held += len(text)
        if held >= limit:
            yield Chunk(ids, texts, size, salt)
            ids, texts, held = [], [], 0
    if ids:
        yield Chunk(ids, texts, size, salt)


def _rank(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class Shard:
    """Segments as rotations, each closed by zeros, sorted by at least ``size`` bytes, with the bytes before them."""

    def __init__(self, segments: list[bytes], size: int):
        padded = [s + CLOSE for s in segments]
        data = np.frombuffer(b"".join(padded), np.uint8)
        lengths = np.array([len(p) for p in padded], np.int32)
        first = np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        length = np.repeat(lengths, lengths)
        place = np.arange(len(data), dtype=np.int32) - first

        def ahead(values, steps):
            at = place + steps % length
            return values[first + np.where(at >= length, at - length, at)]

        front, width = data.astype(np.uint64), 1
        while width < WORD:
            front = front << np.uint64(8 * width) | ahead(front, width)
            width *= 2
        eight, rank = front, _rank(front)
        while width < size:
            other = ahead(rank, width)
            rank = _rank(rank * (int(other.max()) + 1) + other)
            width *= 2
        self.order = np.argsort(rank, kind="stable")
        #: The WORD bytes before each rotation and the WORD bytes before those, in sorted order.
        self.before = ahead(eight, length - WORD % length)[self.order]
        self.far = ahead(eight, length - 2 * WORD % length)[self.order]


def _short(symbols: np.ndarray) -> list[np.ndarray]:
    """Symbols as ranks in parts of 16 bits, the low part first: sorts of short numbers are radix sorts."""
    rank = _rank(symbols)
    parts = [(rank & 0xFFFF).astype(np.uint16)]
    return parts + [(rank >> 16).astype(np.uint16)] if rank.max(initial=0) >> 16 else parts


def merge(shards: list[Shard], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all shards, end to end, in merged order, and the number of each row's block of equal ``size``-byte prefixes."""
    kind = np.uint8 if len(shards) < 256 else np.uint16
    owner = np.concatenate([np.full(len(s.order), i, kind) for i, s in enumerate(shards)])
    by_owner = np.arange(len(owner), dtype=np.int32)
    turn, row, block = owner, by_owner, np.zeros(len(owner), np.int32)
    before, far = np.concatenate([s.before for s in shards]), np.concatenate([s.far for s in shards])
    low = _rank(before)
    steps = [_short(_rank(far) * (int(low.max()) + 1) + low)] * (size // STRIDE)
    rest = size % STRIDE
    if rest >= WORD:
        steps.append(_short(low))
    if rest % WORD:
        steps.append(_short(before & np.uint64((1 << 8 * (rest % WORD)) - 1)))
    for parts in steps:
        # Rows go by what stands before them, and stay in their order where that is equal.
        moved = np.argsort(parts[0][row], kind="stable")
        if len(parts) > 1:
            moved = moved[np.argsort(parts[1][row[moved]], kind="stable")]
        turn, source, front = turn[moved], block[moved], row[moved]
        new = np.zeros(len(row), bool)
        new[1:] = source[1:] != source[:-1]
        for part in parts:
            symbol = part[front]
            new[1:] |= symbol[1:] != symbol[:-1]
        # The rows of a shard stand in its own order, whatever the interleave.
        row = np.empty_like(by_owner)
        row[np.argsort(turn, kind="stable")] = by_owner
        block = np.cumsum(new, dtype=np.int32)
    return row, block


def repeated_starts(segments: list[tuple[int, int, bytes]], size: int, shard_bytes: int = SHARD) -> list[np.ndarray]:
    """For each segment (sorted by document and start): which of its strings start earlier in another or the same one."""
    groups, held = [[]], 0
    for _, _, data in segments:
        if held >= shard_bytes:
            groups.append([])
            held = 0
        groups[-1].append(data)
        held += len(data)
    shards = [Shard(g, size) for g in groups]
    row, block = merge(shards, size)
    # Place of every row in the padded text of all shards, end to end.
    offset = np.cumsum([0] + [len(s.order) for s in shards])
    place = np.concatenate([s.order + o for s, o in zip(shards, offset)])[row]
    lengths = np.array([len(d) for _, _, d in segments])
    padded = lengths + len(CLOSE)
    first = np.cumsum(padded) - padded
    starts = covered(int(padded.sum()), first, first + lengths - size + 1)
    real = starts[place]
    place, block = place[real], block[real]
    low = np.full(int(block.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, block, place)
    lost = np.zeros(int(padded.sum()), bool)
    lost[place[place > low[block]]] = True
    return [lost[a:a + n - size + 1] for a, n in zip(first.tolist(), lengths.tolist())]


#: A segment, or (bytes null) the span start to end that is settled.
SEGMENT = "name long, id long, start int, end int, bytes binary"
SEGMENT_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, SEGMENT_KINDS)], ["name", "id", "start", "end", "bytes"])


def _twice(data: bytes) -> bool:
    """Whether an aligned GRAM of the segment stands elsewhere in it too; each string of 2 * GRAM - 1 bytes or more holds one."""
    return any(
        data.find(data[i:i + GRAM]) < i or data.find(data[i:i + GRAM], i + 1) >= 0 for i in range(0, len(data) - GRAM + 1, GRAM))


def _share(a: bytes, b: bytes, size: int) -> bool:
    """Whether a string of ``size`` bytes may stand in both: if one does, a block of half of it, aligned in a, stands in b."""
    half = size // 2
    return any(a[i:i + half] in b for i in range(0, len(a) - half + 1, half)) if half >= 8 else True


def _chosen(docs: DataFrame, size: int, chunk: int, may) -> DataFrame:
    """Segments that may hold repeated strings; of those that are equal in a chunk, the first and the others' spans."""

    def choose(batches):
        for part in _chunks(batches, size, chunk):
            names, docs_of, begin, count = part.segments(may.value.may)
            first: dict[bytes, tuple] = {}
            out = []
            every = sorted(zip(part.ids[docs_of].tolist(), (begin - part.first[docs_of]).tolist(), names.view(np.int64).tolist() if len(names) else [],
                               begin.tolist(), count.tolist()))
            for doc, start, name, at, n in every:
                data = part.text[at:at + n + size - 1]
                known = first.setdefault(data, (doc, start, name))
                if known == (doc, start, name):
                    out.append((name, doc, start, start + n + size - 1, data))
                elif known[:2] != (doc, start):
                    out.append((name, doc, start, start + n + size - 1, None))
            yield _segment_batch(out)

    return docs.mapInArrow(choose, SEGMENT)


def _settled(segments: DataFrame, size: int, job: int, crowded: int) -> DataFrame:
    """Spans, and (bytes not null) the segments of names too crowded for one job."""

    def distinct(group):
        """Of equal segments the first; spans of the others. A row that comes twice counts once."""
        rows, first = [], {}
        for name, doc, start, end, data in sorted(group, key=lambda s: s[1:3]):
            known = first.setdefault(data, (name, doc, start, end, data))
            if known[1:3] != (doc, start):
                rows.append((name, doc, start, end, None))
        return rows, list(first.values())

    def merged(held):
        held.sort(key=lambda s: s[1:3])
        rows = []
        for (name, doc, start, _, _), lost in zip(held, repeated_starts([(d, s, b) for _, d, s, _, b in held], size)):
            for a, b in zip(*(x.tolist() for x in runs(lost))):
                rows.append((name, doc, start + a, start + b + size - 1, None))
        return rows

    def settle(batches):
        held, held_bytes, group, group_bytes, now, over, out = [], 0, [], 0, None, False, []
        for row in itertools.chain(rows_of(batches, "name", "id", "start", "end", "bytes"), [None]):
            if len(out) >= GIVEN:
                yield _segment_batch(out)
                out = []
            if row is not None and row[4] is None:
                out.append(row)
                continue
            if row is None or row[0] != now:
                if over:
                    out += group
                elif group:
                    rows, kept = distinct(group) if len(group) > 1 else ([], group)
                    out += rows
                    if len(kept) <= 4:  # names shared by chance do not go into a merge
                        kept = [
                            k for i, k in enumerate(kept)
                            if _twice(k[4]) or any(_share(k[4], o[4], size) for j, o in enumerate(kept) if j != i)
                        ]
                    held += kept
                    held_bytes += sum(len(k[4]) for k in kept)
                if held and (row is None or held_bytes >= job):
                    out += merged(held)
                    held, held_bytes = [], 0
                if row is None:
                    break
                group, group_bytes, now, over = [], 0, row[0], False
            group.append(row)
            group_bytes += len(row[4])
            if group_bytes > crowded:
                over = True
                yield _segment_batch(group)
                group, group_bytes = [], 0
        yield _segment_batch(out)

    dealt = segments.repartition("name").sortWithinPartitions("name")
    return dealt.mapInArrow(settle, SEGMENT)


def _string_hashes(segments: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all strings of the segments, end to end, and where each segment's begin and end."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    grams = gram_hashes(data, 0)
    count = len(data) - size + 1
    total = np.zeros(count, np.uint64)
    for at in [*range(0, size - GRAM, GRAM), size - GRAM]:
        total = total * FACTORS[8] + grams[at:at + count]
    lengths = np.array([len(s) for s in segments])
    first = np.cumsum(lengths) - lengths
    return mixed(total), first, first + lengths - size + 1


def _single(segments: DataFrame, size: int, may, held: int = CHUNK) -> DataFrame:
    """Segments as single strings that may come twice, named by all their bytes; of equal ones of a task only the first, and
    spans of the others, as long as the strings held stay below ``held`` bytes."""

    def split(batches):
        known: dict[bytes, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            rows = sorted(rows_of([batch], "id", "start", "bytes"), key=lambda s: s[:2])
            hashes, first, end = _string_hashes([data for _, _, data in rows], size)
            maybe, names = may.value.may(hashes), hashes.view(np.int64)
            for (doc, start, data), a, b in zip(rows, first.tolist(), end.tolist()):
                lost = np.zeros(b - a, bool)
                for i in np.flatnonzero(maybe[a:b]).tolist():
                    string, place = data[i:i + size], (doc, start + i)
                    before = known.get(string)
                    if before is None:
                        known[string] = (int(names[a + i]), *place)
                    elif before[1:] < place:
                        lost[i] = True
                    elif before[1:] > place:
                        out.append((*before, before[2] + size, None))
                        known[string] = (before[0], *place)
                out += [(0, doc, start + x, start + y + size - 1, None) for x, y in zip(*(x.tolist() for x in runs(lost)))]
                if len(known) * size > held:
                    out += [(*k, k[2] + size, string) for string, k in known.items()]
                    known.clear()
                if len(out) >= GIVEN:
                    yield _segment_batch(out)
                    out = []
            yield _segment_batch(out)
        yield _segment_batch([(*k, k[2] + size, string) for string, k in known.items()])

    return segments.mapInArrow(split, SEGMENT)


def _singles_settled(strings: DataFrame) -> DataFrame:
    """Spans of all strings but the first of equal ones; a task holds the distinct strings of one name, whose bytes differ
    by chance only."""

    def settle(batches):
        now, first = None, {}
        for batch in batches:
            out = []
            for name, doc, start, end, data in rows_of([batch], "name", "id", "start", "end", "bytes"):
                if name != now:
                    now, first = name, {}
                if first.setdefault(data, (doc, start)) != (doc, start):
                    out.append((name, doc, start, end, None))
            yield _segment_batch(out)

    return strings.repartition("name").sortWithinPartitions("name", "id", "start").mapInArrow(settle, SEGMENT)


def lost_spans(docs: DataFrame, size: int = 100, chunk: int = CHUNK, job: int = JOB, crowded: int = CROWDED) -> DataFrame:
    """(id, start, end) in bytes of what goes from documents (id, text)."""

    def count(batches):
        for part in _chunks(batches, size, chunk):
            yield sketch_of(part.places())

    may = docs.sparkSession.sparkContext.broadcast(repeated(docs.mapInArrow(count, SKETCH)))
    found = checkpointed(_settled(_chosen(docs, size, chunk, may), size, job, crowded))
    spans, left = found.filter("bytes IS NULL"), found.filter("bytes IS NOT NULL")
    if not left.isEmpty():
        def count_strings(batches):
            for batch in batches:
                if batch.num_rows:
                    yield sketch_of(_string_hashes(batch.column(batch.schema.get_field_index("bytes")).to_pylist(), size)[0])

        twice = docs.sparkSession.sparkContext.broadcast(repeated(left.mapInArrow(count_strings, SKETCH)))
        strings = checkpointed(_single(left, size, twice))
        spans = spans.unionByName(strings.filter("bytes IS NULL")).unionByName(
            checkpointed(_singles_settled(strings.filter("bytes IS NOT NULL"))))
    return spans.select("id", "start", "end")


def cut(docs: DataFrame, size: int = 100, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, job: int = JOB,
        crowded: int = CROWDED) -> DataFrame:
    """(id, n_bytes, n_removed, kept binary, removed array of (start, end)) for every document row."""
    texts = documents(docs, id_col, text_col)
    span = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("end").cast("long"))
    spans = lost_spans(texts, size, chunk, job, crowded).groupBy(F.col("id").alias("of")).agg(F.collect_list(span).alias("spans"))

    def apply(batches):
        for batch in batches:
            out = []
            for doc, text, found in rows_of([batch], "id", "text", "spans"):
                data = unpacked(text) or b""
                if found:
                    both = np.array(found, np.int64)
                    gone = covered(len(data), both >> 32, both & 0xFFFFFFFF)
                    a, b = runs(gone)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    out.append((doc, len(data), int(gone.sum()), kept, [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())]))
                else:
                    out.append((doc, len(data), 0, data, []))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "n_bytes", "n_removed", "kept", "removed"])

    joined = packed(texts).join(spans, F.col("id") == F.col("of"), "left").select("id", "text", "spans")
    return joined.mapInArrow(
        apply, "id long, n_bytes long, n_removed long, kept binary, removed array<struct<start: int, end: int>>")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result of ``cut`` with the kept bytes as SHA-256."""
    return found.select(
        F.col("id").alias(id_col), "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
