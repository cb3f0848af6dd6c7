"""Plain readings of the operators over Python lists; nothing here is shared with the library."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib

import xxhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
GRAM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def contamination(docs, items, n=13):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)"""
    grams = {}
    for item, text in items:
        words = GRAM_WORD.findall((text or "").translate(FOLD))
        if item is not None and words:
            size = min(n, len(words))
            for i in range(len(words) - size + 1):
                grams.setdefault(tuple(words[i:i + size]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    out = {}
    for doc, text in docs:
        words, hit, found = GRAM_WORD.findall((text or "").translate(FOLD)), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                items_of = grams.get(tuple(words[i:i + size]))
                if items_of:
                    hit |= set(range(i, i + size))
                    found |= items_of
        out[doc] = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words))
    return out


def fingerprint(text):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, distance=2):
    """id -> smallest id it is linked with; fps: id -> fingerprint. Quadratic over distinct fingerprints."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    words = sorted(set(fps.values()))
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    low = {}
    for doc, fp in fps.items():
        low[root(fp)] = min(low.get(root(fp), doc), doc)
    return {doc: low[root(fp)] for doc, fp in fps.items()}


def substring(docs, n=13):
    """doc_id -> (n_words, n_removed, kept_sha256)"""
    words = {d: WORD.findall(t or "") for d, t in docs}
    low = {}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            key = tuple(w[i:i + n])
            low[key] = min(low.get(key, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if low[tuple(w[i:i + n])] < d:
                gone |= set(range(i, i + n))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def suffix(docs, size=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)"""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        if d in out:
            continue
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            key = hashlib.blake2b(data[i:i + size], digest_size=16).digest()
            if key in seen:
                gone[i:i + size] = b"\x01" * size
            else:
                seen.add(key)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[d] = (len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g)))
    return out


def line_windows(docs, size=3):
    """doc_id -> text without the lines covered by windows of ``size`` lines that occur earlier."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        if d in out or t is None:
            out.setdefault(d, None)
            continue
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - size + 1):
            key = tuple(lines[i:i + size])
            if key in seen:
                gone |= set(range(i, i + size))
            seen.add(key)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def top_k(vectors, every=20, k=20):
    """[(query_id, rank, vec_id, score)]"""
    import math
    kept = {
        v: [math.floor(64 * float(x)) for x in e] for v, e in vectors
        if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    }
    out = []
    for q, a in sorted(kept.items()):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in kept.items() if v != q)[:k]
            out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scored)]
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """source -> target; sizes: source -> words."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        now = {s: float(most * sizes[s]) if s in capped else rest * weight[s] / share for s in order}
        over = {s for s in order if s not in capped and now[s] > most * sizes[s]}
        if not over:
            return now
        capped |= over


# --- quality

def decisions(rows, quantile=0.999, prior=100, pooled=50, stretch=16):
    """(id, lang, calibrates, nats, n, peak) rows to {id: keep} by lists."""
    def limit(values):
        return sorted(values)[max(math.ceil(quantile * len(values)), 1) - 1]

    seen = [r for r in rows if r[2] and r[4] > 0]
    if not seen:
        return {r[0]: True for r in rows}
    langs = {r[1] for r in rows}
    size = {g: sum(r[1] == g for r in seen) for g in langs}
    overall = sum(r[3] for r in seen) / sum(r[4] for r in seen)
    drawn = {}
    for lang in langs:
        mine = [r for r in seen if r[1] == lang]
        own = sum(r[3] for r in mine) / sum(r[4] for r in mine) if mine else 0
        mean = (own * size[lang] + overall * pooled) / (size[lang] + pooled)
        for i, g, _, nats, n, peak in rows:
            if g == lang and n > 0:
                drawn[i] = ((nats + mean * prior) / (n + prior), (peak + mean * prior) / (min(n, stretch) + prior))
    keep = {r[0]: True for r in rows}
    for part in (0, 1):
        all_together = limit([drawn[r[0]][part] for r in seen])
        for lang in langs:
            values = [drawn[r[0]][part] for r in seen if r[1] == lang]
            bound = ((limit(values) * len(values) if values else 0) + all_together * pooled) / (len(values) + pooled)
            for r in rows:
                if r[1] == lang and r[0] in drawn and drawn[r[0]][part] > bound * (1 + 1e-12):
                    keep[r[0]] = False
    return keep


# --- conversations

def damage(rows):
    """The contract's damage on (conv, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repair(rows):
    """(turn, role, text) of one conversation to (gaps, blank, duplicate, truncated, illegal, cost, audit, hash), all edits tried."""
    rows = sorted(((t, r, x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    legal = re.compile("(s?(ua)+)?")
    queue, done = [(0, "", 0, ())], {}
    best = None
    while queue:  # cheapest first, then by audit; a place is left once for each end that matters
        cost, audit, at, out = heapq.heappop(queue)
        said = "".join(r[:1] for r, _ in out)
        key = (at, said[-1:], "s" in said)
        if key in done:
            continue
        done[key] = True
        if at == len(rows) and legal.fullmatch(said):
            best = (cost, audit, out)
            break
        steps = [(3, "I", 0, (name, "")) for name in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            steps.append((4, "D", 1, None))
            if faults[at] in ("", "truncated"):
                more = 3 if faults[at] else 0
                steps += [(more, "K", 1, (role, text)), (3 + more, "R", 1, ("user", text)), (3 + more, "R", 1, ("assistant", text))]
        for price, edit, moved, line in steps:
            after = out if line is None else (*out, line)
            so_far = "".join(r[:1] or "?" for r, _ in after)
            if re.fullmatch("(s?(ua)*u?)?", so_far):
                heapq.heappush(queue, (cost + price, audit + edit, at + moved, after))
    count = faults.count
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, best[0], best[1],
            sha("\n".join(f"{r}:{x}" for r, x in best[2])))


# --- manifest

def manifest(rows, fanout=3):
    """(doc_id, source, lang, n_chars, text) rows to the contract's rows, by lists."""
    def h(*parts):
        return sha("".join(parts))

    def leaf(row):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h(*last[i:i + fanout]) for i in range(0, len(last), fanout)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            first = at // fanout * fanout
            out.append((level[first:at], level[at + 1:first + fanout]))
            at //= fanout
        return out

    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        mine = sorted(sources[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = (mine, grow([leaf(r) for r in mine]))
    top = grow([trees[s][1][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        mine, levels = trees[source]
        for i, row in enumerate(mine):
            way = path(levels, i) + path(top, k)
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            node = leaf((*row[:4], row[4].replace("\n", "") if even and row[4] is not None else row[4]))
            for left, right in way:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in way for x in (*left, *right)])
            out.append((row[0], levels[0][i], levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out
