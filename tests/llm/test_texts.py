"""Text operators against plain Python on rows with nulls, blanks, repeats, ties, long texts and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, line_dedup, simhash, sketch, substring, suffix
from tests.llm import brute as B

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, name string, spans string, words string"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def documents():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    shared = [sentence(rng, 60, vocabulary) for _ in range(4)]
    rows = [(i, sentence(rng, rng.randint(1, 120), vocabulary)) for i in range(60)]
    rows += [(60 + i, f"{sentence(rng, 20, vocabulary)} {rng.choice(shared)} {sentence(rng, 20, vocabulary)}") for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(8)]  # exact copies
    rows += [(110 + i, rows[70][1] + f" x{i}") for i in range(8)]  # near copies
    rows += [(120 + i, "\n".join(["head one", "head two", "head three", sentence(rng, 9, vocabulary), "", "", ""])) for i in range(6)]
    rows += [(130, None), (131, ""), (132, " \t\r\n "), (133, "One"), (134, "tick " * 400), (135, "ab" * 300), (136, "ab" * 200)]
    rows += [(137, sentence(rng, 30_000, vocabulary)), (138, "A b C \x1c d \x85 \U0001f600")]
    rows += [(139, "\x00" * 250), (-4, rows[20][1]), (rows[90][0], rows[90][1])]  # NUL bytes, a negative id, a row that comes twice
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs():
    return documents()


def frame(spark, rows, parts=5):
    full = [(i, t, "en", "s", len(t or ""), "x", "y", "z", "w") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def rows_by_id(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
    return out


def once(found, docs):
    """One result per id, given as often as the id comes."""
    times = {}
    for i, _ in docs:
        times[i] = times.get(i, 0) + 1
    assert {i: len(v) for i, v in found.items()} == times
    assert all(len(set(v)) == 1 for v in found.values())
    return {i: v[0] for i, v in found.items()}


def test_substring(spark, docs):
    for sizes in ({}, {"chunk": 500}, {"chunk": 100, "bucket_bytes": 1000, "merged": 50}):
        found = substring.digests(substring.cut(frame(spark, docs), **sizes))
        assert once(rows_by_id(found, "n_words", "n_removed", "kept_sha256"), docs) == B.substring(docs)


def test_substring_without_ids_and_rows(spark):
    text = "a b c d e f g h i j k l m n"
    rows = [(None, text), (None, text), (2, text), (1, text)]
    found = substring.digests(substring.cut(frame(spark, rows)))
    assert sorted((r.doc_id or 0, r.n_removed) for r in found.collect()) == [(0, 0), (0, 0), (1, 0), (2, 14)]
    assert substring.digests(substring.cut(frame(spark, rows).limit(0))).collect() == []


def test_suffix(spark, docs):
    for options in ({}, {"chunk": 3000, "job": 1500, "crowded": 1200}):
        found = suffix.digests(suffix.cut(frame(spark, docs), **options))
        assert once(rows_by_id(found, "n_bytes", "n_removed", "n_spans", "kept_sha256"), docs) == B.suffix(docs)


def test_suffix_other_sizes_and_empty(spark, docs):
    found = suffix.digests(suffix.cut(frame(spark, docs), size=77))
    assert once(rows_by_id(found, "n_bytes", "n_removed", "n_spans", "kept_sha256"), docs) == B.suffix(docs, 77)
    assert suffix.digests(suffix.cut(frame(spark, docs).limit(0))).collect() == []
    rows = [(None, "q" * 300), (None, "q" * 300)]
    assert {r.n_removed for r in suffix.digests(suffix.cut(frame(spark, rows))).collect()} == {0}


def test_suffix_short_passage_in_many_documents(spark):
    """Every document gives another segment around the passage; crowded ones collapse before they meet."""
    rng = random.Random(9)
    other = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(100, 200)))
    passage = "".join(rng.choice("ijklmnop ") for _ in range(130))
    rows = [(i, f"{other()}{passage}{other()}") for i in range(300)]
    rng.shuffle(rows)
    found = suffix.digests(suffix.cut(frame(spark, rows), chunk=3000, crowded=1200))
    assert once(rows_by_id(found, "n_bytes", "n_removed", "n_spans", "kept_sha256"), rows) == B.suffix(rows)
    segments = spark.createDataFrame(
        [(1, i, 0, len(t), bytearray(t.encode())) for i, t in rows], suffix.SEGMENT).repartition(3)
    hashes = np.concatenate([suffix._string_hashes([t.encode()], 100)[0] for _, t in rows])
    table = spark.createDataFrame([(0,)], "x int").coalesce(1).mapInArrow(lambda _: iter([sketch.sketch_of(hashes)]), sketch.SKETCH)
    may = spark.sparkContext.broadcast(sketch.repeated(table))
    sent = suffix._single(segments, 100, may).filter("bytes IS NOT NULL").groupBy("name").count().collect()
    assert len(sent) >= 31 and max(r["count"] for r in sent) <= 3


def test_line_windows(spark, docs):
    want = B.line_windows(docs)
    kept = line_dedup.dedup_lines(frame(spark, docs), length_col="n_chars")
    assert kept.columns == frame(spark, docs).columns
    rows = rows_by_id(kept, "text", "n_chars")
    assert {i: v[0] for i, v in once(rows, docs).items()} == want
    assert all(n == len(t or "") for t, n in once(rows, docs).values())
    found = once(rows_by_id(line_dedup.report(frame(spark, docs)), "kept_sha256"), docs)
    assert found == {i: (None if t is None else B.sha(t),) for i, t in want.items()}
    assert line_dedup.report(frame(spark, docs).limit(0)).collect() == []


def test_lines_of_an_id_with_two_texts(spark):
    same, own = "a\nb\nc\nd", "e\nf\ng\nh"
    rows = [(1, same), (2, same), (2, own), (2, own), (3, own), (4, None), (4, same)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    assert kept == sorted([(1, same), (2, ""), (2, own), (2, own), (3, ""), (4, None), (4, "")], key=str)
    assert sorted((r.doc_id, r.n_removed) for r in line_dedup.report(docs).collect()) == [(1, 0), (2, 0), (2, 0), (2, 4), (3, 4), (4, 0), (4, 4)]


def test_line_windows_need_no_python(spark, docs):
    plan = line_dedup.dedup_lines(frame(spark, docs))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_line_windows_overlap(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\nb\nc\nd"), (3, "a\nb\nc"), (None, "a\nb\nc"), (4, "a\nb")]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert out == {1: "a\nb\nc\nd", 2: "x", 3: "", None: "a\nb\nc", 4: "a\nb"}


def test_simhash(spark, docs):
    fps = {i: B.fingerprint(t) for i, t in docs}
    want = B.classes(fps)
    for limit in (512, 1):
        found = once(rows_by_id(simhash.near_duplicates(frame(spark, docs), limit=limit), "fingerprint", "component_id"), docs)
        assert found == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    kept = {r.doc_id for r in simhash.one_per_group(frame(spark, docs)).collect()}
    assert kept == {i for i in fps if want[i] == i}
    assert simhash.near_duplicates(frame(spark, docs).limit(0)).collect() == []


@pytest.mark.parametrize("limit", [512, 40, 2])
def test_links_lose_none(spark, limit):
    """Random fingerprints in dense and sparse places: the links join what lies within two bits, through chains too."""
    rng = random.Random(limit)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 40])):
            fps.add(base)
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
    want = B.classes({i: f for i, f in enumerate(sorted(fps))})
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    links = simhash.links(spark.createDataFrame(rows, "fp long").repartition(3), limit).collect()
    index = {r[0]: i for i, r in enumerate(rows)}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 64
        x, y = root(index[a]), root(index[b])
        parent[max(x, y)] = min(x, y)
    assert {i: root(i) for i in range(len(rows))} == want
    assert len(links) <= 70 * len(rows)


def items_of(docs):
    words = B.GRAM_WORD.findall(docs[5][1].lower()) if docs[5][1] else []
    long = next(t for _, t in docs if t and len(t.split()) > 40)
    return [
        (1, " ".join(long.split()[3:30]).upper()), (2, "Tick, tick-TICK!"), (10, " ".join(words[:13])), (3, None), (4, " .,; "),
        (5, " ".join(long.split()[5:18])), (5, " ".join(long.split()[5:18])), (None, long), (6, "one"),
    ]


def test_contamination(spark, docs):
    items = items_of(docs)
    want = B.contamination(docs, items)
    table = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, gram int")
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for size in (200_000, 7):
        found = decontaminate.contamination(frame(spark, docs), table, slice_windows=size)
        assert once(rows_by_id(found, *columns), docs) == want
    kept = decontaminate.without_contaminated(frame(spark, docs), table)
    assert kept.columns == frame(spark, docs).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]}
    none = decontaminate.contamination(frame(spark, docs), table.limit(0))
    assert none.filter("contaminated OR n_hit > 0").count() == 0 and none.count() == len(docs)
    assert decontaminate.contamination(frame(spark, docs).limit(0), table).collect() == []


def test_words_are_cut_as_the_patterns_say(spark, docs):
    for _, text in docs:
        data = (text or "").encode()
        assert [w.decode() for w in decontaminate.words_of(data)] == B.GRAM_WORD.findall((text or "").translate(B.FOLD))
        assert [w.decode() for w in data.split()] == B.WORD.findall(text or "")
    from corpusloom.llm.common import count_words
    sized = frame(spark, docs).select("doc_id", "text", count_words(F.col("text")).alias("n")).collect()
    assert all(r.n == len(B.WORD.findall(r.text or "")) for r in sized)
