"""Language profiles, archives, perplexity, top-k search, mixing and the pipeline on small rows."""

import gzip
import hashlib
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from corpusloom.llm import components, language_id, mixing, perplexity, topk, warc
from corpusloom.session import work_dir
from tests.llm import brute as B

SF_DIR = "/root/testdata/sf0.001"


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(2000, 2300)]
    links = spark.createDataFrame([*chain, *star, *star[:5], (7, 7), (None, 3), (-5, -9)], "a long, b long")
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert roots == {**{i: 0 for i in range(201)}, 1000: 1000, **{i: 1000 for i in range(2000, 2300)}, -5: -9, -9: -9}
    assert components.components(links.limit(0)).collect() == []


# --- languages

def test_language_profiles(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = spark.createDataFrame(
        [(90_000, None, "en", "s", 0), (90_001, " 12 .. 7", "en", "s", 0), (90_002, "", None, "s", 0), (90_003, "the and of", None, None, 0)],
        docs.schema)
    found = {r.doc_id: r for r in language_id.identify(docs.unionByName(extra).withColumn("score", F.lit("x"))).collect()}
    assert [found[90_000 + i].lang_pred for i in range(3)] == ["und"] * 3 and found[90_000].score == 0
    assert found[90_003].lang_pred == "en"
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in lang if found[i].held_out]
    assert 0 < len(held) < len(lang) / 2
    assert sum(found[i].lang_pred == lang[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0)).collect() == []


def test_profile_of_a_text_is_the_sum_of_its_trigrams():
    letters = language_id.Letters()
    codes = language_id.trigrams(letters("Ab, é"))
    space, a, b, e = 32, ord("a"), ord("b"), ord("é")
    want = [(space, a, b), (a, b, space), (space, e, space)]
    low = (1 << 21) - 1
    assert [(int(c) >> 42, int(c) >> 21 & low, int(c) & low) for c in codes] == want


# --- archives

def pages(spark):
    big, other = "<p>" + "x" * 1200 + "</p>", "é" * 600
    rows = [
        (1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/9", big), (3, None, other), (4, "http://a/\n4", other),
        (5, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (10, "u", "y" * 999), (11, "u", "y" * 999),
        (12, "u", "z" * 1000), (13, "u", "z" * 1000), (14, "u", "\x1f\x8b\x08" * 900 + "WARC/1.1"), (15, "u", "\r\n\r\n" + "k" * 300_000), (None, "u", big),
    ]
    return spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, size int, digest string")


def expected(rows):
    out, groups = {}, {}
    for r in rows:
        if r.page_id is not None:
            groups.setdefault((r.html or "").encode(), []).append(r.page_id)
    for payload, ids in groups.items():
        for i in ids:
            again = len(payload) >= 1000 and i != max(ids)
            out[i] = (len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", max(ids) if again else None)
    return out


def test_archives_round_trip(spark):
    table = pages(spark).repartition(4)
    want = expected(table.collect())
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(table).collect()}
    assert got == want
    assert warc.round_trip(table.limit(0)).collect() == []


@pytest.mark.parametrize("range_bytes", [1 << 30, 5000, 97])
def test_every_split_owns_its_records_once(spark, range_bytes):
    table = pages(spark)
    files = warc.write(table, work_dir(spark, "warc"), pages_per_file=2)
    rows = warc.read(spark, files, range_bytes).collect()
    assert {r.path for r in rows} == set(files) and all(sum(r.path == f for r in rows) <= 2 for f in files)
    assert sorted(r.page_id for r in rows) == sorted(expected(table.collect()))
    html = {r.page_id: (r.html or "").encode() for r in table.collect()}
    assert all(bytes(r.payload) == html[r.page_id] for r in rows if r.record_type == "response")
    assert all(bytes(r.payload) == b"" for r in rows if r.record_type == "revisit")
    for name in files:
        with gzip.open(name.removeprefix("file://")) as file:  # plain readers see the same records
            assert file.read().count(b"WARC/1.1\r\nWARC-Type") == sum(r.path == name for r in rows)


def test_damaged_members_are_passed_over(tmp_path):
    good = [warc.record("response", i, "u", 3, "d", b"abc", None) for i in range(3)]
    data = b"junk\x1f\x8b\x08" + good[0] + good[1][:40] + good[2] + b"\x1f\x8b"
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    assert [r[3] for r in warc.records_in(str(path), 0, len(data))] == [0, 2]


# --- perplexity

def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney by the book: log probability of a symbol after its history."""
    line = lambda t: [1] * (order - 1) + [int(c) for c in perplexity.Symbols()(t)]
    counts = [None] * (order + 1)
    counts[order] = {}
    for text in texts:
        s = line(text)
        for i in range(order - 1, len(s)):
            g = tuple(s[i - order + 1:i + 1])
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    discounts = []
    for k in range(order + 1):
        n = [sum(c == i for c in (counts[k] or {}).values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else i + 1 for i in range(3)] if n[0] else [0.5] * 3
        discounts.append([min(max(x, 0.05), i + 1) for i, x in enumerate(d)])

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        after = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        cut = lambda c: discounts[k][min(c, 3) - 1]
        total = sum(after.values())
        own = after[gram] - cut(after[gram]) if gram in after else 0
        return own / total + sum(map(cut, after.values())) / total * p(gram[1:])

    def nats(text):
        s = line(text)
        return -sum(math.log(p(tuple(s[i - order + 1:i + 1]))) for i in range(order - 1, len(s))), len(s) - order + 1

    return nats


TRUSTED = ["the cat sat on the mat", "The  dog sat,\non the cat 42", "a cat and a dog", "漢字 cat", "aaaa aaab", "tat"]
ASKED = [(1, "the cat"), (2, "zebra 99 the"), (3, ""), (4, None), (5, " \n "), (6, "cat 漢漢 \U0001f600"), (7, "x"), (8, "the cat"), (None, "dog")]


@pytest.mark.parametrize("entries", [1_000_000, 40])
def test_model_is_kneser_ney(spark, entries):
    texts = spark.createDataFrame([(t,) for t in TRUSTED], "text string").repartition(3)
    model, unknown = perplexity.train(texts, 4)
    nats = kneser_ney(TRUSTED, 4)
    docs = spark.createDataFrame(ASKED, "id long, text string").repartition(2)
    found = perplexity.surprise(docs, model, unknown, 4, entries).collect()
    got = {r.id: (r.nats, r.n) for r in found}
    assert len(found) == len(ASKED)
    for i, text in ASKED:
        want = nats(text) if (text or "").strip() else (0.0, 0)
        assert got[i][1] == want[1] and got[i][0] == pytest.approx(want[0], rel=1e-4)


def test_rows_that_repeat_an_id_are_scored_each(spark):
    words = ["the", "cat", "sat", "on", "a", "mat", "dog", "and"]
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, text(), "en") for i in range(300)]
    rows += [rows[7]] * 4 + [(7, "another text of id 7", "en"), (400, None, "en"), (400, None, "en"), (401, "", None), (401, "", None)]
    rows += [(None, "zq jx vk", "en")] * 3 + [(None, "the cat", "en"), (None, None, None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    found = [
        sorted((tuple(r) for r in perplexity.judged(docs, labels, shard_entries=n).collect()), key=str) for n in (4_000_000, 60)
    ]
    assert len(found[0]) == len(rows) and found[0] == found[1]


def test_peaks():
    rng = np.random.default_rng(1)
    texts = [rng.random(n) for n in (0, 5, 16, 17, 0, 40, 3)]
    want = [max((t[i:i + 16].sum() for i in range(max(1, len(t) - 15))), default=0) for t in texts]
    assert perplexity._peaks(np.concatenate(texts), np.array([len(t) for t in texts])).tolist() == pytest.approx(want)


def test_a_few_insults_in_a_long_text(spark):
    rng = random.Random(4)
    parts = ["th", "er", "on", "an", "re", "the ", "nd ", "ed, ", "ing ", "of ", "at. "]
    text = lambda n: "".join(rng.choice(parts) for _ in range(n))
    rows = [(i, text(rng.randint(50, 900)), "en") for i in range(600)]
    rows += [(1000 + i, f"{text(1500)}worthless scum, you pathetic clown {text(1500)}", "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    lost = {r.doc_id for r in perplexity.judged(docs, labels).filter("NOT keep").collect()}
    assert {1000 + i for i in range(5)} <= lost and len(lost) <= 5 + 30


def test_decisions_of_scores(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["en", "en", "de", None, "rare"]) if i else "alone", bool(i and rng.random() < 0.4), 0.0, 0 if i % 17 == 3 else rng.randrange(1, 900)) for i in range(400)]
    rows = [(i, g, c, n * rng.gauss(2.2, 0.2), n, min(n, 16) * rng.gauss(3.5, 0.5)) for i, g, c, _, n in rows]
    schema = "id long, lang string, calibrates boolean, nats double, n long, peak double"
    for part in (rows, rows[:9], rows[:1], [(i, g, False, *r) for i, g, _, *r in rows]):
        found = {r.id: r.keep for r in perplexity.decided(spark.createDataFrame(part, schema)).collect()}
        assert found == B.decisions(part)
    assert not all(B.decisions(rows).values())


def test_production_values_reject_on_the_smallest_table(spark):
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, SF_DIR).collect()}
    bad = {r.doc_id for r in labels.filter("quality = 0 OR toxic = 1").collect()}
    clean = {r.doc_id for r in labels.filter("quality = 1 AND toxic = 0").collect()}
    assert len(bad - kept) >= len(bad) / 2 and len(clean & kept) >= 0.95 * len(clean)


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rng = random.Random(1)
    junk = [(70_000 + i, "".join(chr(rng.randint(33, 126)) for _ in range(600)), "en", "s", 600) for i in range(5)]
    odd = [(80_000, None, "en", "s", 0), (80_001, "", None, None, 0), (80_002, "x", "xx", "s", 1)]
    more = docs.unionByName(spark.createDataFrame(junk + odd, docs.schema)).withColumn("keep", F.lit("no")).withColumn("n", F.lit(1))
    kept = perplexity.accepted(more, labels)
    assert kept.columns == more.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {j[0] for j in junk} and {o[0] for o in odd} <= ids
    good = {r.doc_id for r in perplexity.trusted_ids(labels).withColumnRenamed("good_id", "doc_id").collect()}
    assert len(good & ids) >= 0.97 * len(good)
    untrained = perplexity.judged(docs, labels.limit(0))
    assert untrained.filter("keep").count() == docs.count()
    assert perplexity.judged(docs.limit(0), labels).collect() == []


# --- search

def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(60)]  # ties
    rows += [(1000, None), (1020, [0.5, None]), (1040, [float("nan")] * 8), (1060, [float("inf")] + [0.0] * 7), (1080, []), (1100, [1.0] * 3)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, v int, query int").repartition(4)
    want = B.top_k(rows)
    for options in ({}, {"shard_rows": 37, "query_rows": 5}):
        found = topk.search(table, F.col("id") % 20 == 0, **options)
        assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == want
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.search(few, F.col("id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()) == B.top_k(rows[:4])
    assert topk.search(few.limit(0), F.col("id") % 20 == 0).collect() == []


def test_top_k_with_large_numbers(spark):
    rows = [(i, [float(2**50 + i), float(-(2**49) * i)]) for i in range(0, 60, 5)]
    few = spark.createDataFrame([(i, [x / 2**31 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    want = B.top_k([(i, [x / 2**31 for x in v]) for i, v in rows])
    assert sorted(tuple(r) for r in topk.search(few, F.col("id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()) == want


# --- mixing

def mixed(spark, rows):
    table = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, source string, size int, target int").repartition(4)
    return mixing.mix(table).collect()


def check_mix(found, rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(B.WORD.findall(text or ""))
    want, taken, largest = B.targets(sizes), {}, {}
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and (r.taken == 0 or r.taken % r["size"] == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    assert sum(taken.values()) <= sum(sizes.values())
    return {s: abs(taken[s] - want[s]) for s in taken}, largest


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["b", "a", "é", "Z", "漢", "\U0001f600", None])) for i in range(600)]
    rows += [(1000 + i, "w " * 20, "hot") for i in range(400)] + [(5000, None, "a"), (5001, " \n", "a"), (None, "x y", "b"), (7, rows[7][1], rows[7][2])]
    found = mixed(spark, rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in found) == sorted(
        (i is None, i or 0, len(B.WORD.findall(t or ""))) for i, t, _ in rows)
    off, largest = check_mix(found, rows)
    assert all(off[s] <= 3 * largest[s] for s in off)
    assert sorted(map(tuple, mixed(spark, rows)), key=repr) == sorted(map(tuple, found), key=repr)


def test_mixing_caps(spark):
    # A heavy source with few words stops at three times its size, and the others share the rest.
    rows = [(i, "w", "a") for i in range(4)] + [(100 + i, "w w", "b") for i in range(100)] + [(300 + i, "w", "c") for i in range(100)]
    found = mixed(spark, rows)
    off, _ = check_mix(found, rows)
    assert {r.taken for r in found if r.source == "a"} == {3} and all(x <= 2 for x in off.values())


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", None)]])
def test_mixing_nothing(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(table).collect()] == [(0, 0.0, 0)] * len(rows)


# --- entry and pipeline

def test_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11))
    assert "pipeline" in entry.queries()


def test_pipeline(spark):
    docs = pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()]
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = corpus_pipeline.quality_classifier(spark, frame, SF_DIR)
    assert kept.columns == frame.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert len(texts) >= 0.8 * len(docs)
    lines = B.line_windows(list(texts.items()))
    fps = {i: B.fingerprint(t) for i, t in lines.items()}
    classes = B.classes(fps)
    alone = {i: lines[i] for i in classes if classes[i] == i}
    clean = {i for i, w in B.contamination(list(alone.items()), items).items() if not w[4]}
    out = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id: r["size"] for r in out} == {i: len(B.WORD.findall(alone[i])) for i in clean}
    source = {r["doc_id"]: r["source"] for r in docs}
    check_mix(out, [(i, alone[i], source[i]) for i in clean])
    assert [name for name, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_every_stage_takes_no_rows_and_nulls(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (5, None, "en", "s", None), (6, "", None, None, 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).collect() == [], name
        out = stage(spark, odd, SF_DIR)
        assert out.count() == (2 if "SimHash" in name else 3), name
