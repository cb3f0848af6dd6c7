"""Keyed helpers, spans, gloss and edit mining against plain Python."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import keyed as KY
from corpusloom.functions.arrays import differences
from corpusloom.operators import catalog as A
from corpusloom.operators import lexicon as L
from corpusloom.operators import locks as O
from corpusloom.operators import memory as M


def test_position_and_running_total_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i * 3 % 1009, i, rng.randrange(10)) for i in range(2000)]
    rows.append((None, 5, 2001, 1))
    frame = spark.createDataFrame(rows, "k string, o int, tie int, v int")
    order, bucket = [F.col("o"), F.col("tie")], F.floor(F.col("o") / 50)
    out = KY.running_total(frame, ["k"], order, bucket, F.col("v"), "total")
    out = KY.position(out, ["k"], order, bucket, "pos")
    seen, totals = Counter(), Counter()
    want = {}
    for k, o, tie, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        seen[k] += 1
        totals[k] += v
        want[tie] = (seen[k], totals[k])
    assert {r.tie: (r.pos, r.total) for r in out.collect()} == want


def test_top_per_key_limits_before_the_shuffle(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = KY.top_per_key(frame, ["k"], [F.col("id").desc()], 2)
    assert sorted(r.id for r in top.collect()) == [994, 995, 996, 997, 998, 999]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_last_n_before(spark):
    rng = random.Random(5)
    events = [(f"k{i % 3}", rng.randrange(300), i) for i in range(200)]
    rows = [(f"k{i % 4}", i * 7 % 320, i) for i in range(60)]
    ev = spark.createDataFrame(events, "k string, w int, e int")
    ch = spark.createDataFrame(rows, "k string, at int, id int")
    out = KY.last_n_before(ch, ev, ["k"], "at", "w", 3, [F.col("e")], 16, F.col("e"), "ctx", ["k", "at", "id"]).collect()
    assert len(out) == len(rows)
    for r in out:
        before = [e for k, w, e in sorted(events, key=lambda x: (x[1], x[2])) if k == r.k and w < r["at"]]
        assert (r.ctx or []) == before[-3:]


def plain_spans(text, keys):
    return {(i + 1, len(k), k) for k in keys for i in range(len(text)) if text.startswith(k, i)}


def plain_gloss(text, entries, readings, script):
    """Least cost from the right, ties to the longest entry, then reading, then unknown."""
    n = len(text)
    cost, best = [0.0] * (n + 1), [None] * n
    for i in range(n - 1, -1, -1):
        if text[i] not in script:
            cost[i], best[i] = cost[i + 1], (1, "pass")
            continue
        options = []
        for key, (tier, priority) in entries.items():
            if text.startswith(key, i):
                options.append((1.0 * len(key) + 0.05 - 0.3 * tier + 0.002 * priority + cost[i + len(key)], 1000 - len(key), len(key), "dict"))
        if text[i] in readings:
            options.append((4.0 + 0.05 + cost[i + 1], 2000, 1, "reading"))
        options.append((60.0 + 0.05 + cost[i + 1], 3000, 1, "unknown"))
        total, _, size, kind = min(options)
        cost[i], best[i] = total, (size, kind)
    out, i = [], 0
    while i < n:
        size, kind = best[i]
        out.append((i + 1, size, kind))
        i += size
    return out, cost[0]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("甲乙丙丁戊x ", min_size=0, max_size=25), min_size=1, max_size=12),
       st.dictionaries(st.text("甲乙丙丁", min_size=1, max_size=4), st.tuples(st.integers(0, 2), st.integers(0, 9)), min_size=1, max_size=10))
def test_spans_and_gloss(spark, texts, entries):
    segments = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lexicon = spark.createDataFrame([(k, t, p) for k, (t, p) in entries.items()], "key string, tier int, priority int")
    found = L.match_spans(segments, lexicon, ["id"], start="[甲乙丙丁戊]")
    got = {(r.id, r.pos, r.n_units, r.key) for r in found.collect()}
    assert got == {(i, *s) for i, text in enumerate(texts) for s in plain_spans(text, entries)}
    readings = {"甲": "giáp", "戊": "mậu"}
    known = found.select("id", "pos", "n_units", "key", F.lit("dict").alias("kind"), F.upper("key").alias("target"), "tier", "priority")
    read = L.match_spans(segments, spark.createDataFrame(list(readings.items()), "key string, target string"), ["id"])
    both = known.unionByName(read.select("id", "pos", "n_units", "key", F.lit("reading").alias("kind"), "target"), allowMissingColumns=True)
    tokens = L.gloss(segments, both, ["id"], script="[甲乙丙丁戊]").collect()
    for i, text in enumerate(texts):
        mine = sorted((t.pos, t.n_units, t.kind) for t in tokens if t.id == i)
        want, total = plain_gloss(text, entries, readings, "甲乙丙丁戊")

        def price(cover):
            out = 0.0
            for pos, size, kind in cover:
                key = text[pos - 1:pos - 1 + size]
                if kind == "dict":
                    out += len(key) + 0.05 - 0.3 * entries[key][0] + 0.002 * entries[key][1]
                out += {"reading": 4.05, "unknown": 60.05}.get(kind, 0.0)
            return out

        assert "".join(t.src for t in sorted((t for t in tokens if t.id == i), key=lambda t: t.pos)) == text
        assert price(mine) == pytest.approx(total) and (mine == want or price(mine) == pytest.approx(price(want)))


def test_replaced_in(spark):
    """Replacements in their order equal SQL's, whatever a batch gives back at a time; pairs without a source do nothing."""
    from corpusloom.functions import terms as W

    draw = random.Random(3)
    words = ["a", "aa", "ab", "龍", "b龍", "T", "\U00020001"]
    pairs = [[(draw.choice(words), draw.choice(["Ta", "", "龍b", "\U00020001"])) for _ in range(draw.choice([0, 1, 6]))] for _ in range(60)]
    rows = [(i, "".join(draw.choice("aab龍T\U00020001") for _ in range(draw.choice([0, 3, 60]))), p) for i, p in enumerate(pairs)] + [(60, None, [("a", "b")])]
    frame = spark.createDataFrame(rows, "id int, text string, p array<struct<src:string,dst:string>>").repartition(2)
    want = {r.id: r.text for r in frame.select("id", O.replace_pairs(F.col("text"), F.col("p")).alias("text")).collect()}
    whole = W.GIVEN
    try:
        for W.GIVEN in (whole, 50):
            got = frame.select("id", W.replaced_in(F.col("text"), F.col("p")).alias("text")).collect()
            assert {r.id: r.text for r in got} == want and len(got) == len(rows)
    finally:
        W.GIVEN = whole
    odd = spark.createDataFrame([("abc", [("", "x"), (None, "x"), ("b", None), ("c", "d")])], "text string, p array<struct<src:string,dst:string>>")
    assert odd.select(W.replaced_in(F.col("text"), F.col("p")).alias("t")).first().t == "abd"


def test_numbers_packed_and_read_again():
    """Steps around multiples of 255, rows without numbers, and a slice of the array."""
    import numpy as np

    from corpusloom.functions.terms import numbers, packed

    lists = [[0], [], [254, 255, 256], [253, 508, 763, 764], [], [0, 255, 510, 100_000], [1_000_000], []]
    row = np.array([i for i, own in enumerate(lists) for _ in own], np.int64)
    binaries = packed(row, np.array([n for own in lists for n in own], np.int64), len(lists))
    for low in (0, 2, 7):
        got = list(zip(*(x.tolist() for x in numbers(binaries.slice(low)))))
        assert got == [(i, n) for i, own in enumerate(lists[low:]) for n in own]


@pytest.mark.parametrize("sizes", [{}, {"GATHERED": 300, "GIVEN": 500, "CHOSEN": 100, "KEPT": 10, "PIECE": 64}])
def test_locks_written_into_texts(monkeypatch, sizes):
    """Texts out of pieces equal one replacement after the other: sources that overlap, stand in targets or reach into their neighbours, empty
    targets, blanks in sources, targets that share a source, locks that stand in no text, texts without words that come again."""
    import numpy as np
    import pyarrow as pa

    from corpusloom.functions import locked as W
    from corpusloom.functions.terms import packed

    draw, ways = random.Random(8), Counter()
    for name, value in sizes.items():
        monkeypatch.setattr(W, name, value)
    single, part = W._Writer.one_by_one, W._Writer._part
    monkeypatch.setattr(W._Writer, "one_by_one", lambda *a: ways.update(single=len(a[2]) > 0) or single(*a))
    monkeypatch.setattr(W._Writer, "_part", lambda *a: ways.update(["own" if np.array_equal(a[4], np.arange(a[1].size)) else "shared"]) or part(*a))
    cases = [(letters, targets) for letters in ("abT ", "abcg ", "abgr", "龍鳳é ", "aT\n b", "xyzabc龍용 ")
             for targets in (["T1", "T22", "T333"], ["Tab1", "bTa", "ab"], ["", "X"], ["Long", "용", "Qa龍1"], ["Z1aab2", "Z3 a4b5", "Zcabc9"])]
    for letters, targets in cases * 3:
        word = lambda low, high: "".join(draw.choice(letters) for _ in range(draw.randint(low, high)))  # noqa: E731, B023
        names = sorted({w for w in (word(1, draw.choice([2, 6])) for _ in range(draw.choice([1, 5, 80]))) if w.strip() in (w, "")} | {"a"}, key=str.encode)
        names = [n for n in names if " " not in n] if draw.random() < 0.5 else names
        pairs = sorted({(n, draw.choice(targets)) for n in names for _ in range(draw.choice([1, 1, 3]))}, key=lambda p: (-len(p[0]), p[0].encode(), p[1].encode()))
        of = [[i for i, p in enumerate(pairs) if p[0] == n][:draw.choice([1, 2])] + [draw.randrange(len(pairs))] * (draw.random() < 0.1) for n in names]
        known = [word(1, 8).strip() or "a" for _ in range(20)]
        texts = [draw.choice([None, "", word(0, 40), *[" ".join(draw.choice(known) for _ in range(draw.choice([5, 60])))] * 5]) for _ in range(draw.choice([1, 60]))]
        strange = draw.random() < 0.3
        found = [draw.choice([None, [], sorted(draw.sample(range(len(of)), draw.randint(0, len(of))))]) if strange else
                 [i for i, n in enumerate(names) if n in (t or "")] for t in texts]
        binaries = [f and packed(np.zeros(len(f), np.int64), np.array(f, np.int64), 1)[0].as_py() for f in found]
        given = W._Writer(pairs, of).written(pa.array(["x", *texts]).slice(1), pa.array([b"", *(b or None for b in binaries)], pa.binary()).slice(1))
        for text, own, got in zip(texts, found, (t for some in given for t in some.to_pylist()), strict=True):
            best = {}
            for source, target in sorted({pairs[p] for n in own or [] for p in of[n]}, reverse=True):
                best[source] = target
            for source in sorted(best, key=lambda s: (-len(s), s.encode())):
                text = text and text.replace(source, best[source])
            assert got == text
    assert ways["single"] and ways["own"] and ways["shared"]


@pytest.mark.parametrize("unit", ["char", "token"])
def test_spans_and_cover_by_row_and_by_join(spark, unit):
    """A lexicon in the rows and one that is joined give the same spans and the same cover, keys with many entries included."""
    draw = random.Random(11)
    words = ["甲", "乙", "x", "丙\U00020001", "1."]
    texts = [draw.choice(["", " ", "\u3000"]).join([draw.choice(words) + draw.choice(["", " ", "\x1c", "\xa0", "\n"]) for _ in range(draw.choice([0, 1, 7, 70]))])
             for _ in range(40)] + [None, "", " \n"]
    entries = [("甲", "a", 0, 1), ("甲", "b", 1, 0), ("甲", None, 1, 0), ("甲 乙", "ab", 0, 0), ("甲乙", "AB", 0, 0), ("x", "", 0, 0), ("乙 x 甲", "c", 2, 5),
               ("乙x甲", "C", 2, 5), ("x  x", "never as a token", 0, 0), ("", "none", 0, 0), ("1.\x1c甲", "d", 0, 9), (None, "none", 0, 0)]
    segments = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    lexicon = spark.createDataFrame(entries, "key string, target string, tier int, priority int")
    for start, longest in ((None, None), ("[甲x]", 2)):
        row, join = (L.match_spans(segments, lexicon, ["id"], unit=unit, start=start, longest=longest, in_row=n) for n in (L.IN_ROW, 0))
        assert row.columns == join.columns and sorted(map(repr, row.collect())) == sorted(map(repr, join.collect())) != []
    script = "[甲乙丙]"
    row, join = (L.gloss_rows(segments, lexicon, ["id"], unit=unit, script=script, in_row=n) for n in (L.IN_ROW, 0))
    assert sorted(map(repr, row.collect())) == sorted(map(repr, join.collect())) != []
    assert row.count() < len(texts) and L.gloss_rows(segments, lexicon.limit(0), ["id"], unit=unit).count() == row.count()


def test_cover_of_bytes_that_are_no_text(spark):
    broken = spark.sql("SELECT 1 AS id, cast(X'E794B220FFC320E794B2' AS string) AS text")
    rows = L.gloss_rows(broken, spark.createDataFrame([("甲", "a", 0, 0)], "key string, target string, tier int, priority int"), ["id"], unit="token")
    assert rows.selectExpr("id", "transform(tokens, t -> hex(t.src)) s").first().s == ["E794B2", "FFC3", "E794B2"]


def test_long_gloss_segment_stays_linear(spark):
    text = "甲乙" * 20000
    segments = spark.createDataFrame([(1, text)], "id int, text string")
    lexicon = spark.createDataFrame([("甲乙", 0, 0)], "key string, tier int, priority int")
    spans = L.match_spans(segments, lexicon, ["id"]).select(
        "id", "pos", "n_units", F.lit("dict").alias("kind"), F.lit("t").alias("target"), "tier", "priority")
    tokens = L.gloss(segments, spans, ["id"])
    assert tokens.count() == 20000


def test_gloss_chain(spark):
    """Map, memory, numbers, entries and readings: a remembered segment is its translation, the others their cheapest cover."""
    segments = spark.createDataFrame(
        [(1, "甲乙丙一二丁x", "p"), (2, "记住了", "p"), (3, "", "p"), (4, None, "q"), (5, "戊 abc", "q"), (6, "記住了", "q")], "id int, text string, scope string")
    entries = spark.createDataFrame([("甲乙", "AB", 0, 0), ("乙丙", "BC", 0, 0), ("丙", "C", 1, 0)], "key string, target string, tier int, priority int")
    readings = spark.createDataFrame([("丁", "đinh"), ("丙", "bính"), ("戊己", "none")], "key string, target string")
    charmap = spark.createDataFrame([("記", "记")], "trad string, simp string")
    memory = segments.filter("id = 2").select(M.raw_hash(F.col("text")).alias("raw_hash"), F.lit("p").alias("project_scope"), F.lit("kept in mind").alias("translated_text"))
    rows = L.gloss_chain(segments, entries, memory, ["id"], charmap, readings).collect()
    assert sorted((r.id, r.via, r.draft, r.total_units, r.matched_units) for r in rows) == [
        (1, "cover", "AB C 12 đinh x", 6, 6), (2, "memory", "kept in mind", 3, 3), (3, "cover", "", 0, 0), (4, "cover", "", 0, 0),
        (5, "cover", "戊 abc", 1, 0), (6, "memory", "kept in mind", 3, 3)]


def test_draft_text(spark):
    rows = [(1, 1, "dict", "Phương Nguyên"), (1, 3, "dict", "tu luyện"), (1, 5, "pass", "a"), (1, 6, "pass", "b"),
            (1, 7, "pass", "，"), (1, 8, "dict", ""), (1, 9, "dict", "linh khí"), (1, 11, "pass", "。")]
    frame = spark.createDataFrame(rows, "id int, pos int, kind string, tgt string")
    assert L.draft_text(frame, ["id"]).first().draft == "Phương Nguyên tu luyện ab， linh khí。"


@pytest.mark.parametrize("in_row", [L.IN_ROW, 0])
def test_present_terms(spark, in_row):
    docs = spark.createDataFrame([(1, "abcdef"), (1, "abzz"), (2, "xxcdxx"), (3, ""), (4, "zz"), (5, None), (None, "ab"),
                                  (6, "a\r\nb \U00020000\U00020001\U00020002龍 a"), (6, "?")], "id int, text string")
    terms = ["ab", "cd", "f", "abcdef", "q", "zz", "", None, "ab", "defg", "\r\nb", "\U00020001\U00020002龍 a", "\U00020001", "a\nb", "??"]
    want = {(1, "ab"), (1, "cd"), (1, "f"), (1, "abcdef"), (1, "zz"), (2, "cd"), (4, "zz"), (6, "\r\nb"),
            (6, "\U00020001\U00020002龍 a"), (6, "\U00020001")}
    for more in (0, 12_000):  # the many share one head, and chapter 2 holds none of them
        frame = spark.createDataFrame([(t,) for t in terms + [f"xxcd{i}" for i in range(more)]], "term string")
        found = L.present_terms(docs, frame, ["id"], in_row=in_row).collect()
        assert {(r.id, r.term) for r in found} == want and len(found) == len(want)
    assert L.present_terms(docs, frame.limit(0), ["id"], in_row=in_row).count() == 0


def test_terms_in_pieces_of_a_batch():
    """Pieces cut texts and rows anywhere, and terms of all lengths up to 40 bytes are found in their own row only."""
    import numpy as np

    from corpusloom.functions import terms as W

    draw = random.Random(5)
    texts = ["".join(draw.choice("ab龍") for _ in range(draw.choice([0, 1, 5, 60, 400]))) for _ in range(60)]
    wanted = sorted({"".join(draw.choice("ab龍") for _ in range(n)).encode() for n in range(1, 8) for _ in range(8)}
                    | {t[i:i + n].encode() for t in texts if len(t) >= 60 for i, n in ((3, 9), (8, 16), (20, 20), (0, 40))})
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    want = [r * len(wanted) + i for r, t in enumerate(texts) for i, w in enumerate(wanted) if w in t.encode()]
    whole = W.PIECE, W.MARKS
    try:
        for W.PIECE, W.MARKS in (whole, (64, 1 << 26), (100, 0)):
            assert W._pairs(W._by_length(wanted), len(wanted), data, offsets).tolist() == want
    finally:
        W.PIECE, W.MARKS = whole


def test_terms_in_distinct_words(monkeypatch):
    """Terms with and without blanks are found in any batch, and the bytes looked at are those of its distinct words."""
    import numpy as np

    from corpusloom.functions import terms as W

    def batch(texts):
        return np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])

    def found(wanted, texts):
        blank = np.array([min(w) <= W.BLANK for w in wanted], bool)
        return W._found(W._by_length(wanted, ~blank), W._by_length(wanted, blank), len(wanted), *batch(texts)).tolist()

    draw = random.Random(7)
    letters = "ab龍 \n\x00\u00a0\u3000"
    texts = ["", " ", "a", " a", "a ", *("".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 5, 60, 400]))) for _ in range(60)), ""]
    wanted = sorted({"".join(draw.choice(letters) for _ in range(n)).encode() for n in range(1, 8) for _ in range(12)}
                    | {t[i:i + n].encode() for t in texts if len(t) >= 60 for i, n in ((3, 9), (8, 16), (0, 40))})
    want = [r * len(wanted) + i for r, t in enumerate(texts) for i, w in enumerate(wanted) if w in t.encode()]
    for gathered, piece, marks in ((W.GATHERED, W.PIECE, W.MARKS), (1, 64, 1 << 26), (500, 100, 0)):
        for name, value in (("GATHERED", gathered), ("PIECE", piece), ("MARKS", marks)):
            monkeypatch.setattr(W, name, value)
        assert found(wanted, texts) == want
        assert found([b"a"], ["", ""]) == [] and found([b"a"], []) == [] and found([], texts) == []
    monkeypatch.undo()

    looked, places = [], W._OfLength.places
    monkeypatch.setattr(W._OfLength, "places", lambda self, data, *rest: looked.append(data.size - 16) or places(self, data, *rest))
    many = [" ".join(draw.choice("one two three four".split()) for _ in range(50)) for _ in range(200)]
    assert found([b"hre"], many) == [r for r, t in enumerate(many) if "hre" in t]
    assert sum(looked) <= len("one two three four ") + len("one two three four")


def test_a_text_is_looked_at_once(spark):
    docs = spark.createDataFrame([(1, "ab"), (1, "bc")], "id int, text string").repartition(2)
    found = L.present_terms(docs, spark.createDataFrame([("b",), ("c",)], "term string"), ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
    assert sorted(found.collect()) == [(1, "b"), (1, "c")]


def test_map_chars(spark):
    docs = spark.createDataFrame([(1, "見龍在田"), (2, ""), (3, "龍龍"), (3, "見"), (None, "龍"), (4, None)], "id int, text string")
    pairs = [("見", "见"), ("龍", "龙"), ("田", "(田)"), ("在", ""), ("x", None)]
    for more in (0, 25_000):
        charmap = spark.createDataFrame(pairs + [(chr(0x20000 + i), "a") for i in range(more)], "trad string, simp string")
        got = sorted(L.map_chars(docs, charmap).collect(), key=str)
        assert [(r.id, r.text) for r in got] == sorted(
            [(1, "见龙(田)"), (2, ""), (3, "龙龙"), (3, "见"), (None, "龙"), (4, None)], key=lambda r: f"Row(id={r[0]}, text={r[1]!r})")
    none = spark.createDataFrame([], "trad string, simp string")
    assert {r.text for r in L.map_chars(docs, none).collect()} == {r.text for r in docs.collect()}


def test_mine_edits(spark):
    pairs = [("a b c d", "a x c d"), ("b q", "x q"), ("same", "same"), ("w " * 40 + "e", "z " * 40 + "e"), ("", "x"), ("a a", "a"),
             ("p " * 300 + "b q", "p " * 300 + "x q"), (None, "x")]
    rows = A.mine_edits(spark.createDataFrame(pairs, "draft string, final string"), "draft", "final", 2).collect()
    assert {(r.original, r.refined): (r.edits, r.proposed) for r in rows} == {("b", "x"): (3, True)}


def test_mine_every_edit_of_a_pair(spark):
    words = [f"w{i}" for i in range(16)]
    final = ["one", *words[1:14], "two", "words", words[15]]
    rows = A.mine_edits(spark.createDataFrame([(" ".join(words), " ".join(final))], "draft string, final string"), "draft", "final").collect()
    assert {(r.original, r.refined) for r in rows} == {("w0", "one"), ("w14", "two words")}


def test_differences_are_fewest(spark):
    """Stretches put together give both texts, and no alignment changes fewer words."""
    rng = random.Random(1)
    pairs = [([], []), (["a"], []), ([], ["b"]), (["a"], ["b"]), ([f"w{i}" for i in range(3000)], [f"w{i}" for i in range(3000) if i not in (7, 2000)])]
    for _ in range(120):
        a = [rng.choice("abcd") for _ in range(rng.randrange(25))]
        b = list(a) if rng.random() < .6 else [rng.choice("abcd") for _ in range(rng.randrange(25))]
        for _ in range(rng.randrange(4) if b else 0):
            b[rng.randrange(len(b))] = rng.choice("abxy")
        pairs.append((a, b))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
            row = now
        return row[-1]

    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    for r in frame.select("i", differences(F.col("a"), F.col("b")).alias("found")).collect():
        a, b = pairs[r.i]
        x = y = changed = 0
        for s in r.found:
            assert a[x:s.a_from] == b[y:s.b_from] and (s.a_to > s.a_from or s.b_to > s.b_from)
            changed += s.a_to - s.a_from + s.b_to - s.b_from
            x, y = s.a_to, s.b_to
        assert a[x:] == b[y:] and (len(a) > 1000 or changed == len(a) + len(b) - 2 * common(a, b))


def test_merge_runs(spark):
    rng = random.Random(9)
    rows = sorted({(f"k{rng.randrange(2)}", rng.randrange(120)) for _ in range(150)})
    out = L.merge_runs(spark.createDataFrame(rows, "k string, p int"), ["k"], "p", width=16).collect()
    want = set()
    for key in ("k0", "k1"):
        places = [p for k, p in rows if k == key]
        begin = None
        for i, p in enumerate(places):
            begin = p if begin is None or places[i - 1] != p - 1 else begin
            if i + 1 == len(places) or places[i + 1] != p + 1:
                want.add((key, begin, p, p - begin + 1))
                begin = None
    assert {(r.k, r.run_start, r.run_end, r.n) for r in out} == want


def test_recent_context_puts_undated_events_last(spark):
    events = spark.createDataFrame([("n", i, f"e{i}") for i in range(8)] + [("n", None, "u1"), ("n", None, "u2")],
                                   "n string, idx int, e string")
    chapters = spark.createDataFrame([("n", 0), ("n", 3), ("n", 99)], "n string, ch int")
    out = {r.ch: r.context for r in O.recent_context(chapters, events, ["n"], "ch", "idx", F.col("e"), [F.col("e")]).collect()}
    assert out == {0: ["u1", "u2"], 3: ["e0", "e1", "e2", "u1", "u2"], 99: ["e5", "e6", "e7", "u1", "u2"]}
