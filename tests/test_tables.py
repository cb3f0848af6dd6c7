"""Knowledge base, memory, locks, quality gates and state rules on literal rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import names as N
from corpusloom.operators import catalog as A
from corpusloom.operators import kb as K
from corpusloom.operators import lexicon as L
from corpusloom.operators import locks as O
from corpusloom.operators import memory as M
from corpusloom.operators import quality as Q


def test_name_origin(spark):
    tables = spark.createDataFrame(N.name_rows(), "kind string, ord int, key string, value string")
    cases = {
        "Pette Chinar": ("Latin", "Pette Chinar"), "佐藤健": ("Japanese", "Sato Takeru"), "朴智星": ("Korean", "Park Ji-sung"),
        "金秀贤": ("Korean", "Kim Soo-hyun"), "宇智波佐助": ("Japanese", "UchihaSasuke"), "鸣人": ("Japanese", "Naruto"),
        "김수현": ("Korean", "Kim 수현"), "王五": (None, None), "李四": (None, None), "A": (None, None)}
    frame = spark.createDataFrame([(c,) for c in cases], "name string")
    assert {r.name: (r.origin, r.converted) for r in L.name_origin(frame, tables).collect()} == cases


def test_name_origin_never_multiplies_names(spark):
    """Leading strings of names are no rows, so no side made of names can be broadcast; the first prefix in order wins."""
    tables = spark.createDataFrame([("japanese_prefix", 1, "大筒", "Ots"), ("japanese_prefix", 0, "大筒木", "Otsutsuki"), ("japanese_prefix", 2, "大", "O"),
                                    ("japanese_given", 0, "健", "Takeru")], "kind string, ord int, key string, value string")
    frame = spark.createDataFrame([("大筒木健",), ("大筒健",), ("大健",), ("健",), ("",), (None,)], "name string")
    out = L.name_origin(frame, tables)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.name: r.converted for r in out.collect()} == {
        "大筒木健": "OtsutsukiTakeru", "大筒健": "OtsTakeru", "大健": "OTakeru", "健": None, "": None, None: None}
    bare = L.name_origin(frame, tables.filter("kind <> 'japanese_prefix'")).collect()
    assert [r.converted for r in bare if r.name == "大健"] == [None]


def test_locked_names_are_enforced(spark):
    raw = spark.createDataFrame([(1, "培特 和 佐藤健")], "ch int, text string")
    locks = spark.createDataFrame([("培特", "Pette Chinar", "characters"), ("佐藤健", "Sato Takeru", "characters"), ("赵奇", "Triệu Kỳ", "characters")],
                                  "raw string, target string, group string")
    aliases = spark.createDataFrame([(k, a) for k, v in N.KNOWN_ALIASES.items() for a in v], "raw string, alias string")
    present = O.present_locks(raw, locks, ["ch"])
    out = spark.createDataFrame([(1, "Bồi Đặc gặp 佐藤健."), (2, "Cách Lâm")], "ch int, text string")
    done = {r.ch: r.text for r in O.apply_locks(out, present, aliases, ["ch"], N.CANONICAL_TARGETS).collect()}
    assert done == {1: "Pette Chinar gặp Sato Takeru.", 2: "Green"}


def plain_locked(text, present, aliases):
    """``present``: (raw, target) of a chapter; targets of three Latin letters or more are kept."""
    found = {}
    for raw, target in present:
        for src in [raw, *(a for r, a in aliases if r == raw and a not in (None, "", target))]:
            found[src] = min(found.get(src, target), target, key=str.encode)
    for src in sorted(found, key=lambda s: (-len(s), s.encode())):
        text = text.replace(src, found[src])
    return text


@pytest.mark.parametrize("letters, targets", [
    ("abT ", ["Tab1", "bTa", "abab", "Tobaa2", "Ta b3"]),  # targets hold sources, and meet their neighbours
    ("abcg ", ["Target1", "Target22", "Tacab3"]), ("abgr", ["Target1", "Target22"]), ("龍鳳é ", ["Long1", "Elaü", "용 용"]),
])
def test_locks_applied_from_numbers_and_from_rows(spark, letters, targets):
    """Several texts of a chapter, null keys and texts, targets that share a source, aliases that stand where their raw form does not."""
    draw = random.Random(len(letters))
    word = lambda low, high: "".join(draw.choice(letters) for _ in range(draw.randint(low, high)))
    names = sorted({w for w in (word(1, 5) for _ in range(400)) if w.strip()})
    locks = [(raw, draw.choice(targets), draw.choice("cg")) for raw in names] + [(names[0], t, "c") for t in targets] + [(names[1], "x", "c"), (names[2], None, "c")]
    aliases = [(raw, draw.choice([word(1, 3), "arg", "", None])) for raw in names[::9]]
    rows = [(i, draw.choice([*range(40), None]), draw.choice([None, "", *(word(0, 60) for _ in range(9))])) for i in range(120)]
    rows += [(200 + i, 50 + i, word(2, 9)) for i in range(120)]
    frame = spark.createDataFrame(rows, "id int, ch int, text string").repartition(3)
    kept = {(r, t) for r, t, _ in locks if t and len(t) > 2}
    of = {ch: {(r, t) for r, t in kept if any(c == ch and x and r in x for _, c, x in rows)} for ch in {c for _, c, _ in rows if c is not None}}
    want = {i: x and plain_locked(x, of.get(ch, ()), aliases) for i, ch, x in rows}
    listed = spark.createDataFrame(locks, "raw string, target string, group string")
    alias = spark.createDataFrame(aliases, "raw string, alias string")
    # However many texts a chapter has, each of them meets one list of its locks.
    lists = O.present_locks(frame, listed, ["ch"], packed=True).packed.collect()
    assert sorted(r.ch for r in lists) == sorted({c for _, c, x in rows if c is not None and x is not None})
    for packed, in_row in ((False, 1 << 20), (True, 1 << 20), (True, 0)):
        out = O.apply_locks(frame, O.present_locks(frame, listed, ["ch"], packed=packed), alias, ["ch"], {}, in_row=in_row)
        # What moves is a text and a short binary, not a row for each lock of it.
        assert ("Generate" in out._jdf.queryExecution().optimizedPlan().toString()) != (packed and in_row > 0)
        got = out.collect()
        assert {r.id: r.text for r in got} == want and len(got) == len(rows), (packed, in_row)


def test_lock_violations(spark):
    locks = spark.createDataFrame([("培特", "Pette Chinar", "characters"), ("赵奇", "Triệu Kỳ", "characters"), ("城", "City Hall", "characters")],
                                  "raw string, target string, group string")
    seg = spark.createDataFrame([(1, "培特", "Bản dịch khác."), (2, "培特 赵奇", "Pette Chinar"), (3, "城", "x")], "ch int, text string, refined string")
    assert {(r.ch, r.raw) for r in Q.lock_violations(seg, locks, ["ch"]).collect()} == {(1, "培特")}
    assert {(r.ch, r.raw) for r in Q.lock_violations(seg, locks, ["ch"], strict=True).collect()} == {(1, "培特"), (2, "赵奇")}


def test_lock_violations_by_bits_and_by_joins(spark):
    """Chapters of many rows, over 64 locks, targets and raw forms that locks share, a lock twice; pairs move once, as bits."""
    draw = random.Random(11)
    letters = "abcd "
    forms = sorted({"".join(draw.choice(letters) for _ in range(draw.choice([2, 2, 3, 5]))) for _ in range(170)})
    pairs = [(raw, f"Target{i % 40}") for i, raw in enumerate(forms) if raw.strip()]
    pairs += [(pairs[0][0], "Target7"), (pairs[1][0], "Other"), pairs[2], pairs[2]]
    rows = [(draw.choice([1, 2, 3, 4, None]), draw.choice([None, "", *("".join(draw.choice(letters) for _ in range(40)) for _ in range(9))]),
             draw.choice([None, "", *(" ".join(f"Target{draw.randrange(60)}" for _ in range(4)) for _ in range(9))])) for _ in range(60)]
    rows += [(5, "ab cd", None), (6, None, "Target1"), (7, " ".join(raw for raw, _ in pairs), "")]
    seg = spark.createDataFrame(rows, "ch int, text string, refined string")
    locks = spark.createDataFrame([(r, t, "characters") for r, t in pairs], "raw string, target string, group string")
    of = {ch: [[r[i] or "" for r in rows if r[0] == ch] for i in (1, 2)] for ch in range(1, 8)}
    want = sorted((ch, raw, target) for ch, (texts, given) in of.items() for raw, target in pairs
                  if any(raw in t for t in texts) and not any(target in t for t in given))
    for in_row in (1 << 20, 0):
        assert sorted(tuple(r) for r in Q.lock_violations(seg, locks, ["ch"], in_row=in_row).collect()) == want
    found = Q.lock_violations(seg, locks, ["ch"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython") == 1 and "SortMergeJoin" not in plan
    assert Q.lock_violations(seg, locks.limit(0), ["ch"]).count() == 0


def test_lock_merge_prefers_latin(spark):
    rows = [("c", "甲", "汉", 0, 1), ("c", "甲", "Latin (x)", 1, 1), ("c", "甲", "Other", 2, 1), ("c", "乙", "  ", 0, 1), ("c", "丙", "一", 0, 2), ("c", "丙", "二", 1, 1)]
    frame = spark.createDataFrame(rows, "g string, raw string, target string, source_rank int, seq int")
    assert {(r.raw, r.target) for r in O.merge_locks(frame, ["g"]).collect()} == {("甲", "Latin"), ("丙", "一")}


def test_recovered_reply_and_retry_list(spark):
    replies = spark.createDataFrame([(1, "intro\n[1] Bản dịch 1\nthêm\n[2] Bản 中\n[1] Lại"), (2, "không có")], "ch int, reply string")
    expected = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "ch int, id int")
    got = Q.recover_segments(replies, expected, ["ch"])
    assert {(r.ch, r.id, r.text) for r in got.collect()} == {(1, 1, "Lại"), (1, 2, "Bản 中")}
    again = Q.retry_list(expected, got, ["ch"]).collect()
    assert {(r.ch, r.id, r.reason) for r in again} == {(1, 2, "residue"), (1, 3, "missing"), (2, 1, "missing")}


@pytest.mark.parametrize("reply, ok, first", [
    ('{"refined_segments":[{"id":1,"refined_translation":"a"}]}', True, "a"),
    ('```json\n{"refined_segments":[{"id":1,"refined_translation":"b"}]}\n```', True, "b"),
    ('Sure: {"refined_segments":[{"id":1,"refined_translation":"c"}]} done', True, "c"),
    ("", False, None), ("no object", False, None), ("{broken", False, None)])
def test_parse_reply(spark, reply, ok, first):
    row = Q.parse_reply(spark.createDataFrame([(1, reply)], "i int, reply string")).first()
    assert row.ok is ok and (row.reply.refined_segments[0].refined_translation if ok else None) == first


def test_reconcile(spark):
    raw = spark.createDataFrame([("c", i, f"s{i}") for i in (1, 2, 3, 4)], "c string, id int, segment_id string")
    refined = spark.createDataFrame([("c", 1, 2, "s2", "x"), ("c", 2, 1, "s1", "x"), ("c", 3, 3, "bad", " "), ("c", 4, 9, "s9", "x"), ("c", 5, 2, "s2", "y")],
                                    "c string, pos int, id int, segment_id string, text string")
    out = {(r.id, r.fault) for r in Q.reconcile(raw, refined, ["c"]).collect()}
    assert out == {(4, "missing"), (9, "extra"), (2, "duplicate"), (3, "empty"), (3, "segment_id"), (1, "out_of_order"), (2, "out_of_order")}


def test_reconcile_in_one_cell_and_in_many(spark):
    raw_rows = [(c, i, f"s{i}") for c in (1, 2, None) for i in (1, 2, 3, 4, 5, 6)]
    refined_rows = [(1, 9, 1, "s1", "x"), (1, 9, 2, "s2", "x"), (1, 1, 3, "x", "x"), (1, 4, 5, "s5", None), (1, 3, 6, "s6", "x"), (1, 8, 6, "s6", "x"),
                    (2, 1, 1, "s1", "x"), (2, 2, 2, "s2", "x"), (2, 0, 8, None, "x"), (3, 1, 1, "s1", "x"), (None, 1, 2, "s2", "x")]
    raw = spark.createDataFrame(raw_rows, "c int, id int, segment_id string")
    refined = spark.createDataFrame(refined_rows, "c int, pos int, id int, segment_id string, text string")
    # By pos, chapter 1 is 3, 6, 5, 1, 2: none of its known ids keeps its place.
    want = [(1, 4, "missing"), (1, 3, "segment_id"), (1, 5, "empty"), (1, 6, "duplicate"), *[(1, i, "out_of_order") for i in (1, 2, 3, 5, 6)],
            *[(2, i, "missing") for i in (3, 4, 5, 6)], (2, 8, "extra"), (3, 1, "extra"), *[(None, i, "missing") for i in (1, 2, 3, 4, 5, 6)], (None, 2, "extra")]
    for width in (4096, 3, 1):
        assert sorted(str(tuple(r)) for r in Q.reconcile(raw, refined, ["c"], width).collect()) == sorted(map(str, want))


def test_gate(spark):
    rows = [("a", "error", f"m{i}") for i in range(9, 0, -1)] + [("a", "warning", "a"), ("b", "warning", "w"), ("b", None, "n"), ("c", "error", None), ("c", "error", "z"), (None, "error", "y")]
    want = {("a", 9, 1, "m1 | m2 | m3 | m4 | m5", False), ("b", 0, 1, "", True), ("c", 2, 0, "z", False), (None, 1, 0, "y", False)}
    given = spark.createDataFrame(rows, "k string, level string, message string")
    for frame in (given, given.withColumn("cell", F.length("message").cast("long")), given.withColumn("cell", F.xxhash64("message"))):
        assert {tuple(r) for r in Q.gate(frame, ["k"]).collect()} == want


def test_promotion(spark):
    sightings = [("方元", "Phương Nguyên", "character")] * 3 + [("方元", "方", "character")] * 4 + [("灵气", "linh khí", "item")] * 2 + [(" ", "x", "item"), ("宗", "tông", "sect"), ("宗", "tông", "sect"), ("宗", "tông", "sect")]
    known = spark.createDataFrame([("方元", "Phuong", "character"), ("宗", "tông", "sect")], "key string, target string, type string")
    frame = spark.createDataFrame(sightings, "raw string, target string, type string")
    out = {(r.raw, r.target): (r.score, r.status) for r in K.promote_candidates(frame, known).collect()}
    assert out == {("方元", "Phương Nguyên"): (3.0, "rejected"), ("灵气", "linh khí"): (2.0, "pending")}
    fresh = {(r.raw, r.target): r.status for r in K.promote_candidates(frame, known.limit(0)).collect()}
    assert fresh == {("方元", "Phương Nguyên"): "rejected", ("方元", "方"): "approved", ("灵气", "linh khí"): "pending", ("宗", "tông"): "approved"}


def test_memory_lookup_and_upsert(spark):
    tm = spark.createDataFrame([("同样的一句话", "cũ", "p1"), ("同样的一句话", "khác", "p2")], "raw string, translated_text string, project_scope string")
    tm = tm.withColumn("raw_hash", M.raw_hash(F.col("raw")))
    seg = spark.createDataFrame([(1, "　同样的一句话\t", "p2"), (2, "同样的一句话", "p9"), (3, "没有", "p1")], "id int, text string, scope string")
    out = {r.id: (r.translated_text, r.match) for r in M.tm_lookup(seg, tm).collect()}
    assert out == {1: ("khác", "project"), 2: ("cũ", "any"), 3: (None, None)}
    pairs = spark.createDataFrame([("同样的一句话", "mới", 5), ("短句", "x", 5)], "raw_text string, refined_translation string, seen_at int")
    new = M.memory_pairs(pairs, F.lit("p3"))
    old = tm.limit(1).select("raw_hash", F.col("raw").alias("raw_text"), "translated_text", "project_scope", F.lit(1).alias("seen_at"),
                             F.lit(7).alias("chapter_index"), F.lit(4).alias("hit_count"))
    row = M.tm_upsert(old, new).collect()
    assert len(row) == 1 and (row[0].translated_text, row[0].project_scope, row[0].chapter_index, row[0].hit_count) == ("mới", "p3", 7, 4)


def test_memory_keeps_review_of_the_last_write(spark):
    schema = "raw_hash string, raw_text string, translated_text string, project_scope string, chapter_index int, hit_count long, seen_at int, confidence double, reviewed boolean"
    old = spark.createDataFrame([("h", "r", "cũ", "p", 7, 4, 1, 0.9, True)], schema)
    new = spark.createDataFrame([("h", "r", "mới", "p", None, None, 2, 0.4, False)], schema)
    row = M.tm_upsert(old, new).first()
    assert (row.translated_text, row.confidence, row.reviewed, row.chapter_index) == ("mới", 0.4, False, 7)


def test_catalog_takes_the_last_status(spark):
    old = spark.createDataFrame([(1, "new"), (2, "new")], "id int, status string")
    changes = spark.createDataFrame([(1, "queued", 1), (1, "done", 2), (3, "done", 1)], "id int, status string, change_no int")
    rows = K.catalog_append(old, old.limit(0), changes).collect()
    assert {(r.id, r.status) for r in rows} == {(1, "done"), (2, "new")}


def test_layers(spark):
    rows = [("project", "n1", "k", "P", 0, 1, 1), ("universe", "u1", "k", "U", 0, 1, 2), ("style", None, "k", "S", 0, 1, 3), ("global", None, "k", "G", 0, 1, 4),
            ("global", None, "g", "G2", 0, 1, 5), ("global", None, "g", "G3", 1, 9, 6)]
    layers = spark.createDataFrame(rows, "layer string, scope string, key string, target string, tier int, priority int, id int")
    active = spark.createDataFrame([("a", "n1"), ("a", "u1"), ("b", "u1")], "context string, scope string")
    resolved = L.resolve_lexicon(layers, active)
    wanted = spark.createDataFrame([(c, k) for c in "abc" for k in "kg"], "context string, key string")
    out = {(r.context, r.key): r.target for r in L.lookup_terms(wanted, resolved).collect()}
    assert out == {("a", "k"): "P", ("b", "k"): "U", ("c", "k"): "S", ("a", "g"): "G3", ("b", "g"): "G3", ("c", "g"): "G3"}


def test_one_open_job_per_novel(spark):
    jobs = spark.createDataFrame([("n1", "queued"), ("n2", "done")], "novel string, status string")
    asks = spark.createDataFrame([("n1", 1), ("n2", 2), ("n2", 3), ("n3", 4)], "novel string, at int")
    assert {(r.novel, r["at"]) for r in K.enqueue(jobs, asks, "novel", [F.col("at")]).collect()} == {("n2", 2), ("n3", 4)}


def job_rows(spark, *rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(j, i, base + dt.timedelta(seconds=s), st, e) for i, (j, s, st, e) in enumerate(rows)],
                                 "job string, event_id int, ts timestamp_ntz, status string, error string")


def test_job_states(spark):
    events = job_rows(
        spark, ("fresh", 9900, "running", ""), ("stale", 9000, "running", ""),
        ("err1", 9000, "error", "timeout"), ("due", 100, "error", "timeout"),
        ("block", 0, "error", "x"), ("block", 10, "error", "x"), ("block", 20, "error", "Just a moment"),
        ("reset", 0, "error", "x"), ("reset", 10, "error", "x"), ("reset", 20, "done", ""), ("reset", 30, "error", "x"))
    now = F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=10000)).cast("timestamp_ntz")
    out = {r.job: (r.new_status, r.attempt_count) for r in A.settle(A.attempt_state(events, "job"), "job", now).collect()}
    assert out == {"fresh": ("running", 0), "stale": ("queued", 0), "err1": ("error", 1), "due": ("queued", 1),
                   "block": ("blocked", 3), "reset": ("queued", 1)}


def test_chapter_states(spark):
    base = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "processing", None, 0), (2, "processing", base - dt.timedelta(minutes=5), 0), (3, "processing", base - dt.timedelta(hours=2), 0),
            (4, "pending", None, 3), (5, "done", None, 0)]
    frame = spark.createDataFrame(rows, "id int, status string, processing_started_at timestamp_ntz, fail_count int")
    out = {r.id: r.new_status for r in A.settle_chapters(frame, F.lit(base).cast("timestamp_ntz")).collect()}
    assert out == {1: "pending", 2: "processing", 3: "pending", 4: "blocked", 5: "done"}
    forced = {r.id: r.new_status for r in A.settle_chapters(frame, F.lit(base).cast("timestamp_ntz"), force=True).collect()}
    assert forced[2] == "pending"


def test_empty_permissions_allow_nothing(spark):
    projects = spark.createDataFrame([("a",), ("b",)], "p string")
    locks = spark.createDataFrame([("a", True), ("b", False)], "p string, flag boolean")
    names = lambda frame: sorted(r.p for r in frame.collect())
    assert names(A.runnable(projects, locks, "p")) == ["a"]
    assert names(A.runnable(projects, locks.filter("p = 'b'"), "p")) == ["a"]
    assert names(A.runnable(projects, locks.limit(0), "p")) == []


def test_clean_target(spark):
    cases = {"a/b": "a", "x=y": "x", "1. một; hai": "một", "/": "", "thường": "thường", ";x": ";x", "Xanh (tên)": "Xanh", "2. lục (màu); x": "lục"}
    frame = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: r.c for r in frame.withColumn("c", L.clean_target(F.col("t"))).collect()} == cases


def test_suffix_trim(spark):
    frame = spark.createDataFrame([("方元刚就",), ("手手",), ("心",)], "n string")
    assert [r[0] for r in frame.select(L.trim_suffixes(F.col("n"))).collect()] == ["方元", "手", "心"]


def test_metadata_and_genres(spark):
    frame = spark.createDataFrame([("Truyện_Tác Giả", "n/a", "a,b；c|"), ("Đơn", " ok  ok ", "")], "novel_id string, synopsis string, genres string")
    out = A.clean_metadata(frame, "novel_id", ["synopsis"]).orderBy("title_vi").collect()
    assert [(r.title_vi, r.author_vi, r.synopsis) for r in out] == [("Truyện", "Tác Giả", None), ("Đơn", "Unknown", "ok ok")]
    assert sorted(r.genre for r in A.explode_genres(frame, "genres", ["novel_id"]).collect()) == ["a", "b", "c"]


def test_address_forms_and_pov(spark):
    frame = spark.createDataFrame([(1, "“老夫在此”他说。“朕”老朽"), (2, "他她它他")], "c int, text string")
    assert {(r.c, r.form) for r in O.address_forms(frame, ["c"]).collect()} == {(1, "老夫"), (1, "朕")}
    assert {r.c: r.pov for r in O.pov(frame, ["c"]).collect()} == {1: 1, 2: 3}


def test_edge_jobs(spark):
    old = spark.createDataFrame([("a", "b", "r")], "source string, target string, relationship string")
    new = spark.createDataFrame([(" a", "b ", "r"), ("a", "", "r"), ("c", "d", "q")], "source string, target string, relationship string")
    both = K.add_edges(old, new)
    assert {tuple(r) for r in both.collect()} == {("a", "b", "r"), ("c", "d", "q")}
    present = spark.createDataFrame([(1, "a"), (1, "b"), (2, "d")], "ch int, raw string")
    assert {(r.ch, r.edge) for r in O.edge_context(both, present, ["ch"]).collect()} == {(1, "a --(r)--> b"), (2, "c --(q)--> d")}
    assert {(r.ch, r.edge) for r in O.edge_context(both, present, ["ch"], both_ends=True).collect()} == {(1, "a --(r)--> b")}


def test_sorted_lists(spark):
    files = spark.createDataFrame([("b.md",), ("Chapter 10.md",), ("Chương 2.md",), ("a.md",)], "name string")
    assert [r.name for r in A.chapter_order(files, "name").collect()] == ["Chương 2.md", "Chapter 10.md", "a.md", "b.md"]
    names = spark.createDataFrame([(n,) for n in ("beta", "Alpha", "gamma", "Ring a", "a ring")], "name string")
    assert [r.name for r in A.progress_list(names, "name", 3).collect()] == ["a ring", "Alpha", "beta"]
    assert [r.name for r in A.page(names, [F.col("name")], 1, 2).collect()] == ["a ring", "beta"]
    assert [r.name for r in A.search_library(names, "name", "RING").collect()] == ["Ring a", "a ring"]


def test_reply_in_either_form(spark):
    replies = spark.createDataFrame([
        (1, '{"refined_segments":[{"id":1,"refined_translation":" a "},{"id":2,"refined_translation":""},{"id":9,"refined_translation":"x"}]}'),
        (2, "[1] b\nthêm\n2. c"), (3, '{"refined_segments":[]}')], "ch int, reply string")
    expected = spark.createDataFrame([(c, i) for c in (1, 2, 3) for i in (1, 2)], "ch int, id int")
    out = {(r.ch, r.id, r.text) for r in Q.recover_reply(replies, expected, ["ch"]).collect()}
    assert out == {(1, 1, "a"), (2, 1, "b\nthêm"), (2, 2, "c")}


def test_universe_markers_and_readings(spark):
    chapters = spark.createDataFrame([(1, "木叶和火影"), (2, "没有"), (3, "斯塔克去木叶")], "ch int, text string")
    out = {(r.ch, r.universe) for r in L.active_universes(chapters, None, ["ch"]).collect()}
    assert out == {(1, "naruto"), (3, "marvel"), (3, "naruto")}
    readings = spark.createDataFrame([("释", "thích,x"), ("方", "phương, phường"), ("元", "nguyên")], "key string, value string")
    names = spark.createDataFrame([(1, "释方元龙")], "id int, raw string")
    assert L.read_names(names, readings, ["id"]).first().target == "Thích Phương Nguyên 龙"
