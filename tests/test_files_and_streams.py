"""Sources, sinks and streams over real files."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.session import checkpointed, work_dir
from corpusloom.sources import tables as S
from corpusloom.streaming import jobs as J


def test_read_corpus(spark, tmp_path):
    (tmp_path / "Một.txt").write_bytes("﻿第1章 A\r\nx\n".encode() + b"\xff\n")
    (tmp_path / "b.html").write_text("<html><head><title>t</title></head><body><h1>第2章 B</h1>y</body></html>", encoding="utf-8")
    (tmp_path / "c.bin").write_text("no", encoding="utf-8")
    rows = S.read_corpus(spark, str(tmp_path)).orderBy("novel_id", "line_no").collect()
    by_novel = {}
    for r in rows:
        by_novel.setdefault(r.novel_id, []).append(r.line)
    assert by_novel["Một"] == ["第1章 A", "x", "�"]
    assert [x for x in by_novel["b"] if x] == ["第2章 B", "y"] and set(by_novel) == {"Một", "b"}


def test_read_status(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"novel_id": "n", "chapters": [{"index": 1, "status": "done"}, {"index": 2, "status": "pending"}]}, indent=1))
    (tmp_path / "bad.json").write_text("{broken")
    schema = "novel_id string, chapters array<struct<index:int,status:string>>"
    rows = S.read_status(spark, str(tmp_path), schema, "chapters").collect()
    assert {(r["novel_id"], r["index"], r["status"]) for r in rows} == {("n", 1, "done"), ("n", 2, "pending")}
    missing = S.read_status(spark, str(tmp_path / "none.json"), schema, "chapters")
    assert missing.collect() == [] and missing.columns == ["novel_id", "index", "status"]


def test_partitions_are_replaced_alone(spark):
    path = work_dir(spark, "parts")
    S.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "n string, v int"), path, "n")
    S.write_table(spark.createDataFrame([("b", 3)], "n string, v int"), path, "n")
    assert {(r.n, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def test_lexicon_from_files(spark):
    path = work_dir(spark, "kb")
    spark.createDataFrame([(1, "方元", "name", 2, "p")], "id long, key string, type string, tier int, scope string").write.parquet(f"{path}/kb_node")
    spark.createDataFrame(
        [(1, "Phương Nguyên", 1.0, 1, None, "custom", True), (1, "x", 1.0, 1, None, "cedict", True), (1, "y", 1.0, 1, None, None, True), (1, "z", 1.0, 1, None, "custom", False)],
        "node_id long, vietnamese string, confidence double, priority int, pos string, source_dict string, is_active boolean").write.parquet(f"{path}/kb_node_translation")
    assert [r.target for r in S.load_lexicon_path(spark, path).collect()] == ["Phương Nguyên"]


@pytest.mark.parametrize("files", [1, 3])
def test_table_stream_reads_a_file_or_a_folder(spark, tmp_path, files):
    """A large table is a folder of files; other tables beside it are not read."""
    path, other = tmp_path / "pages.parquet", tmp_path / "pagesx.parquet"
    rows = spark.range(30).selectExpr("id AS page_id", "concat('u', id) AS url")
    rows.repartition(files).write.parquet(str(tmp_path / "made"))
    rows.write.parquet(str(other))
    if files == 1:
        next((tmp_path / "made").glob("*.parquet")).rename(path)
    else:
        (tmp_path / "made").rename(path)
    out, mark = work_dir(spark, "out"), work_dir(spark, "mark")
    J.start_append(J.table_stream(spark, str(tmp_path), "pages"), out, mark).awaitTermination()
    assert sorted(r.page_id for r in spark.read.parquet(out).collect()) == list(range(30))


def test_stream_corpus_takes_each_file_once(spark, tmp_path):
    out, mark = work_dir(spark, "out"), work_dir(spark, "mark")
    (tmp_path / "n1.txt").write_text("第1章 A\nx\n第2章 B\ny", encoding="utf-8")
    J.stream_corpus(spark, str(tmp_path), out, mark).awaitTermination()
    (tmp_path / "n2.txt").write_text("第1章 C\nz", encoding="utf-8")
    J.stream_corpus(spark, str(tmp_path), out, mark).awaitTermination()
    J.stream_corpus(spark, str(tmp_path), out, mark).awaitTermination()
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n 3.html").write_text("<p>第1章 D</p><p>a &amp; b</p>", encoding="utf-8")
    J.stream_corpus(spark, str(tmp_path), out, mark).awaitTermination()
    rows = spark.read.parquet(out).collect()
    html = [(r.title, r.body) for r in rows if r.novel_id == "n 3"]
    assert html == [("D", "a & b")]
    rows = [r for r in rows if r.novel_id != "n 3"]
    assert sorted((r.novel_id, r.seq, r.title, r.body) for r in rows) == [("n1", 1, "A", "x"), ("n1", 2, "B", "y"), ("n2", 1, "C", "z")]


def two_batches(spark, tmp_path, rows, schema):
    """A stream that brings the rows in two batches, the later ones first."""
    half = len(rows) // 2
    for i, part in enumerate((rows[half:], rows[:half])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_job_log_is_exact_for_any_order(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    states = ["error", "error", "done", "error", "running", "error"]
    rows = [(f"j{i % 3}", i, base + dt.timedelta(minutes=i), states[i * 7 % 6], "timeout") for i in range(40)]
    schema = "job string, event_id int, ts timestamp_ntz, status string, error string"
    path = work_dir(spark, "log")
    J.stream_job_status(two_batches(spark, tmp_path, rows, schema), "job", path, work_dir(spark, "mark")).awaitTermination()
    now = F.lit(base + dt.timedelta(hours=2)).cast("timestamp_ntz")
    log = spark.read.parquet(path)
    assert log.select("batch").distinct().count() == 2
    got = {tuple(r) for r in J.job_status_at(log.drop("batch"), "job", now).collect()}
    whole = {tuple(r) for r in J.job_status_at(spark.createDataFrame(rows, schema), "job", now).collect()}
    assert got == whole and len(got) == 3


def test_memory_log_and_counts(spark, tmp_path):
    rows = [(f"một câu đủ dài {i % 4}", f"t{i}", i, "p") for i in range(20)]
    schema = "raw_text string, refined_translation string, seen_at int, scope string"
    path = work_dir(spark, "tm")
    J.stream_memory(two_batches(spark, tmp_path, rows, schema), "scope", path, work_dir(spark, "mark")).awaitTermination()
    out = {r.raw_text: (r.translated_text, r.first_at, r.last_at, r.hit_count) for r in J.memory_from_log(spark.read.parquet(path)).collect()}
    assert out == {f"một câu đủ dài {k}": (f"t{16 + k}", k, 16 + k, 5) for k in range(4)}


def test_new_urls_once(spark, tmp_path):
    rows = [(f"u{i % 5}",) for i in range(20)]
    path = work_dir(spark, "urls")
    known = spark.createDataFrame([("u0",)], "url string")
    J.stream_new_urls(two_batches(spark, tmp_path, rows, "url string"), known, path, work_dir(spark, "mark")).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(path).collect()) == ["u1", "u2", "u3", "u4"]


def test_checkpoint_folder_comes_from_the_session(spark):
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpusloom.work.dir"))
    assert checkpointed(spark.range(3)).count() == 3


def test_live_totals_hold_open_windows(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1, 10, 0)
    rows = [(at + dt.timedelta(minutes=m), k) for m, k in ((50, "a"), (55, "b"), (5, "a"), (40, "a"))]
    stream = two_batches(spark, tmp_path, rows, "ts timestamp, event_type string")
    path, mark = work_dir(spark, "live"), work_dir(spark, "mark")
    J.start_live(J.hourly_counts(stream, delay="2 hours"), path, mark).awaitTermination()
    totals = J.live_totals(spark.read.parquet(path), ["hour", "event_type"]).collect()
    assert {(r.event_type, r.n) for r in totals} == {("a", 3), ("b", 1)} and len({r.hour for r in totals}) == 1


def test_memory_lookup_with_null_scopes(spark):
    from corpusloom.operators import memory as M

    segments = spark.createDataFrame([(1, "same text", "p"), (2, "same text", None), (3, "same text", "q"), (4, None, "p"), (5, "other", "p")],
                                     "id int, text string, scope string")
    tm = spark.createDataFrame([("same text", "P", "p"), ("same text", "N", None)], "t string, translated_text string, project_scope string")
    tm = tm.withColumn("raw_hash", M.raw_hash(F.col("t"))).drop("t")
    out = {r.id: (r.translated_text, r.match) for r in M.tm_lookup(segments, tm).collect()}
    assert out == {1: ("P", "project"), 2: ("N", "any"), 3: ("N", "any"), 4: (None, None), 5: (None, None)}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, path)
    rows = lambda frame: sorted(tuple(r) for r in frame.select("n", "m", "v").collect())
    frame = lambda data: spark.createDataFrame(data, "n string, m int, v int")
    assert S.write_snapshot(frame([("a", 1, 1), ("b/ c", 1, 2), (None, 2, 3)]), path, "n", "m") == 1
    pinned = S.read_snapshot(spark, path)
    assert S.write_snapshot(frame([("b/ c", 1, 5), ("d", 1, 6)]), path, "n", "m") == 2
    old = [("a", 1, 1), ("b/ c", 1, 2)]
    new = [("a", 1, 1), ("b/ c", 1, 5), ("d", 1, 6)]
    assert rows(pinned.na.drop()) == old and rows(S.read_snapshot(spark, path, 1).na.drop()) == old
    assert rows(S.read_snapshot(spark, path).na.drop()) == new and pinned.filter("n is null").count() == 1
    # A write that fails half way changes nothing, and the next one goes on from the last snapshot.
    broken = frame([("a", 1, 9), ("d", 1, 0)]).withColumn("v", F.when(F.col("v") > 0, F.col("v")).otherwise(F.raise_error(F.lit("no")).cast("int")))
    with pytest.raises(Exception, match="no"):
        S.write_snapshot(broken, path, "n", "m")
    assert rows(S.read_snapshot(spark, path).na.drop()) == new
    assert S.write_snapshot(frame([]), path, "n", "m") == 3 and rows(S.read_snapshot(spark, path).na.drop()) == new
    plain = str(tmp_path / "u")
    S.write_snapshot(frame([("a", 1, 1)]), plain)
    S.write_snapshot(frame([("b", 1, 2)]), plain)
    assert rows(S.read_snapshot(spark, plain)) == [("b", 1, 2)] and rows(S.read_snapshot(spark, plain, 1)) == [("a", 1, 1)]
