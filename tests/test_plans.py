"""Physical plans: no nested-loop or cartesian joins, pruned scans, filters in the scan, limits before the shuffle."""

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("t1_", "t3_", "t4_", "t5_"))))
def test_no_cross_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["p3_select_range", "g7_first_n", "g10_backlog_head", "u10_enqueue", "k2_recent_reading", "g11_cap_per_site"])
def test_group_limit_runs_before_the_shuffle(spark, name):
    assert "Partial" in plan_of(QUERIES[name](spark, SF_DIR)).split("WindowGroupLimit", 1)[1]


@pytest.mark.parametrize("name", ["s1_corpus_lines", "w1_extract_links", "p4_flag_blocked", "c10_numeral_mentions", "p5_has_residue"])
def test_row_wise_jobs_read_two_columns(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    schema = plan.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]
    assert schema.count(":") <= 3


def test_row_wise_jobs_do_not_shuffle(spark):
    from pyspark.sql import functions as F

    from corpusloom.operators import corpus as C
    from corpusloom.operators import pages as W

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    for frame in (C.split_chapters(docs, key="doc_id"), C.segment_manifest(docs, "doc_id"), C.split_long(docs, ["doc_id"]),
                  W.extract_links(pages), W.page_text(pages), W.page_metadata(pages)):
        assert "Exchange" not in plan_of(frame)
    kept = docs.filter(F.col("source") == "src1").select("doc_id", "text")
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in plan_of(C.segment_manifest(kept, "doc_id"))


@pytest.mark.parametrize("name", ["j6_match_spans", "c3_gloss", "c3_draft_text"])
def test_places_of_a_text_do_not_move(spark, name):
    """A small lexicon goes to the rows: neither places nor spans nor tokens are shuffled, only the lexicon is."""
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "ArrowEvalPython" in plan and "hashpartitioning(source" not in plan and "SortMergeJoin" not in plan
    assert all("key" in line or "RoundRobin" in line or "Broadcast" in line for line in plan.splitlines() if "Exchange" in line)


def test_tokens_are_not_sorted_for_their_rules(spark):
    plan = plan_of(QUERIES["j16_token_rules"](spark, SF_DIR))
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_coverage_sums_before_the_rollup(spark):
    plan = plan_of(QUERIES["a5_coverage"](spark, SF_DIR))
    assert plan.index("Expand") < plan.index("BroadcastHashJoin") and "HashAggregate" in plan[plan.index("Expand"):plan.index("BroadcastHashJoin")]


def test_heading_tests_run_once_per_line(spark):
    """An exploded column must not be computed a second time by a filter below its projection."""
    from corpusloom.operators import corpus as C

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rules = (C.HeadingRule("one", "^(only-one-mention)$", 0, 1),)
    plan = C.split_chapters(docs, rules, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    # One test and one title extraction (read twice: empty or not), all in one place.
    assert 1 <= plan.count("only-one-mention") <= 3


def test_gate_works_out_its_violations_once(spark):
    plan = plan_of(QUERIES["q8_gate"](spark, SF_DIR))
    # The segments are joined once, the counts once.
    assert plan.count("FullOuter") == 2


def test_spans_of_a_small_lexicon_and_texts_of_the_memory_do_not_move(spark):
    from corpusloom.plans.knowledge import doc_memory

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["j6_match_spans"](spark, SF_DIR))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        join = doc_memory(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().children().apply(0)
        assert join.nodeName() == "Join" and "text#" not in join.output().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
