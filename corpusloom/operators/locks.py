"""Locked terms: merge of the lock sources, enforcement in text, packs per chapter, context for a chapter."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.keyed import last_n_before, top_per_key
from corpusloom.functions.locked import locked_in
from corpusloom.functions.terms import replaced_in
from corpusloom.functions.text import CJK, LATIN, elements, is_foreign_like, strip, target_text
from corpusloom.operators.lexicon import IN_ROW, packed_terms, present_terms

# --- fixed values ---------------------------------------------------------------------------------------------
CONTEXT_EVENTS = 5
FIRST_PERSON = "[我吾俺老夫本座]"
THIRD_PERSON = "[他她它]"
# Self-address forms of old-style and fantasy speech.
SELF_FORMS = ("老夫", "本座", "朕", "贫道", "妾身", "晚辈", "本尊", "在下", "老朽")
QUOTE = "“(.*?)”"
NAME_QUOTE = "「([^」]+)」"
# --- end of fixed values --------------------------------------------------------------------------------------


def merge_locks(sources: DataFrame, keys: list[str]) -> DataFrame:
    """One target per (keys, raw): the first Latin target in source order, else the first target.

    ``sources``: keys, raw, target, source_rank, seq. Map-side combined, so a raw form in every source is cheap.
    """
    rows = sources.withColumn("target", target_text(F.col("target"))).filter(
        (F.coalesce(strip(F.col("raw")), F.lit("")) != "") & (F.col("target") != ""))
    rank = F.struct(~F.col("target").rlike(LATIN), F.col("source_rank"), F.col("seq"), F.col("target"))
    return rows.groupBy(*keys, "raw").agg(F.min_by("target", rank).alias("target"))


def longest_first(pairs: Column) -> Column:
    """Replacement pairs ordered by source length, longest first, then by source."""
    keyed = F.transform(pairs, lambda p: F.struct((-F.length(p["src"])).alias("n"), p["src"].alias("src"),
                                                  p["dst"].alias("dst")))
    return F.transform(F.sort_array(keyed), lambda p: F.struct(p["src"].alias("src"), p["dst"].alias("dst")))


def literal_pairs(mapping: dict[str, str]) -> Column:
    """A replacement table as an ordered array literal, longest source first."""
    ordered = sorted(mapping.items(), key=lambda item: (-len(item[0]), item[0]))
    return F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in ordered])


def replace_pairs(text: Column, pairs: Column) -> Column:
    """Replacements applied one after the other."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["src"], p["dst"]))


class Present(NamedTuple):
    """Locks that stand in chapters: as ``rows`` (keys, raw and the other columns of the locks), and ``packed`` (keys, found), where a row
    names all raw forms of a chapter by their numbers in ``raws``; ``locks`` has the locks themselves."""

    rows: DataFrame
    packed: DataFrame
    raws: list[str]
    locks: DataFrame


def _written(locks: DataFrame, aliases: DataFrame, columns: list[str]) -> DataFrame:
    """What is written for locks that must be kept letter by letter, aliases included: (columns, src, dst)."""
    strong = locks.withColumn("target", target_text(F.col("target"))).filter(is_foreign_like(F.col("target")))
    # The forms of a raw name travel as one list, so the locks found in the texts are worked out once.
    forms = aliases.filter("alias <> ''").groupBy("raw").agg(F.collect_set("alias").alias("_aliases"))
    other = F.filter(F.coalesce("_aliases", F.array().cast("array<string>")), lambda a: a != F.col("target"))
    return strong.join(forms, "raw", "left").select(
        *columns, F.explode(F.concat(F.array("raw"), other)).alias("src"), F.col("target").alias("dst"))


def lock_pairs(locks: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Replacement list per chapter from its locks that must be kept letter by letter, aliases included."""
    # One shuffle by chapter; of several targets of a form the least one, next to each other in the ordered list, stays.
    listed = _written(locks, aliases, keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct((-F.length("src")).alias("n"), "src", "dst"))).alias("_all"))
    first = F.filter("_all", lambda p, i: (i == 0) | (p["src"] != F.get("_all", i - 1)["src"]))
    return listed.select(*keys, F.transform(first, lambda p: F.struct(p["src"].alias("src"), p["dst"].alias("dst"))).alias("_pairs"))


def apply_locks(segments: DataFrame, locks: DataFrame | Present, aliases: DataFrame, keys: list[str],
                overrides: dict[str, str], text: str = "text", in_row: int = 4 * IN_ROW) -> DataFrame:
    """Locked names and their aliases written as locked, longest first, then the canonical overrides.

    ``locks`` holds the locks present in each chapter (``keys``), so a list is bounded by one chapter's text. Packed ones meet the
    segments as numbers, and the replacements of all locks, if they are at most ``in_row`` bytes, go to the rows. Both give the same rows.
    """
    packed = locks if isinstance(locks, Present) else None
    if packed:
        written = _written(packed.locks, aliases, ["raw"]).distinct()
        size = written.agg(F.sum(F.octet_length("src") + F.octet_length("dst") + 32)).first()[0] or 0
        packed, locks = packed if size <= in_row else None, locks.rows
    if packed:
        number, of = {raw: i for i, raw in enumerate(packed.raws)}, [[] for _ in packed.raws]
        rows = [r for r in written.collect() if r["raw"] in number]
        pairs = sorted({(r["src"], r["dst"]) for r in rows}, key=lambda p: (-len(p[0]), p[0].encode(), p[1].encode()))
        place = {p: i for i, p in enumerate(pairs)}
        for r in rows:
            of[number[r["raw"]]].append(place[r["src"], r["dst"]])
        joined = segments.join(packed.packed.withColumnRenamed("found", "_found"), keys, "left")
        replaced = locked_in(F.col(text), F.col("_found"), pairs, of)
    else:
        joined = segments.join(lock_pairs(locks, aliases, keys), keys, "left")
        replaced = replaced_in(F.col(text), F.coalesce("_pairs", F.array().cast("array<struct<src:string,dst:string>>")))
    if overrides:
        replaced = replace_pairs(replaced, literal_pairs(overrides))
    return joined.withColumn(text, replaced).drop("_found", "_pairs")


def present_locks(chapters: DataFrame, locks: DataFrame, keys: list[str], text: str = "text", packed: bool = False,
                  in_row: int = IN_ROW) -> DataFrame | Present:
    """Locks (group, raw, target) whose raw form stands in the chapter text.

    ``packed`` gives raw forms of at most ``in_row`` bytes as numbers beside the rows, for ``apply_locks``: a chapter's are one short binary.
    """
    found = present_terms(chapters, locks.select(F.col("raw").alias("term")), keys, text)
    rows = found.withColumnRenamed("term", "raw").join(locks.distinct(), "raw")
    if packed:
        raws = locks.filter("raw <> ''").select("raw").distinct()
        if (raws.agg(F.sum(F.octet_length("raw") + 16)).first()[0] or 0) <= in_row:
            listed = sorted((r for r, in raws.collect()), key=str.encode)
            return Present(rows, packed_terms(chapters, listed, keys, text), listed, locks.distinct())
    return rows


def lock_pack(present: DataFrame, keys: list[str]) -> DataFrame:
    """Locked dictionary of a chapter as JSON, one map per group, entries sorted by raw form."""
    groups = present.groupBy(*keys, "group").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("raw", "target")))).alias("_m"))
    return groups.groupBy(*keys).agg(F.to_json(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("group", F.to_json("_m").alias("m")))))).alias("pack"))


def edge_context(edges: DataFrame, present: DataFrame, keys: list[str], both_ends: bool = False) -> DataFrame:
    """Relations printed as ``a --(r)--> b`` for the chapters in which an end (or both) is present."""
    line = F.format_string("%s --(%s)--> %s", "source", "relationship", "target")
    printed = edges.select("source", "target", line.alias("edge")).distinct()
    ends = present.select(*keys, "raw").distinct()
    left = printed.join(ends, printed["source"] == ends["raw"]).select(*keys, "edge", "target")
    if both_ends:
        right = ends.withColumnRenamed("raw", "target")
        return left.join(right, [*keys, "target"], "left_semi").select(*keys, "edge").distinct()
    other = printed.join(ends, printed["target"] == ends["raw"]).select(*keys, "edge")
    return left.select(*keys, "edge").unionByName(other).distinct()


def recent_context(chapters: DataFrame, events: DataFrame, keys: list[str], at: str, when: str, event: Column,
                   order: list[Column], n: int = CONTEXT_EVENTS, width: int = 1024) -> DataFrame:
    """The last ``n`` events before each chapter as array ``context``.

    Events without an index pass for every chapter and sort last, so they take the last places.
    """
    dated = events.filter(F.col(when).isNotNull())
    found = last_n_before(chapters, dated, keys, at, when, n, order, width, event, "_dated", [*keys, at])
    undated = events.filter(F.col(when).isNull()).withColumn("_e", event)
    # At most n undated events per key matter; the group limit keeps the rest from travelling.
    last = top_per_key(undated, keys, [c.desc() for c in order], n, "_r").groupBy(*keys).agg(
        F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_e"))), lambda s: s["_e"])).alias("_undated"))
    joined = found.join(last, keys, "left")
    kind = joined.schema["_dated"].dataType.simpleString()
    merged = F.concat(F.coalesce("_dated", F.array().cast(kind)), F.coalesce("_undated", F.array().cast(kind)))
    tail = F.when(F.size(merged) > n, F.slice(merged, -n, n)).otherwise(merged)
    return joined.withColumn("context", tail).drop("_dated", "_undated")


def pov(chapters: DataFrame, keys: list[str], text: str = "text", first: str = FIRST_PERSON,
        third: str = THIRD_PERSON) -> DataFrame:
    """Point of view: third person when its pronouns outnumber those of the first."""
    counted = chapters.select(*keys, F.regexp_count(F.col(text), F.lit(first)).cast("long").alias("_f"),
                              F.regexp_count(F.col(text), F.lit(third)).cast("long").alias("_t"))
    return counted.groupBy(*keys).agg(F.sum("_f").alias("first_person"), F.sum("_t").alias("third_person")).withColumn(
        "pov", F.when(F.col("third_person") > F.col("first_person"), 3).otherwise(1))


def address_forms(chapters: DataFrame, keys: list[str], text: str = "text", forms=SELF_FORMS, quote: str = QUOTE) -> DataFrame:
    """Self-address forms that occur inside quotes, distinct per chapter."""
    quotes = F.regexp_extract_all(F.col(text), F.lit(quote), F.lit(1))
    wanted = F.array(*[F.lit(f) for f in forms])
    found = F.filter(wanted, lambda f: F.exists(quotes, lambda q: F.contains(q, f)))
    return chapters.select(*keys, F.explode(elements(found)).alias("form")).distinct()


def quoted_candidates(docs: DataFrame, keys: list[str], text: str = "text", quote: str = NAME_QUOTE, low: int = 2,
                      high: int = 5) -> DataFrame:
    """Quoted names of fitting length, distinct per document (or overall without keys)."""
    found = F.regexp_extract_all(F.col(text), F.lit(quote), F.lit(1))
    return docs.select(*keys, F.explode(found).alias("candidate")).filter(
        F.length("candidate").between(low, high)).distinct()


def classify_candidates(candidates: DataFrame, kb: DataFrame, scopes: DataFrame) -> DataFrame:
    """Candidates split into known and unknown with the target and type of the best entry.

    ``kb``: key, target, type, tier, scope, priority, is_active. ``scopes``: (tier, scope) pairs in force. The best entry
    in scope by (tier desc, priority, target) wins, else the best one.
    """
    marked = kb.filter("is_active").join(scopes.distinct().withColumn("_in", F.lit(True)), ["tier", "scope"], "left")
    fits = F.col("scope").isNull() | F.coalesce("_in", F.lit(False))
    best = marked.groupBy("key").agg(F.min_by(
        F.struct("target", "type"), F.struct(~fits, -F.col("tier"), F.col("priority"), F.col("target"))).alias("_b"))
    return candidates.join(best, candidates["candidate"] == best["key"], "left").select(
        *candidates.columns, F.when(F.col("_b").isNull(), "unknown").otherwise("known").alias("status"),
        F.col("_b.target").alias("target"), F.col("_b.type").alias("type"))


def usable_lock(raw: Column, target: Column) -> Column:
    """Target of a lock that can be checked: no source script, more than one character."""
    text = target_text(target)
    return F.when((raw != "") & (F.length(text) > 1) & ~text.rlike(CJK), text)
