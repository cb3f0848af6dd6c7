"""Lexicon work: layer resolution, span matching, gloss drafts, mentions, coverage, name origin.

Matching is a chain of equi joins: each position of a segment carries the following units as one string, the prefix table
names the lengths worth trying, and the candidate strings are joined to the lexicon by equality. Lexicons below the
broadcast threshold are broadcast by Spark itself; larger ones shuffle on the candidate string, and a frequent candidate's
partition is split by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import names as N
from corpusloom.functions.arrays import cut, let
from corpusloom.functions.keyed import bound, position
from corpusloom.functions.text import (
    CJK, CJK_NUMERAL, HAN_START, HANGUL, HIRAGANA, KATAKANA, LATIN, elements, numeral_value, strip,
)
from corpusloom.functions.spans import PASS, UNKNOWN, cover, covered_by, spans_in
from corpusloom.functions.terms import merged_numbers, numbers_in, terms_in
from corpusloom.operators.memory import tm_lookup
from corpusloom.session import checkpointed

# --- fixed values ---------------------------------------------------------------------------------------------
COST_DICT = 1.0
COST_TOKEN = 0.05
COST_TIER = 0.3
COST_PRIORITY = 0.002
COST_READING = 4.0
COST_UNKNOWN = 60.0
COST_SCALE = 1_000_000
LAYERS = ("project", "universe", "style", "global")
HEAD_UNITS = 4
PRIVATE_USE = 0xF0000
# --- end of fixed values --------------------------------------------------------------------------------------

COST_OF_UNKNOWN = round((COST_UNKNOWN + COST_TOKEN) * COST_SCALE)
#: Bytes of a term list that may go to every row, and of a lexicon with its columns that every executor may hold.
IN_ROW = 1 << 20
HELD = 8 << 20


def clean_target(target: Column) -> Column:
    """Dictionary target cut at ``=``, then at the first ``/``, then before `` (``, without numbering, cut at ``;``.

    A target that starts with ``/`` marks a word that is left out: it becomes empty.
    """
    cut = F.substring_index(target, "=", 1)
    text = strip(F.substring_index(strip(F.substring_index(cut, "/", 1)), " (", 1))
    text = strip(F.regexp_replace(text, r"^\d+\.\s*", ""))
    head = strip(F.substring_index(text, ";", 1))
    return F.when(head == "", text).otherwise(head)


def layer_rank(layer: Column) -> Column:
    return F.coalesce(*[F.when(layer == name, F.lit(i)) for i, name in enumerate(LAYERS)], F.lit(len(LAYERS)))


def resolve_lexicon(layers: DataFrame, active: DataFrame) -> DataFrame:
    """Winning entry per (context, key): project, then active universe, then style, then global.

    ``active`` lists (context, scope): the own project of a context and its active universes. Style and global
    entries are the same everywhere, so they are resolved once under a null context instead of once per context;
    ``lookup_terms`` falls back to them.
    """
    rank = F.struct(
        layer_rank(F.col("layer")).alias("l"), (-F.col("tier")).alias("t"), F.col("priority").alias("p"),
        F.col("id").alias("i"))
    values = [c for c in ("layer", "target", "type", "pos", "tier", "priority") if c in layers.columns]
    pick = F.min_by(F.struct(*values), rank).alias("_v")
    scoped = layers.filter(F.col("layer").isin(*LAYERS[:2])).join(active, "scope")
    common = layers.filter(~F.col("layer").isin(*LAYERS[:2])).withColumn("context", F.lit(None).cast("string"))
    rows = scoped.select("context", "key", rank.alias("_r"), *values).unionByName(
        common.select("context", "key", rank.alias("_r"), *values))
    return rows.groupBy("context", "key").agg(F.min_by(F.struct(*values), F.col("_r")).alias("_v")).select(
        "context", "key", "_v.*")


def lookup_terms(wanted: DataFrame, resolved: DataFrame) -> DataFrame:
    """(context, key) rows with the winning target: the entry of the context, else the common one."""
    own = resolved.filter(F.col("context").isNotNull()).select("context", "key", F.col("target").alias("_own"),
                                                               F.col("layer").alias("_own_layer"))
    common = resolved.filter(F.col("context").isNull()).select("key", F.col("target").alias("_common"),
                                                               F.col("layer").alias("_common_layer"))
    return (
        wanted.join(own, ["context", "key"], "left").join(common, "key", "left")
        .withColumn("target", F.coalesce("_own", "_common"))
        .withColumn("layer", F.coalesce("_own_layer", "_common_layer"))
        .drop("_own", "_own_layer", "_common", "_common_layer")
    )


def units(text: Column, unit: str) -> Column:
    """Characters, or tokens between white space."""
    parts = F.split(text, "") if unit == "char" else F.split(text, r"(?U)\s+")
    return F.filter(parts, lambda u: u != "")


def _listed(lexicon: DataFrame, unit: str, start: str | None, longest: int | None) -> DataFrame:
    """The lexicon's rows with the first unit and the number of units of their key, those that a text can hold."""
    sized = lexicon.withColumn("_u", units(F.col("key"), unit))
    sized = sized.filter((F.size("_u") > 0) & (F.col("key") == F.array_join("_u", "" if unit == "char" else " ")))
    sized = sized.withColumn("_head", F.get("_u", F.lit(0))).withColumn("_n", F.size("_u")).drop("_u")
    if start:
        sized = sized.filter(F.col("_head").rlike(start))
    return sized if longest is None else sized.filter(F.col("_n") <= longest)


def _held(lexicon: DataFrame) -> bool:
    """Whether all rows of a lexicon are at most ``HELD`` bytes; other types than flat ones are not weighed."""
    if any(t.startswith(("array", "map", "struct", "variant")) for _, t in lexicon.dtypes):
        return False
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(0) for c, t in lexicon.dtypes]
    return (lexicon.agg(F.sum(sum(sizes, F.lit(16 * len(sizes))))).first()[0] or 0) <= HELD


def match_spans(segments: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text", unit: str = "char",
                start: str | None = None, longest: int | None = None, in_row: int = IN_ROW) -> DataFrame:
    """Every place where a lexicon key stands in a segment: (keys, pos, n_units, key, lexicon columns).

    ``start`` is a pattern the first unit has to match; ``longest`` leaves out keys of more units. Keys of at most ``in_row``
    bytes go to the rows and are looked for by ``spans_in``; a longer list meets the places in equi joins. Both give the same rows.
    Spans found in the rows get the columns of a lexicon of at most ``HELD`` bytes where they are; they outnumber the tokens.
    """
    char = unit == "char"
    entries = _listed(lexicon, unit, start, longest)
    wanted = entries.select("key", "_head", "_n").distinct()
    known, most = wanted.agg(F.sum(F.octet_length("key") + F.octet_length("_head") + 16), F.max("_n")).first()
    if (known or 0) <= in_row:
        listed = segments.select(*keys, spans_in(F.col(text), [tuple(r) for r in wanted.collect()], unit).alias("_found"))
        entries = entries.select(*lexicon.columns)
        return listed.select(*keys, F.inline("_found")).join(F.broadcast(entries) if _held(entries) else lexicon, "key")
    prefix = wanted.groupBy("_head").agg(F.collect_set("_n").alias("_lengths"))
    placed = segments.select(*keys, units(F.col(text), unit).alias("_units")).select(
        *keys, "_units", F.posexplode("_units").alias("_i", "_head"))
    # A place carries the next units as one string; only the lengths that keys of its first unit have are tried.
    windows = placed.select(
        *keys, (F.col("_i") + 1).cast("long").alias("pos"), "_head", (F.size("_units") - F.col("_i")).alias("_left"),
        F.array_join(F.slice("_units", F.col("_i") + 1, most), "" if char else " ").alias("_w"))
    candidates = windows.join(prefix, "_head").select(
        *keys, "pos", "_left", "_w", F.explode("_lengths").alias("_k")).filter("_k <= _left").select(
        *keys, "pos", F.col("_k").cast("long").alias("n_units"),
        F.expr("substring(_w, 1, _k)" if char else "substring_index(_w, ' ', _k)").alias("key"))
    return candidates.join(lexicon, "key")


def present_terms(chapters: DataFrame, terms: DataFrame, keys: list[str], text: str = "text",
                  term: str = "term", in_row: int = IN_ROW) -> DataFrame:
    """Distinct (keys, term) where a text of the chapter contains the term.

    A list of at most ``in_row`` bytes goes to the rows and is looked for by ``terms_in``; no text moves. A longer list meets the distinct heads of the texts (``HEAD_UNITS`` characters from every place,
    all of a shorter term) in an equi join, and its candidates are looked for in the text. Both give the same rows. Null and
    empty terms, null texts and null keys give none.
    """
    wanted = terms.select(F.col(term).alias("_term")).filter("_term <> ''").distinct().withColumn(
        "_head", F.substring("_term", 1, HEAD_UNITS))
    rows = chapters.select(*keys, F.col(text).alias("_text")).dropna(subset=[*keys, "_text"])
    known = wanted.agg(F.sum(F.octet_length("_term") + 16)).first()[0] or 0
    if known <= in_row:
        listed = rows.select(*keys, terms_in(F.col("_text"), [t for t, _ in wanted.collect()]).alias("_found"))
        return listed.select(*keys, F.explode("_found").alias(term)).distinct()
    cut = bound(rows, _starts=F.array_distinct(F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{1,{HEAD_UNITS}}}))"), F.lit(1))))
    heads = F.array_distinct(F.flatten(F.array(*[F.transform("_starts", _first(n)) for n in range(1, HEAD_UNITS + 1)])))
    met = cut.select(*keys, F.explode(elements(heads)).alias("_head")).join(wanted, "_head").select(*keys, "_term").distinct()
    packed = met.groupBy(*keys).agg(F.collect_list("_term").alias("_terms"))
    both = bound(rows.join(packed, keys), _found=F.filter("_terms", lambda t: F.contains("_text", t)))
    return both.select(*keys, F.explode("_found").alias(term)).distinct()


def packed_terms(chapters: DataFrame, terms: list[str], keys: list[str], text: str = "text") -> DataFrame:
    """The rows of ``present_terms`` packed, one for each chapter: (keys, found), the terms by their numbers in ``terms`` (``numbers_in``).

    A chapter's texts are put together by partition first, so that no row gathers more than a partition holds, or a list from each.
    """
    found = chapters.dropna(subset=[*keys, text]).select(*keys, numbers_in(F.col(text), terms).alias("found"))
    for by in ([*keys, "_part"], keys):
        found = found.withColumn("_part", F.spark_partition_id()).groupBy(*by).agg(F.collect_list("found").alias("found")).withColumn(
            "found", merged_numbers(F.col("found")))
    return found


def _first(n: int):
    return lambda text: F.substring(text, 1, n)


def active_universes(chapters: DataFrame, markers: DataFrame | None, keys: list[str], text: str = "text") -> DataFrame:
    """Universes whose marker occurs in the chapter. ``markers``: marker, universe (the usual ones when None)."""
    if markers is None:
        markers = chapters.sparkSession.createDataFrame(list(N.UNIVERSE_MARKERS.items()), "marker string, universe string")
    found = present_terms(chapters, markers, keys, text, "marker")
    return found.join(markers, "marker").select(*keys, "universe").distinct()


def numeral_spans(segments: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Numbers as spans: at each place inside a run the rest of the run, with its value as target."""
    chars = units(F.col(text), "char")
    rest = segments.select(*keys, chars.alias("_c")).select(
        *keys, F.posexplode(elements(F.col("_c"))).alias("_i", "_u"), "_c"
    ).filter(F.contains(F.lit(CJK_NUMERAL), F.col("_u")))
    run = F.regexp_extract(
        F.array_join(F.slice("_c", F.col("_i") + 1, F.size("_c")), ""), f"^[{CJK_NUMERAL}]+", 0)
    return rest.select(*keys, (F.col("_i") + 1).cast("long").alias("pos"), run.alias("key")).withColumn(
        "n_units", F.length("key").cast("long")).withColumn("target", F.format_string("%.0f", numeral_value(F.col("key"))))


def _entry_cost(n: Column) -> Column:
    return COST_DICT * n + COST_TOKEN - COST_TIER * F.coalesce("tier", F.lit(0)) + COST_PRIORITY * F.coalesce("priority", F.lit(0))


def _millionths(cost: Column) -> Column:
    return F.round(cost * COST_SCALE).cast("long")


def gloss(segments: DataFrame, spans: DataFrame, keys: list[str], text: str = "text", unit: str = "char",
          script: str = HAN_START) -> DataFrame:
    """Least-cost cover of each segment: one row per token (keys, pos, n_units, src, tgt, kind).

    ``spans``: (keys, pos, n_units, kind, target, tier, priority) with kind ``number``, ``dict`` or ``reading``.
    Units outside the script pass for free, uncovered ones are unknown. Ties fall to number, longest entry, reading,
    unknown. Costs are whole millionths, so equal covers are equal whatever the order of adding.

    A segment stays one row: its spans are gathered into it in order, and an Arrow helper walks from the right over numbers only
    (``functions/spans.py:cover``). Work is linear in units and spans, however dense.
    """
    glue = "" if unit == "char" else " "
    size = F.col("n_units").cast("int")
    order = F.when(F.col("kind") == "number", 0).when(F.col("kind") == "dict", 1000 - size).otherwise(2000)
    counted = spans if "n_script" in spans.columns else spans.withColumn("n_script", F.col("n_units"))
    weight = F.when(F.col("kind") == "reading", F.lit(COST_READING + COST_TOKEN)).otherwise(_entry_cost(F.col("n_script")))
    place = "struct<at:int,cost:bigint,ord:int,n:int,kind:string,tgt:string>"
    # Spans that start outside the script do not count: such a unit always passes.
    usable = counted.filter(F.col("key").rlike(f"^{script}")) if "key" in spans.columns else counted
    span = F.struct((F.col("pos") - 1).alias("at"), _millionths(weight).alias("cost"), order.alias("ord"), size.alias("n"),
                    F.col("kind"), F.col("target").alias("tgt")).cast(place)
    mine = [f"_{k}" for k in keys]
    packed = usable.select(*[F.col(k).alias(f"_{k}") for k in keys], span.alias("s")).groupBy(*mine).agg(F.sort_array(F.collect_list("s")).alias("_s"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = segments.select(*keys, F.col(text).alias("_text")).join(packed, same, "left")
    rows = bound(joined.select(*keys, "_text", F.coalesce("_s", F.array().cast(f"array<{place}>")).alias("_s")), _u=units(F.col("_text"), unit)).filter(
        F.size("_u") > 0).drop("_text")
    picked = rows.select(*keys, "_u", "_s", cover(F.transform("_u", lambda u: u.rlike(script)), "_s", COST_OF_UNKNOWN).alias("_at"))

    def token(t):
        def named(s):
            n = F.coalesce(s["n"], F.lit(1))
            src = F.when(n == 1, F.get("_u", t["at"])).otherwise(F.array_join(cut(F.col("_u"), t["at"], n), glue))
            return F.struct((t["at"] + 1).cast("long").alias("pos"), n.cast("long").alias("n_units"), src.alias("src"),
                            F.when(t["span"] < 0, src).otherwise(s["tgt"]).alias("tgt"),
                            F.when(t["span"] == UNKNOWN, "unknown").when(t["span"] == PASS, "pass").otherwise(s["kind"]).alias("kind"))

        return let(F.get("_s", t["span"]), named)

    # Bound, so that the filter ``inline`` brings along does not build the tokens again.
    return bound(picked, _t=F.transform("_at", token)).select(*keys, F.inline("_t"))


def gloss_rows(segments: DataFrame, entries: DataFrame, keys: list[str], text: str = "text", unit: str = "char",
               script: str = HAN_START, longest: int | None = None, in_row: int = IN_ROW) -> DataFrame:
    """Least-cost cover of each segment by entries (key, target, tier, priority) alone: (keys, tokens), tokens as ``gloss`` gives them.

    Entries of at most ``in_row`` bytes go to the rows, where spans are found and weighed, so nothing moves; more of them go by
    ``match_spans`` and ``gloss``. Both give the same rows, none for a segment without units. ``keys`` tell segments apart.
    """
    listed = _listed(entries, unit, f"^{script}", longest).select(
        "key", "_head", "_n", _millionths(_entry_cost(F.col("_n"))).alias("_cost"), (1000 - F.col("_n")).alias("_ord"), "target")
    known = listed.agg(F.sum(F.octet_length("key") + F.octet_length("_head") + F.octet_length(F.coalesce("target", F.lit(""))) + 16)).first()[0]
    if (known or 0) <= in_row:
        own = F.transform(units(F.coalesce(F.col(text), F.lit("")), unit), lambda u: u.rlike(script))
        found = covered_by(F.col(text), own, [tuple(r) for r in listed.collect()], unit, COST_OF_UNKNOWN)
        return segments.select(*keys, found.alias("tokens")).filter(F.size("tokens") > 0)
    spans = match_spans(segments, entries, keys, text, unit, f"^{script}", longest, in_row).withColumn("kind", F.lit("dict"))
    return gloss(segments, spans, keys, text, unit, script).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "n_units", "src", "tgt", "kind"))).alias("tokens"))


def draft(tokens: Column) -> Column:
    """Draft line of tokens in order: targets, words parted by a space, passed characters kept as they are."""
    def letters(t):
        return (t["kind"] == "pass") & t["tgt"].rlike(r"^[\p{L}\p{N}]+$")

    def piece(filled):
        def spaced(t, i):
            before = F.get(filled, i - 1)
            parted = (i > 0) & ~before["tgt"].rlike(r"(?U)\s$") & F.when(
                t["kind"] == "pass", letters(t) & ~letters(before)).otherwise(True)
            return F.concat(F.when(parted, " ").otherwise(""), t["tgt"])

        return F.array_join(F.transform(filled, spaced), "")

    return strip(let(F.filter(tokens, lambda t: F.coalesce(t["tgt"], F.lit("")) != ""), piece))


def draft_text(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Draft line of a segment from its tokens, one row each."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "kind", "tgt")))
    return tokens.groupBy(*keys).agg(ordered.alias("_t")).select(*keys, draft(F.col("_t")).alias("draft"))


def gloss_chain(segments: DataFrame, entries: DataFrame, memory: DataFrame, keys: list[str], charmap: DataFrame | None = None,
                readings: DataFrame | None = None, text: str = "text", scope: str = "scope", script: str = HAN_START) -> DataFrame:
    """Drafts of segments from all there is: (keys, via, draft, total_units, matched_units).

    Characters are mapped first. A segment that the memory holds is its translation as it stands (via ``memory``); the others
    are covered by numbers, entries (key, target, tier, priority) and readings (one character: key, target) at the least
    cost (via ``cover``). An empty segment has an empty draft. ``matched_units`` are the script's units that a number, an entry, a
    reading or the memory covers, of ``total_units`` in the script.
    """
    mapped = segments if charmap is None else map_chars(segments, charmap, text)
    looked = tm_lookup(mapped, memory, text, scope)
    in_script = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda u: u.rlike(script))).cast("long")
    known = looked.filter("translated_text IS NOT NULL").select(
        *keys, F.lit("memory").alias("via"), F.col("translated_text").alias("draft"), in_script.alias("total_units"), in_script.alias("matched_units"))
    rest = looked.filter("translated_text IS NULL").select(*keys, text)
    spans = match_spans(rest, entries, keys, text, start=script).select(*keys, "pos", "n_units", "key", F.lit("dict").alias("kind"), "target", "tier", "priority")
    numbers = numeral_spans(rest, keys, text).withColumn("kind", F.lit("number"))
    spans = spans.unionByName(numbers, allowMissingColumns=True)
    if readings is not None:
        read = match_spans(rest, readings.filter(F.length("key") == 1).select("key", "target"), keys, text, start=script, longest=1)
        spans = spans.unionByName(read.withColumn("kind", F.lit("reading")), allowMissingColumns=True)
    tokens = checkpointed(gloss(rest, spans, keys, text, script=script))
    counted = tokens.groupBy(*keys).agg(
        F.sum(F.when(F.col("kind") != "pass", F.col("n_units")).otherwise(0)).cast("long").alias("total_units"),
        F.sum(F.when(F.col("kind").isin("number", "dict", "reading"), F.col("n_units")).otherwise(0)).cast("long").alias("matched_units"))
    drafts = draft_text(tokens, keys).join(counted, keys)
    covered = rest.select(*keys).join(drafts, keys, "left").select(
        *keys, F.lit("cover").alias("via"), F.coalesce("draft", F.lit("")).alias("draft"), *[
            F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total_units", "matched_units")])
    return known.unionByName(covered)


def coverage(tokens: DataFrame, keys: list[str], matched: Column, counted: Column, size: Column) -> DataFrame:
    """Matched share per group and over all coarser groups (rollup); 1.0 where nothing has to be matched."""
    # Groups are summed first: a rollup would take every token once for each of its levels.
    summed = tokens.groupBy(*keys).agg(F.sum(F.when(counted, size).otherwise(0)).alias("_total"), F.sum(F.when(counted & matched, size).otherwise(0)).alias("_hit"))
    total, hit = F.sum("_total"), F.sum("_hit")
    return summed.rollup(*keys).agg(
        total.cast("long").alias("total_units"), hit.cast("long").alias("matched_units"),
        F.when(total == 0, F.lit(1.0)).otherwise(F.round(hit / total, 4)).alias("coverage"))


def trim_suffixes(name: Column, suffixes: str = N.NAME_SUFFIXES) -> Column:
    """Drop trailing suffix characters as long as one character is left."""
    return F.regexp_replace(name, f"(?<=.)[{suffixes}]+$", "")


def mentions(spans: DataFrame, types=N.CHARACTER_TYPES + N.GLOSSARY_TYPES, suffixes: str = N.NAME_SUFFIXES,
             min_length: int = 2) -> DataFrame:
    """Spans of entity types as mentions, names without suffix characters, at least two characters long."""
    kept = spans.filter(F.col("type").isin(*types))
    raw = F.when(F.col("type").isin(*N.CHARACTER_TYPES), trim_suffixes(F.col("key"), suffixes)).otherwise(F.col("key"))
    return kept.withColumn("raw", raw).filter(F.length("raw") >= min_length)


def entity_counts(rows: DataFrame, order: Column, by: list[str] | None = None) -> DataFrame:
    """Mentions counted per raw form and class with the first target seen."""
    kind = F.when(F.col("type").isin(*N.CHARACTER_TYPES), "characters").when(
        F.col("type").isin(*N.GLOSSARY_TYPES), "glossary").otherwise("unknown")
    keys = [*(by or []), "raw", "class"]
    return rows.withColumn("class", kind).withColumn("_o", order).groupBy(*keys).agg(
        F.count("*").alias("frequency"), F.min_by("target", "_o").alias("target"))


def read_names(names: DataFrame, readings: DataFrame, keys: list[str], raw: str = "raw",
               overrides: dict[str, str] | None = None) -> DataFrame:
    """Reading of a name character by character (first reading of each), title case; unknown characters stay."""
    fixed = F.lit(None).cast("string")
    for char, reading in (N.READING_OVERRIDES if overrides is None else overrides).items():
        fixed = F.when(F.col("_ch") == char, reading).otherwise(fixed)
    first = readings.select(F.col("key").alias("_ch"), strip(F.substring_index("value", ",", 1)).alias("_r"))
    chars = names.select(*keys, F.posexplode(elements(units(F.col(raw), "char"))).alias("_i", "_ch"))
    read = chars.join(first, "_ch", "left").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_i", F.coalesce(fixed, F.col("_r"), F.col("_ch")).alias("r")))).alias("_l"))
    return read.select(*keys, F.initcap(F.array_join(F.transform("_l", lambda s: s["r"]), " ")).alias("target"))


def merge_runs(chars: DataFrame, keys: list[str], pos: str, width: int = 4096) -> DataFrame:
    """Neighbouring positions become one run: (keys, run_start, run_end, n)."""
    numbered = position(chars.select(*keys, pos).distinct(), keys, [F.col(pos)],
                        F.floor(F.col(pos) / F.lit(width)), "_n")
    return numbered.groupBy(*keys, (F.col(pos) - F.col("_n")).alias("_island")).agg(
        F.min(pos).alias("run_start"), F.max(pos).alias("run_end"), F.count("*").alias("n")).drop("_island")


def apply_token_rules(tokens: DataFrame, rules: DataFrame, token: str = "token", many: bool = False) -> DataFrame:
    """Literal rule table on tokens: the first rule by priority, then id, replaces the target.

    ``many``: rules come from a large table, too many to broadcast but far fewer than tokens. Their partitions are then hashed, so that
    the tokens are not sorted.
    """
    usable = rules.filter(F.col("enabled") & (F.col("rule_type") == "replace"))
    first = usable.groupBy(F.col("pattern").alias(token)).agg(
        F.min_by("replacement", F.struct("priority", "id")).alias("_new"))
    joined = tokens.join(first.hint("shuffle_hash") if many else first, token, "left")
    return joined.withColumn("target", F.coalesce("_new", token)).drop("_new")


def map_chars(df: DataFrame, charmap: DataFrame, text: str = "text") -> DataFrame:
    """Characters replaced by the map table (trad -> simp), whatever the size of the table.

    A key is one character, so the table is bounded by the characters there are; it reaches the rows as two strings of a
    scalar subquery. Values of other than one character go through a private-use character each. Null values leave their
    key as it is; rows, null texts and repeated keys of ``df`` stay as they are.
    """
    rows = charmap.filter(F.length("trad") == 1).groupBy("trad").agg(F.min("simp").alias("simp")).filter("simp IS NOT NULL")
    single = rows.filter(F.length("simp") == 1).withColumn("by", F.col("simp"))
    number = F.row_number().over(Window.orderBy("trad"))
    other = rows.filter(F.length("simp") != 1).withColumn(
        "by", F.decode(F.unhex(F.lpad(F.hex(number + PRIVATE_USE), 8, "0")), "UTF-32"))
    pairs = F.array_sort(F.collect_list(F.struct("trad", "by", "simp")))
    packed = single.unionByName(other).agg(F.struct(
        F.array_join(F.transform(pairs, lambda p: p["trad"]), "").alias("old"),
        F.array_join(F.transform(pairs, lambda p: p["by"]), "").alias("new"),
        F.filter(pairs, lambda p: p["by"] != p["simp"]).alias("long")).alias("m"))
    tagged = df.withColumn("_m", packed.scalar())
    swapped = F.expr(f"translate(`{text}`, _m.old, _m.new)")
    whole = F.aggregate(F.col("_m.long"), swapped, lambda acc, p: F.replace(acc, p["by"], p["simp"]))
    return tagged.withColumn(text, whole).drop("_m")


def name_origin(entities: DataFrame, tables: DataFrame, name: str = "name") -> DataFrame:
    """Origin and Latin form of a name: Latin, Japanese or Korean, null when unknown.

    ``tables``: (kind, ord, key, value) with full names, prefixes, given names and first characters. Each test is an
    equi join on the whole name, its first character or its leading characters.
    """
    clean = F.regexp_replace(strip(F.col(name)), r"(?U)\s+", " ")
    base = entities.withColumn("_n", clean).withColumn("_first", F.substring("_n", 1, 1))

    def lookup(kind, column, out):
        return tables.filter(F.col("kind") == kind).groupBy(F.col("key").alias(column)).agg(
            F.min_by("value", "ord").alias(out))

    out = (
        base.join(lookup("japanese_full", "_n", "_jfull"), "_n", "left")
        .join(lookup("korean_full", "_n", "_kfull"), "_n", "left")
        .join(lookup("korean_surname", "_first", "_ks"), "_first", "left")
        .join(lookup("hanja_surname", "_first", "_hs"), "_first", "left")
    )
    # One lookup per length that prefixes have: no name is multiplied, and only the tables can be the built side of a join.
    prefixes = tables.filter((F.col("kind") == "japanese_prefix") & (F.col("key") != ""))
    lengths = sorted(prefixes.agg(F.collect_set(F.length("key"))).first()[0])
    for n in lengths:
        hits = prefixes.filter(F.length("key") == n).groupBy(F.col("key").alias("_lead")).agg(
            F.min(F.struct("ord", "value", "key")).alias(f"_hit{n}"))
        out = out.withColumn("_lead", F.substring("_n", 1, n)).join(hits, "_lead", "left").drop("_lead")
    none = F.lit(None).cast(prefixes.select(F.struct("ord", "value", "key").alias("s")).schema["s"].dataType)
    out = out.withColumn("_best", F.least(none, none, *[F.col(f"_hit{n}") for n in lengths]))
    out = out.withColumn(
        "_rest", F.when(F.col("_best").isNull(), F.col("_n")).otherwise(
            F.expr("substring(_n, length(_best.key) + 1)")))
    out = out.join(lookup("japanese_given", "_rest", "_given"), "_rest", "left")
    romaji = F.concat(F.coalesce(F.col("_best.value"), F.lit("")), F.coalesce("_given", "_rest"))
    romaji = F.when(~romaji.rlike(CJK) & (romaji != ""), romaji)
    n = F.col("_n")
    korean_tail = F.concat_ws(" ", F.coalesce("_ks", "_hs"), F.nullif(F.expr("substring(_n, 2)"), F.lit("")))
    japanese = F.col("_best").isNotNull() | n.rlike(f"{HIRAGANA}|{KATAKANA}")
    kind = (
        F.when(F.length(n) < 2, None)
        .when(F.col("_jfull").isNotNull(), "Japanese")
        .when(n.rlike(LATIN) & ~n.rlike(CJK), "Latin")
        .when(n.rlike(HANGUL), "Korean")
        .when(~n.rlike(CJK), None)
        .when(japanese, F.when(romaji.isNotNull(), "Japanese"))
        .when(F.col("_kfull").isNotNull(), "Korean")
        .when(F.col("_hs").isNotNull(), F.when(~korean_tail.rlike(CJK), "Korean"))
        .when(romaji.isNotNull(), "Japanese")
    )
    converted = (
        F.when(F.length(n) < 2, None)
        .when(F.col("_jfull").isNotNull(), F.col("_jfull"))
        .when(n.rlike(LATIN) & ~n.rlike(CJK), F.btrim(n, F.lit(" _-.")))
        .when(n.rlike(HANGUL), F.when(F.col("_ks").isNotNull(), korean_tail).otherwise(n))
        .when(~n.rlike(CJK), None)
        .when(japanese, romaji)
        .when(F.col("_kfull").isNotNull(), F.col("_kfull"))
        .when(F.col("_hs").isNotNull(), F.when(~korean_tail.rlike(CJK), korean_tail))
        .otherwise(romaji)
    )
    return out.select(*entities.columns, kind.alias("origin"), converted.alias("converted"))
