"""Column expressions for raw HTML strings. Whole pages are processed by regular expressions on the JVM side."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.arrays import cut, let, running_sums
from corpusloom.functions.text import squeeze, strip

# --- fixed values ---------------------------------------------------------------------------------------------
BLOCK_TAGS = ("p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "section", "article", "body",
              "title", "blockquote", "hr")
SKIP_TAGS = ("script", "style", "head")
# --- end of fixed values --------------------------------------------------------------------------------------

BLOCK_PATTERN = r"(?i)</?(?:" + "|".join(BLOCK_TAGS) + r")(?:\s[^>]*)?/?(?:>|\z)"
ANY_TAG = r"(?s)</?[A-Za-z!?][^>]*(?:>|\z)"


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """Character references become characters. Only texts that hold one travel to Python (in Arrow batches)."""
    return F.coalesce(_unescape(F.when(text.rlike("&(?:#|[A-Za-z])"), text)), text)


def drop_elements(html: Column, tags) -> Column:
    """Remove elements with their content; one that is never closed takes the rest of the page."""
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", "")
    return html


def drop_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def tag_text(html: Column, separator: str = "") -> Column:
    """Text of an HTML fragment: block tags become line breaks, other tags the separator."""
    broken = F.regexp_replace(html, BLOCK_PATTERN, "\n")
    return F.regexp_replace(broken, ANY_TAG, separator)


def inline_text(html: Column) -> Column:
    """Text of a small fragment on one line."""
    return squeeze(unescape(F.regexp_replace(html, ANY_TAG, " ")))


def element(html: Column, tag: str) -> Column:
    """Inner HTML of the first such element, empty when absent."""
    return F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def _name(piece: Column) -> Column:
    """Lower-case tag name of a piece that starts with a tag, with the slash of a closing one."""
    return F.lower(F.regexp_extract(piece, r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1))


def tag_pieces(html: Column, tag: str) -> Column:
    """A page cut before every opening and closing tag of one name; the first piece stands before the first tag."""
    return F.split(html, rf"(?i)(?=</?{tag}[\s/>])")


def element_spans(pieces: Column, tag: str) -> Column:
    """(open, close) of the elements of one name over ``tag_pieces``, in the order of their opening tags: the piece that an
    element's opening tag begins, and the piece that its own closing tag begins (the number of pieces, if it has none).

    Tags are put in order of their depth; each opening one is then followed by its closing one, so that one sort pairs
    all of a page, nested ones too.
    """
    tagged = F.transform(pieces, lambda p: F.when(p.rlike(rf"(?i)^<{tag}[\s/>]"), 1).when(p.rlike(rf"(?i)^</{tag}[\s/>]"), -1).otherwise(0))

    def paired(tags):
        return F.filter(F.transform(tags, lambda t, i: F.struct(t["at"].alias("open"), F.when(
            t["opens"] == 1, let(F.get(tags, i + 1), lambda n: F.when((n["level"] == t["level"]) & (n["opens"] == -1), n["at"]).otherwise(-1))
        ).alias("close"))), lambda s: s["close"].isNotNull())

    def by_level(signs):
        return let(running_sums(signs), lambda depth: F.array_sort(F.filter(F.transform(signs, lambda s, i: F.struct(
            F.when(s == 1, F.get(depth, i)).otherwise(F.get(depth, i) + 1).alias("level"), i.alias("at"), s.alias("opens"))),
            lambda t: t["opens"] != 0)))

    return let(F.size(pieces), lambda size: F.transform(F.array_sort(let(let(tagged, by_level), paired)), lambda s: F.struct(
        s["open"].alias("open"), F.when(s["close"] < 0, size).otherwise(s["close"]).alias("close"))))


def whole_elements(html: Column, tag: str, opening: str) -> Column:
    """All elements of a name whose opening tag matches, nested ones too, each from its opening tag up to its own closing
    tag with all that stands in it; one that is never closed takes the rest of the page."""
    def whole(pieces):
        spans = F.filter(element_spans(pieces, tag), lambda s: F.get(pieces, s["open"]).rlike(opening))
        return F.transform(spans, lambda s: F.array_join(cut(pieces, s["open"], s["close"] - s["open"]), ""))

    return let(tag_pieces(html, tag), whole)


def inside(html: Column, opening: str) -> Column:
    """Inner HTML of the first element whose opening tag matches, up to its own closing tag however it is nested; one
    that is never closed takes the rest, none gives an empty text."""
    at = F.regexp_instr(html, F.lit(opening))

    def closed(pieces):
        # Depth -1 says that the element is closed; n counts the pieces before its closing tag.
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))
        step = lambda s, piece: let(F.when(piece.startswith("</"), -1).otherwise(1) + s["depth"], lambda depth: F.when(
            s["depth"] < 0, s).otherwise(F.struct(F.when(depth == 0, -1).otherwise(depth).alias("depth"),
                                                  (s["n"] + F.when(depth == 0, 0).otherwise(1)).alias("n"))))
        n = F.aggregate(pieces, start, step, lambda s: s["n"])
        return F.regexp_replace(F.array_join(F.slice(pieces, 1, n), ""), r"^<[^>]*>", "")

    def cut(rest):
        # Only tags of the element's own name count, so the rest is cut at these alone.
        tag = F.regexp_extract(rest, r"^<([A-Za-z][A-Za-z0-9]*)", 1)
        return let(F.split(rest, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"(?![A-Za-z0-9]))"))), closed)

    return F.when(at > 0, let(html.substr(at, F.length(html)), cut)).otherwise(F.when(html.isNotNull(), F.lit("")))


def insides(html: Column, opening: str) -> Column:
    """Inner HTML of all outermost elements whose opening tag matches, one after the other."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("tag"), F.lit("").alias("out"))

    def step(s, piece):
        name = _name(piece)
        depth = s["depth"] + F.when(name == s["tag"], 1).when(name == F.concat(F.lit("/"), s["tag"]), -1).otherwise(0)
        opened = F.struct(F.lit(1).alias("depth"), name.alias("tag"), F.concat(
            s["out"], F.lit("\n"), F.regexp_replace(piece, r"^<[^>]*>", "")).alias("out"))
        going = F.struct(depth.alias("depth"), s["tag"].alias("tag"), F.when(depth == 0, s["out"]).otherwise(
            F.concat(s["out"], piece)).alias("out"))
        return F.when(s["depth"] > 0, going).when(piece.rlike(opening), opened).otherwise(s)

    return F.aggregate(F.split(html, "(?=<)"), start, step, lambda s: s["out"])


def _named(tag: str, attribute: str, value: str) -> str:
    return rf"""(?is)<{tag}\b[^>]*\b{attribute}\s*=\s*["'](?:[^"']*\s)?{value}(?:\s[^"']*)?["'][^>]*>"""


def element_by_id(html: Column, tag: str, attribute: str, value: str) -> Column:
    return inside(html, _named(tag, attribute, value))


def insides_by(html: Column, attribute: str, value: str) -> Column:
    """Inner HTML of all outermost elements that carry the value; null where a page has none."""
    opening = _named(r"(?!img\b)\w+", attribute, value)
    return F.when(html.rlike(opening), insides(html, opening))


def or_null(text: Column) -> Column:
    """Null for an empty text. The text is computed once; ``nullif`` alone has it twice, and twice as often with each step around it."""
    return let(text, lambda t: F.nullif(t, F.lit("")))


def meta_content(html: Column, *names: str) -> Column:
    """Content of the first meta tag with one of the names (property before name), null when none has any."""
    tries = []
    for name in names:
        for key in ("property", "name"):
            tries.append(F.regexp_extract(
                html, rf"""(?is)<meta\b(?=[^>]*\b{key}\s*=\s*["']{name}["'])[^>]*\bcontent\s*=\s*["']([^"']*)["']""", 1
            ))
    return F.coalesce(*[or_null(strip(t)) for t in tries])


def base_parts(base: Column) -> Column:
    """Parts of a page address that links are resolved against, taken apart once per page."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(F.length(page) > F.length(origin), F.regexp_replace(page, r"[^/]*$", "")).otherwise(
        F.concat(origin, F.lit("/")))
    return F.struct(
        base.alias("base"), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1).alias("scheme"),
        origin.alias("origin"), page.alias("page"), folder.alias("folder"),
        F.regexp_extract(base, r"^([^#]*)", 1).alias("whole"))


def without_dots(url: Column) -> Column:
    """An address without ``.`` and ``..`` steps in its path; steps above the root vanish."""
    split = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)((?s:.*))$"
    steps = F.split(F.regexp_extract(url, split, 2), "/")
    ends = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == ".", done).when(
        s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(s))))
    return F.concat(F.regexp_extract(url, split, 1), F.array_join(F.concat(kept, ends), "/"), F.regexp_extract(url, split, 3))


def resolve(parts: Column, href: Column) -> Column:
    """Absolute form of a link, given the parts of the page address."""
    relative = F.concat(parts["folder"], href)
    rooted = F.concat(parts["origin"], href)
    return (
        F.when(href == "", parts["base"])
        .when(F.startswith(href, F.lit("//")), F.concat(parts["scheme"], F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.when(F.contains(href, F.lit("/.")), without_dots(rooted)).otherwise(rooted))
        .when(F.startswith(href, F.lit("#")), F.concat(parts["whole"], href))
        .when(F.startswith(href, F.lit("?")), F.concat(parts["page"], href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.rlike(r"(?:^|/)\.\.?(?:[/?#]|$)"), without_dots(relative))
        .otherwise(relative)
    )


def join_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    return resolve(base_parts(base), href)


def url_host(url: Column) -> Column:
    """Lower-case host without a leading ``www.``; works on addresses a strict parser rejects."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")
