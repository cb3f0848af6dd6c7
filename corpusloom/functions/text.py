"""Column expressions for text: trimming, line breaks, scripts, ids and numerals. All stay on the JVM side."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------------
# Characters a strip() removes: every Unicode white space.
STRIP_CHARS = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
# Source script: three CJK ranges.
CJK = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
HAN_START = "[\u3400-\u4dbf\u4e00-\u9fff]"
HANGUL = "[\uac00-\ud7af]"
HIRAGANA = "[\u3040-\u309f]"
KATAKANA = "[\u30a0-\u30ff]"
LATIN = "[A-Za-z]"
VIETNAMESE_MARKS = "[ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯàáâãèéêìíòóôõùúăđĩũơưẠ-ỹ]"
FOREIGN_MIN_LETTERS = 2
FOREIGN_MIN_SHARE = 0.55
# Numerals: digits, small units, big units, decimal mark.
CJK_DIGITS = "零一二三四五六七八九"
CJK_DIGIT_VARIANTS = ("〇○两兩萬億", "零零二二万亿")
CJK_SMALL_UNITS = {"十": 10, "百": 100, "千": 1000}
CJK_BIG_UNITS = {"万": 10_000, "亿": 100_000_000}
CJK_POINT = "点"
CJK_NUMERAL = "零〇○一二三四五六七八九十百千万萬亿億兩两"
FULL_WIDTH_DIGITS = "０１２３４５６７８９"
FILE_NAME_STOP = r'[\\/:*?"<>|]'
FILE_NAME_LENGTH = 120
# --- end of fixed values --------------------------------------------------------------------------------------


def accent_table() -> tuple[str, str]:
    """Marked Latin letters and their plain forms, built from the Unicode decomposition rule."""
    import unicodedata

    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        base = {"Đ": "D", "đ": "d"}.get(base, base)
        if len(base) == 1 and base != char:
            marked.append(char)
            plain.append(base)
    return "".join(marked), "".join(plain)


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` alone only knows the space)."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def split_lines(text: Column) -> Column:
    """Lines of a text without BOM; a final line break opens no extra line."""
    body = F.regexp_replace(text, r"^\x{FEFF}", "")
    lines = F.split(F.regexp_replace(body, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK, -1)
    return F.when(F.length(body) > 0, lines).otherwise(F.array().cast("array<string>"))


def elements(items: Column) -> Column:
    """Array to explode, null when empty.

    Exploding a plain column makes the optimizer add a size filter below the projection that built it, which would
    evaluate an expensive array expression twice; a conditional expression is left alone.
    """
    return F.when(F.size(items) > 0, items)


def contains_any(text: Column, needles) -> Column:
    """True when any of a short literal list occurs."""
    tests = [F.contains(text, F.lit(n)) for n in needles]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def has_residue(text: Column, script: str = CJK) -> Column:
    return F.coalesce(text.rlike(script), F.lit(False))


def residue_count(text: Column, script: str = CJK) -> Column:
    return F.regexp_count(text, F.lit(script)).cast("long")


def target_text(target: Column) -> Column:
    """A locked target without its bracketed type note."""
    return strip(F.substring_index(F.coalesce(target, F.lit("")), " (", 1))


def is_foreign_like(target: Column) -> Column:
    """A target that must be kept letter by letter: Hangul, or mostly plain Latin letters."""
    text = strip(F.coalesce(target, F.lit("")))
    letters = F.regexp_count(text, F.lit(LATIN))
    return (
        F.when((text == "") | text.rlike(CJK), False)
        .when(text.rlike(HANGUL), True)
        .when(text.rlike(VIETNAMESE_MARKS), False)
        .otherwise((letters >= FOREIGN_MIN_LETTERS) & (letters / F.length(text) >= FOREIGN_MIN_SHARE))
    )


def fold_accents(text: Column) -> Column:
    marked, plain = accent_table()
    return F.translate(text, marked, plain)


def safe_title(text: Column) -> Column:
    """Title usable in a file name."""
    cleaned = squeeze(F.regexp_replace(strip(text), FILE_NAME_STOP, ""))
    return F.substring(cleaned, 1, FILE_NAME_LENGTH)


def slug_id(title: Column, url: Column) -> Column:
    """ASCII slug of a title plus the first 8 hex digits of the address hash."""
    base = F.lower(F.btrim(F.regexp_replace(strip(F.coalesce(title, F.lit("novel"))), r"[^A-Za-z0-9_\-]+", "_"),
                           F.lit("_")))
    base = F.when(base == "", "novel").otherwise(base)
    seed = F.coalesce(F.nullif(url, F.lit("")), F.nullif(title, F.lit("")), base)
    return F.concat(F.substring(base, 1, 48), F.lit("_"), F.substring(F.sha1(seed), 1, 8))


def source_id(key: Column, prefix: str = "source:") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(key), 1, 12))


def plain_digits(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH_DIGITS, "0123456789")


def _numeral_fold(chars: Column, digit_runs: bool) -> Column:
    """Left fold over numeral characters: (total, section, number, run, plain, fresh)."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("number"), zero.alias("run"),
                     F.lit(True).alias("plain"), F.lit(True).alias("fresh"))

    def section_value(acc):
        units = acc["section"] + acc["number"]
        return F.when(acc["plain"], acc["run"]).otherwise(units) if digit_runs else units

    def step(acc, char):
        digit = (F.instr(F.lit(CJK_DIGITS), char) - 1).cast("long")
        unit = F.coalesce(*[F.when(char == k, F.lit(v).cast("long")) for k, v in CJK_SMALL_UNITS.items()])
        value = section_value(acc)
        lead = F.when(acc["fresh"], F.lit(1 if digit_runs else 0).cast("long")).otherwise(value)

        def state(total, section, number, run, plain, fresh):
            return F.struct(total.alias("total"), section.alias("section"), number.alias("number"),
                            run.alias("run"), plain.alias("plain"), fresh.alias("fresh"))

        yes, no = F.lit(True), F.lit(False)
        after_big = acc["total"] > 0
        return (
            F.when(digit == 0, state(acc["total"], acc["section"],
                                     acc["number"] if digit_runs else zero, acc["run"], acc["plain"],
                                     acc["fresh"] & after_big))
            .when(digit > 0, state(acc["total"], acc["section"], digit, acc["run"] * 10 + digit, acc["plain"], no))
            .when(unit.isNotNull(), state(acc["total"], acc["section"] + F.greatest(acc["number"], F.lit(1)) * unit,
                                          zero, zero, no, no))
            .when(char == "亿", state((acc["total"] + F.when(acc["fresh"] & after_big, zero).otherwise(lead))
                                      * CJK_BIG_UNITS["亿"], zero, zero, zero, yes, yes))
            .when(char == "万", state(acc["total"] + lead * CJK_BIG_UNITS["万"], zero, zero, zero, yes, yes))
            .otherwise(acc)
        )

    return F.aggregate(chars, start, step, lambda acc: acc["total"] + section_value(acc))


def numeral_value(text: Column, digit_runs: bool = True) -> Column:
    """Value of a run of digits or CJK numerals as double; null when it is not a clean number.

    ``digit_runs`` reads bare digit sequences as written (one-two-three is 123); without it the last digit counts,
    which is what heading numbers use.
    """
    clean = F.translate(plain_digits(strip(text)), *CJK_DIGIT_VARIANTS)
    whole = F.when(clean.rlike(f"^[{CJK_DIGITS}十百千万亿]+$"), _numeral_fold(F.split(clean, ""), digit_runs))
    left, right = F.substring_index(clean, CJK_POINT, 1), F.substring_index(clean, CJK_POINT, -1)
    left_value = F.when(left == "", F.lit(0).cast("long")).otherwise(_numeral_fold(F.split(left, ""), digit_runs))
    fraction = F.translate(right, CJK_DIGITS, "0123456789")
    decimal = F.when(
        clean.rlike(f"^[{CJK_DIGITS}十百千万亿]*{CJK_POINT}[{CJK_DIGITS}]+$"),
        F.concat(left_value.cast("string"), F.lit("."), fraction).cast("double"),
    )
    arabic = F.when(clean.rlike("^[0-9]+$"), clean.try_cast("double"))
    return F.coalesce(arabic, whole.cast("double"), decimal)


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only: the text before it is caught lazily and put back."""
    shifted = re.sub(r"\$(\d+)", lambda m: f"${int(m.group(1)) + 1}", replacement)
    return F.regexp_replace(text, f"(?s)\\A(.*?)(?:{pattern})", "$1" + shifted)


def url_unquote(text: Column, rounds: int = 4) -> Column:
    """Percent-decode up to ``rounds`` times; stray percent signs and plus signs stay as they are."""
    def once(current, _):
        guarded = F.replace(F.regexp_replace(current, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
        return F.coalesce(F.try_url_decode(guarded), current)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), text, once)
