"""String functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The first codes in GBK's first level of the syllables that begin with each letter; it is in order of sound.
SOUND_LETTERS = "abcdefghjklmnopqrstwxyz"
SOUND_STARTS = [45217, 45253, 45761, 46318, 46826, 47010, 47297, 47614, 48119, 49062, 49324, 49896, 50371, 50614, 50622, 50906, 51387, 51446, 52218, 52698, 52980, 53689, 54481]
SOUND_END = 55290
#: The marks that clean_marks takes for "_".
MARKS = "`~!@#$%^&*|{}':;\",/[]<>?！￥…（）—【】‘；：”“’。，、？"


def md5_hex(s: Column) -> Column:
    """MD5 of a text, null for a blank one."""
    return F.when(F.trim(s) != "", F.md5(s))


def without_tags(s: Column) -> Column:
    """Text without scripts, styles and tags."""
    s = F.regexp_replace(s, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    return F.regexp_replace(s, r"(?s)<[^>]*>", "")


def strip_html(s: Column) -> Column:
    """Text without scripts, styles and tags, its common entities decoded."""
    s = without_tags(s)
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(char))
    return s


def shorten(s: Column, n: int, end: str = "...") -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(end))).otherwise(s)


def or_default(s: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(s), F.lit("")), F.lit(default))


def is_numeric(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^\d+$"), F.lit(False))


def is_decimal(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^-?\d+(\.\d+)?$"), F.lit(False))


def is_letters(s: Column) -> Column:
    return F.coalesce(s.rlike("^[A-Za-z]+$"), F.lit(False))


def csv_to_longs(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ","), lambda x: F.trim(x) != ""), lambda x: F.try_to_number(F.trim(x), F.lit("S9999999999999999999")).cast("long"))


def parse_pairs(s: Column, pair: str = "&", key: str = "=") -> Column:
    return F.str_to_map(s, F.lit(pair), F.lit(key))


def format_pairs(m: Column, pair: str = "&", key: str = "=") -> Column:
    """Entries in order of key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(key), e["value"])), pair)


def between_marks(s: Column, start: str, end: str) -> Column:
    """What stands between the first `start` and the next `end`, "" if either is missing."""
    return F.regexp_extract(s, rf"(?s)\Q{start}\E(.*?)\Q{end}\E", 1)


def full_to_half(s: Column) -> Column:
    """Full-width ASCII forms and the ideographic blank as their plain characters."""
    codes = range(0x21, 0x7F)
    return F.translate(s, "　" + "".join(chr(c + 0xFEE0) for c in codes), " " + "".join(map(chr, codes)))


def display_width(s: Column) -> Column:
    """Length where characters beyond U+00FF count two."""
    return F.length(s) + F.regexp_count(s, F.lit(r"[^\u0000-ÿ]"))


def mask(s: Column, start: int, end: int, char: str = "*") -> Column:
    """Characters from `start` (0-based) up to `end` replaced."""
    n = F.greatest(F.least(F.lit(end), F.length(s)) - start, F.lit(0))
    return F.concat(F.substring(s, 1, start), F.repeat(F.lit(char), n), F.substring(s, end + 1, 1 << 30))


def mask_email(s: Column) -> Column:
    """The part before "@" but for its first character replaced by stars."""
    at = F.instr(s, "@")
    return F.when(at > 2, F.concat(F.substring(s, 1, 1), F.repeat(F.lit("*"), at - 2), F.substring(s, at, F.length(s)))).otherwise(s)


def only_digits(s: Column) -> Column:
    """Digits of a text, the letters o and O read as 0."""
    return F.regexp_replace(F.translate(s, "oO", "00"), r"\D", "")


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)


def extension_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def first_upper(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def glob_to_regex(glob: str) -> str:
    """`*` within a path step, `**` across steps (`**/x` fits x too), `?` one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def path_passes(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Excludes first; an empty include list accepts what is left."""
    hit = lambda globs: F.lit(False) if not globs else path.rlike("|".join(map(glob_to_regex, globs)))
    return ~hit(exclude) & (hit(include) if include else F.lit(True))


def _utf16(s: Column, escape: str) -> Column:
    """The text with each escape, a pattern whose matches end with two or four hexadecimal digits, read as UTF-16."""
    parts = F.regexp_extract_all(s, F.lit(rf"(?s){escape}|."), F.lit(0))
    code = lambda x: F.when(x.rlike(f"^{escape}$"), F.lpad(F.regexp_replace(x, r"^(\\u|%u|%)", ""), 4, "0")).otherwise(F.hex(F.encode(x, "UTF-16BE")))
    return F.decode(F.unhex(F.array_join(F.transform(parts, code), "")), "UTF-16BE")


def unescape(s: Column) -> Column:
    """%uXXXX and %XX as the characters of these codes; what is no escape stays."""
    return _utf16(s, "(?:%u[0-9A-Fa-f]{4}|%[0-9A-Fa-f]{2})")


def encode_unicode(s: Column) -> Column:
    r"""Each UTF-16 unit as \uXXXX."""
    return F.regexp_replace(F.lower(F.hex(F.encode(s, "UTF-16BE"))), "(.{4})", r"\\u$1")


def decode_unicode(s: Column) -> Column:
    r"""The inverse of encode_unicode; what is no \uXXXX stays."""
    return _utf16(s, r"\\u[0-9A-Fa-f]{4}")


def url_encode(s: Column) -> Column:
    return F.url_encode(s)


def url_decode(s: Column) -> Column:
    """Null for a text that is no URL encoding."""
    return F.try_url_decode(s)


def recode(s: Column, written: str, read: str) -> Column:
    """Bytes of the text in one charset read in another; characters that it lacks become "?"."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t.encode(written, "replace").decode(read, "replace") for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(s)


def first_letters(s: Column) -> Column:
    """Each Chinese character of GBK's first level as the letter that its sound begins with, others as they are in lower case."""
    from bisect import bisect_right

    def letter(c: str) -> str:
        code = int.from_bytes(c.encode("gbk", "replace"), "big")
        return SOUND_LETTERS[bisect_right(SOUND_STARTS, code) - 1] if SOUND_STARTS[0] <= code < SOUND_END else c

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else "".join(map(letter, t.lower())) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(s)


def connect(*parts: Column) -> Column:
    """The parts that aren't blank, a space behind each."""
    return F.concat(*[F.when(F.trim(p) != "", F.concat(p, F.lit(" "))).otherwise(F.lit("")) for p in parts])


def matches(s: Column, pattern: str) -> Column:
    """Whether the whole text matches; null doesn't."""
    return F.coalesce(s.rlike(f"^(?:{pattern})$"), F.lit(False))


def is_digits(s: Column) -> Column:
    return matches(s, "[0-9]+")


def is_blank(s: Column) -> Column:
    return F.coalesce(F.trim(s) == "", F.lit(True))


def join_items(items: Column, sep: str = ",") -> Column:
    """Items as text with a separator between them; nulls are left out."""
    return F.array_join(F.transform(items, lambda x: x.cast("string")), sep)


def split_by(s: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Parts between matches of a pattern; empty ones at the end are left out."""
    parts = F.split(s, f"(?i){pattern}" if ignore_case else pattern)
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return F.slice(parts, 1, F.greatest(last, F.lit(1)))


def query_parameters(url: Column) -> Column:
    """What stands behind "?" of a URL, as a map."""
    return parse_pairs(F.regexp_extract(url, r"\?([^#]*)", 1))


def all_matches(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def after_marks(s: Column, *marks: str) -> Column:
    """The text behind the first of each mark, one after another; a mark that is missing changes nothing."""
    for m in marks:
        s = F.when(F.instr(s, m) > 0, F.substring(s, F.instr(s, m) + F.lit(1), F.length(s))).otherwise(s)
    return s


def replace_text(s: Column, pattern: str, by: str) -> Column:
    """Matches in any case replaced."""
    return F.regexp_replace(s, f"(?i){pattern}", by)


def replace_between(s: Column, start: str, end: str, by: str) -> Column:
    """Each stretch from `start` to the next `end`, both included, replaced."""
    return F.regexp_replace(s, rf"(?s)\Q{start}\E.*?\Q{end}\E", by)


def without_blanks(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+", "")


def plain_brackets(s: Column) -> Column:
    return F.translate(s, "（）", "()")


def clean_marks(s: Column) -> Column:
    """Punctuation and backslashes as "_"."""
    return F.replace(F.trim(F.translate(s, MARKS, "_" * len(MARKS))), F.lit("\\"), F.lit("_"))


def clean_code(s: Column) -> Column:
    return F.regexp_replace(s, "[^a-zA-Z0-9]", "_")


def padded(s: Column, left: str = "%", right: str = "%") -> Column:
    """The text with marks at its ends, as for LIKE."""
    return F.concat(F.lit(left), s, F.lit(right))


def repeated(s: Column, n: int) -> Column:
    return F.repeat(s, n)


def format_number(x: Column, decimals: int) -> Column:
    """Rounded half up, without grouping."""
    return F.round(x.cast("decimal(38,18)"), decimals).cast(f"decimal(38,{decimals})").cast("string")


def positive_text(x: Column) -> Column:
    """A number over 0 as text, "" for others, null for null."""
    return F.when(x > 0, x.cast("string")).when(x.isNotNull(), "")


def money_text(x: Column) -> Column:
    """"" for 0, whole amounts without a fraction, others as they are."""
    return F.when(x == 0, "").when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def number_or(s: Column, kind: str, default: float = 0) -> Column:
    """The number that a text names, the default for others."""
    return F.coalesce(F.trim(s).try_cast(kind), F.lit(default).cast(kind))


def contains_any(s: Column, finds: list[str]) -> Column:
    hits = [F.contains(s, F.lit(f)) for f in finds]
    return F.coalesce(F.array_max(F.array(*hits)), F.lit(False)) if hits else F.lit(False)


def is_one_of(s: Column, items: list[str]) -> Column:
    return F.coalesce(s.isin(items), F.lit(False))


def positions(s: Column, sub: str) -> Column:
    """1-based places where `sub` begins, without overlap."""
    ends = F.transform(F.split(s, re.escape(sub)), lambda x: F.length(x))
    starts = F.transform(ends, lambda x, i: F.aggregate(F.slice(ends, F.lit(1), i + 1), F.lit(0), lambda a, y: a + y) + i * len(sub) + 1)
    return F.slice(starts, F.lit(1), F.greatest(F.size(starts) - 1, F.lit(0)))


# No piece length is left out: the first two bound none, and stay for those who read them. The last is the share of pieces that must follow an equal one.
PIECES_TRIED, MOST_TRIED, REPEATED_SHARE = {}, float("inf"), 0.4
#: Piece lengths of a text that are looked at one by one before all of them are measured at once.
LOOKED_AT = 8


def _common(text: str) -> np.ndarray:
    """For each place how many characters from there on are as from the text's start on (the Z function), in linear time."""
    n, out, left, right = len(text), array("q", bytes(8 * len(text))), 0, 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and text[k] == text[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return np.frombuffer(out, np.int64)


def _repeats_at(size: int, units: np.ndarray) -> bool:
    """Whether pieces of one length have a run of equal neighbours that is long enough."""
    whole = units[: len(units) // size * size].reshape(-1, size)
    same = np.concatenate(([False], (whole[1:] == whole[:-1]).all(1), [False]))
    return bool(np.diff(np.flatnonzero(~same)).max() - 1 > REPEATED_SHARE * -(-len(units) // size))


def _repeats_at_any(text: str) -> bool:
    """Whether pieces of any length have one.

    Such a run is a stretch, longer than 40 % of the text, that is as the text one piece on. So it holds one of a few fixed
    places, and what is common behind and before that place gives the stretch's ends for all lengths at once.
    """
    n = len(text)
    for at in range(0, n, max(1, int(REPEATED_SHARE * n))):
        sizes = np.arange(1, min(n // 2, n - at - 1) + 1)
        behind = _common(text[at:])[sizes]
        before = np.minimum(_common(text[:at][::-1] + text[::-1])[n - sizes], at) if at else 0
        if ((at + behind) // sizes + (before - at) // sizes > REPEATED_SHARE * -(-n // sizes)).any():
            return True
    return False


def repeats_itself(s: Column) -> Column:
    """Whether for any length the text, cut into pieces of it, has a run of equal neighbours over 40 % of the pieces long; null and empty texts don't.

    A run that is long enough holds a whole fifth of the text, which is there again one piece on: lengths at which none is needn't be looked at.
    """

    def repeats(text: str) -> bool:
        n, units, looked = len(text), None, set()
        fifth = max(1, int(REPEATED_SHARE * n / 2))
        for start in range(0, n - fifth, fifth):
            part, at = text[start : start + fifth], start
            while (at := text.find(part, at + 1, start + n // 2 + fifth)) != -1:
                if (size := at - start) not in looked:
                    if len(looked) == LOOKED_AT:
                        return _repeats_at_any(text)
                    units = np.frombuffer(text.encode("utf-32-le"), np.uint32) if units is None else units
                    if _repeats_at(size, units):
                        return True
                    looked.add(size)
        return False

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([bool(t) and repeats(t) for t in texts.to_pylist()], pa.bool_())

    return F.arrow_udf(run, "boolean")(s)
