"""Text functions as Column builders: all stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Each Latin letter of the Latin blocks that decomposes to one ASCII letter and marks, and that letter; plus the barred d."""
    pairs = {"đ": "d", "Đ": "D"}
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for c in map(chr, block):
            base = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
            if len(base) == 1 and base[0].isascii() and base[0].isalpha():
                pairs[c] = base[0]
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_table()
#: Letters that fold to two.
FOLD_TWO = (("ß", "ss"), ("œ", "oe"), ("æ", "ae"))


def fold(text: Column) -> Column:
    """Without diacritics, case kept; decomposed marks are dropped too."""
    for old, new in FOLD_TWO:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.translate(F.regexp_replace(text, r"[̀-ͯ]", ""), FOLD_FROM, FOLD_TO)


def unglue(text: Column) -> Column:
    """A digit glued to three letters is a footnote marker: it gets a space. Null gives an empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(\p{L}{3})(\p{Nd})", "$1 $2")


def syllables(text: Column) -> Column:
    return F.filter(F.split(fold(F.lower(unglue(text))), "[^0-9a-z]+"), lambda x: x != "")


_FOLD_MAP = {ord(a): b for a, b in zip(FOLD_FROM, FOLD_TO)} | {ord(a): b for a, b in FOLD_TWO} | dict.fromkeys(range(0x300, 0x370))


def syllables_of(text: str) -> list[str]:
    """`syllables` of one text, for model hooks that run in Python."""
    glued = re.sub(r"([^\W\d_]{3})(\d)", r"\1 \2", text or "")
    return [w for w in re.split("[^0-9a-z]+", glued.lower().translate(_FOLD_MAP)) if w]


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def terms(words: Column) -> Column:
    return F.concat(words, bigrams(words))


def is_unaccented(text: Column) -> Column:
    """Two words or more and nothing to fold."""
    return (F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")) >= 2) & (fold(text) == text)


def slug(text: Column, cap: int = 250) -> Column:
    """A path label: folded, lower case, other characters to single underscores."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(fold(text)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, cap)


#: Vietnamese letters that an enumeration label keeps apart from their base letters.
INDEX_LETTERS = (("đ", "dd"), ("ă", "aw"), ("â", "aa"), ("ê", "ee"), ("ô", "oo"), ("ơ", "ow"), ("ư", "uw"))


def index_label(text: Column) -> Column:
    text = F.lower(text)
    for old, new in INDEX_LETTERS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return slug(text)


def labels(path: Column) -> Column:
    return F.split(path, r"\.")


def parent_path(path: Column) -> Column:
    """All but the last label; empty for a single label."""
    return F.regexp_replace(path, r"\.?[^.]*$", "")


def prefixes(path: Column) -> Column:
    """The path itself and each of its ancestors: an equi-join on these replaces a range join."""
    parts = labels(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def under(path: Column, prefix) -> Column:
    """At the prefix or below it, by whole labels."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit(".")))


#: How POSIX classes and word marks read in Java patterns.
POSIX = {"[:alpha:]": r"\p{L}", "[:digit:]": r"\p{Nd}", "[:alnum:]": r"\p{L}\p{Nd}", "[:space:]": r"\s", "[:upper:]": r"\p{Lu}", "[:lower:]": r"\p{Ll}", "[:punct:]": r"\p{Punct}"}


def java_pattern(pattern: str) -> str:
    for old, new in POSIX.items():
        pattern = pattern.replace(old, new)
    if re.search(r"\[:\w+:\]|\[\.|\[=", pattern):
        raise ValueError(f"unsupported bracket expression: {pattern}")
    return "(?iU)" + re.sub(r"(?<!\\)\\([yYmM])", lambda m: {"y": r"\b", "Y": r"\B", "m": r"\b(?=\w)", "M": r"\b(?<=\w)"}[m[1]], pattern)


def matches(content: Column, pattern: str, is_regex: bool) -> Column:
    """Case-insensitive regular expression or substring; null content gives null."""
    if not pattern:
        raise ValueError("pattern must not be empty")
    return F.rlike(content, F.lit(java_pattern(pattern))) if is_regex else F.contains(F.lower(content), F.lower(F.lit(pattern)))


def flexible_date(text: Column, strict: bool = False) -> Column:
    """ISO, day/month/year with / or -, year/month/day, or 'ngày D tháng M năm Y'. Null and blank give null.

    Where none fits: null, so that one bad row stops no job; `strict` raises instead.
    """
    text = F.trim(text)
    words = r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    dmy, ymd = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$"
    make = lambda pattern, y, m, d: F.try_to_date(F.when(F.rlike(text, F.lit(pattern)), F.concat_ws("-", part(pattern, y), F.lpad(part(pattern, m), 2, "0"), F.lpad(part(pattern, d), 2, "0"))), "yyyy-MM-dd")
    found = F.coalesce(make(words, 3, 2, 1), make(dmy, 3, 2, 1), make(ymd, 1, 2, 3))
    return F.coalesce(found, F.when(text != "", F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date"))) if strict else found


def in_force(effective: Column, expiration: Column, on) -> Column:
    """The end is exclusive; a null end is open."""
    on = F.lit(on) if not isinstance(on, Column) else on
    return (effective <= on) & (expiration.isNull() | (expiration > on))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


RAW_MAX_LINES = 100


def raw_slice(text: Column, start: int, end: int | None = None, most: int = RAW_MAX_LINES, strict: bool = False) -> Column:
    """Lines start to end, from 1, both included; without an end, `most` of them. Cut at the text's end.

    A start behind the text's end gives an empty text; `strict` raises instead.
    """
    end = start + most - 1 if end is None else end
    if start < 1 or end < start or end - start + 1 > most:
        raise ValueError(f"lines {start} to {end}: from 1, in order, {most} at most")
    lines = F.split(text, "\n")
    out = F.array_join(F.slice(lines, start, end - start + 1), "\n")
    return F.when(F.size(lines) < start, F.raise_error(F.lit(f"the text ends before line {start}")).cast("string")).otherwise(out) if strict else out


def path_problem(path: Column) -> Column:
    """Why a path is refused; null: it is one. Labels of [a-z0-9_], 255 characters at most, joined by single dots."""
    return F.when(path.isNull() | (path == ""), "empty path").when(~F.rlike(path, F.lit(r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*$")), "bad label").when(F.exists(labels(path), lambda x: F.length(x) > 255), "label too long")


def normalized_span(text: Column, sought: Column) -> Column:
    """struct(start, end) from 0, end excluded, of the first place where `sought` stands in `text` with any white space between its words.

    Null where it does not stand, or has no words.
    """
    quote = lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    words = F.filter(F.split(sought, r"\s+"), lambda x: x != "")
    pattern = F.array_join(F.transform(words, quote), "\\s+")
    at = F.when(F.size(words) > 0, F.regexp_instr(text, pattern))
    return F.when(at > 0, F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(F.regexp_substr(text, pattern))).cast("int").alias("end")))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def fill_ratio(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: F.trim(c) != "")) / F.size(cells)
