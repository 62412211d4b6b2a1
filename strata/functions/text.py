"""Text expressions: native, and equal in Spark, Python and SQL engines on every code point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that Python's str.strip() and \s know as white space.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same as a string of them.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Where str.splitlines() breaks lines.
LINE_BREAK = r"\r\n|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]+"


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACES))


def clean(s: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), f"{SPACE}+", " "))


def norm(s: Column) -> Column:
    """Lower-case ASCII words with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", " "))


def signature(s: Column, length: int = 60) -> Column:
    return F.substring(norm(s), 1, length)


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(WORD), F.lit(0))


def content_hash(s: Column) -> Column:
    """SHA-256 of the lower-case words joined by spaces."""
    return F.sha2(F.array_join(tokens(s), " "), 256)


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct k-word shingles; fewer words are one shingle, none the empty one."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " ")))


def lines(s: Column) -> Column:
    """As str.splitlines() gives them: no empty line after a closing break."""
    unified = F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), LINE_BREAK, "\n"), r"\n\z", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(unified, "\n", -1))


def headings(md: Column) -> Column:
    """Normalised texts of the Markdown headings."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(md, F.lit("")), F.lit(rf"(?m)^#{{1,6}}{SPACE}+(.*)$"), F.lit(1)), norm))


def blocks(md: Column) -> Column:
    """Text between blank lines, stripped."""
    return F.transform(F.split(F.coalesce(md, F.lit("")), rf"\n{SPACE}*\n", -1), strip)


def _short(s: Column) -> Column:
    return F.length(s).between(2, 40)


def _words(s: Column) -> Column:
    return F.size(F.split(clean(s), " "))


def is_stat_value(s: Column) -> Column:
    """A short value with a unit, as '449 Hp (335 kW)'."""
    t = strip(F.coalesce(s, F.lit("")))
    return _short(t) & t.rlike(rf"^[~<>≈]?{SPACE}*\p{{Nd}}") & t.rlike("[A-Za-z°%·/]") & ~t.rlike(r"[.!?]\z") & (_words(t) <= 5)


def is_stat_label(s: Column) -> Column:
    """A short description of a value, as 'Maximum Torque'."""
    t = strip(F.coalesce(s, F.lit("")))
    return _short(t) & ~t.rlike(r"\p{Nd}") & ~t.rlike(r"^[#\-*|!\[>]") & ~t.rlike(r"[.!?:]\z") & _words(t).between(1, 5)


def top_lines(md: Column, k: int = 3) -> Column:
    """The first k lines that are not blank, stripped."""
    breaks = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
    cut = F.split(F.translate(F.coalesce(md, F.lit("")), breaks, "\n" * len(breaks)), "\n", -1)  # an empty line more where two characters make a break
    return F.transform(F.slice(F.filter(cut, lambda x: strip(x) != ""), 1, k), strip)


def strip_lines(md: Column, drop: Column) -> Column:
    """Without the lines in `drop`, and without the gaps they leave; unchanged if there are none to drop."""
    kept = F.array_join(F.filter(lines(md), lambda x: ~F.array_contains(drop, strip(x))), "\n")
    packed = F.concat(strip(F.regexp_replace(kept, r"\n{3,}", "\n\n")), F.lit("\n"))
    return F.when(F.coalesce(F.size(drop), F.lit(0)) <= 0, md).otherwise(packed)


def after_front_matter(text: Column) -> Column:
    parts = F.split(text, "---", 3)
    return F.when(text.startswith("---") & (F.size(parts) == 3), F.get(parts, 2)).otherwise(text)


def image_title(alt: Column, caption: Column, surrounding: Column) -> Column:
    """Alternative text, caption, or the beginning of the text around."""
    a, c, s = (strip(F.coalesce(x, F.lit(""))) for x in (alt, caption, surrounding))
    cut = F.substring(s, 1, 80)
    cut = F.when(F.length(s) > 80, F.concat(F.regexp_replace(cut, " [^ ]*$", ""), F.lit("…"))).otherwise(cut)
    return F.when(a != "", a).when(c != "", c).when(s != "", cut).otherwise(F.lit("image"))


def aspect(width: Column, height: Column) -> Column:
    return F.greatest(width, height) / F.greatest(F.lit(1), F.least(width, height))
