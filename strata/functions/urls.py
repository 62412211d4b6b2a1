"""URL expressions: all native, so that filters on them stay in the scan's stage."""

from __future__ import annotations

import fnmatch
import unicodedata
from collections.abc import Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .suffixes import SuffixRules, default_rules

PARTS = r"^([^:/?#]+)://([^/?#]*)([^?#]*)"
#: Letters of Latin scripts by the ASCII letter they are a variant of: those below U+0250 that Unicode decomposes so, and some it does not.
ASCII_OF = {c: b for c in map(chr, range(0xC0, 0x250)) if len(b := "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii())) == 1 and b.isalpha()} | {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i"}
WRITTEN_OUT = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
#: Letters of other scripts and how they are written in Latin ones. Fixed values, in the order of the alphabets.
CYRILLIC = "а a б b в v г g ґ g д d ђ dj е e є ie ж zh з z и i і i ј j к k л l љ lj м m н n њ nj о o п p р r с s т t ћ c у u ф f х kh ц ts ч ch џ dz ш sh щ shch ы y э e ю iu я ia"
GREEK = "α a β b γ g δ d ε e ζ z η e θ th ι i κ k λ l μ m ν n ξ x ο o π p ρ r σ s ς s τ t υ u φ ph χ kh ψ ps ω o"
#: Signs of these scripts that stand for no sound of their own.
SILENT = "ъь"


def _in_latin() -> dict[str, str]:
    """What each lower-case letter of the two scripts becomes; letters with marks as those without."""
    listed = f"{CYRILLIC} {GREEK}".split()
    known = dict(zip(listed[::2], listed[1::2], strict=True))
    marked = {c: known[b] for c in map(chr, range(0x370, 0x530)) if c not in known and (b := unicodedata.normalize("NFKD", c)[0]) in known}
    return known | marked


IN_LATIN = _in_latin()


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 1)


def netloc(url: Column) -> Column:
    """Host and port as written."""
    return F.regexp_extract(url, PARTS, 2)


def path(url: Column) -> Column:
    return F.when(url.rlike("^[^:/?#]+://"), F.regexp_extract(url, PARTS, 3)).otherwise(F.regexp_extract(url, "^([^?#]*)", 1))


def normalize(url: Column) -> Column:
    """Without query and fragment, and without slashes at the end of the path but for a bare one."""
    bare = F.regexp_replace(path(url), "/+$", "")
    bare = F.when(bare == "", F.lit("/")).otherwise(bare)
    return F.when(url.rlike("^[^:/?#]+://"), F.concat(F.lower(scheme(url)), F.lit("://"), netloc(url), bare)).otherwise(bare)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(netloc(url), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def registered_domain(url: Column, rules: SuffixRules | None = None) -> Column:
    """The public suffix of the host and one label more; addresses are whole."""
    return (rules or default_rules()).registered(host(url))


def matches(url: Column, patterns: Sequence[str]) -> Column:
    """True if the URL or its path matches any shell pattern; * crosses slashes."""
    out = F.lit(False)
    for p in patterns:
        regex = "^" + fnmatch.translate(p).replace(r"\Z", r"\z")
        out = out | url.rlike(regex) | path(url).rlike(regex)
    return out


def in_scope(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Exclusion wins; with inclusions one of them must match."""
    return ~matches(url, exclude) & (matches(url, include) if include else F.lit(True))


def robots_url(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.lit("/robots.txt"))


def resolve(base: Column, href: Column) -> Column:
    """A link against its page, without its fragment: absolute, //host, /path, ?query and relative links, dot segments worked out."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    whole = (
        F.when(href == "", base)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
        .otherwise(F.concat(root, folder, href))
    )
    whole = F.regexp_extract(whole, "^([^#]*)", 1)
    return F.when(whole.rlike(rf"^https?://[^?]*/{DOTS}(/|\?|$)") & ~href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), without_dots(whole)).otherwise(whole)


DOTS = r"\.\.?"


def without_dots(url: Column) -> Column:
    """The dot segments of a URL's path worked out; those that lead above the root are dropped."""
    parts = F.split(path(url), "/")
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(s)))
    whole = F.aggregate(parts, F.array().cast("array<string>"), step)
    ends_open = F.element_at(parts, -1).isin(".", "..")
    joined = F.concat(F.array_join(whole, "/"), F.when(ends_open, F.lit("/")).otherwise(F.lit("")))
    joined = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.concat(scheme(url), F.lit("://"), netloc(url), joined, F.regexp_extract(url, r"(\?[^#]*)$", 1))


@F.pandas_udf(T.StringType())
def join_urls(base: pd.Series, href: pd.Series) -> pd.Series:
    """The standard library's resolution, without the fragment; resolve() does the same in expressions."""

    def one(b: str | None, h: str | None) -> str | None:
        try:
            return None if b is None or h is None else urljoin(b, h).split("#")[0]
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def is_web(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def site_dir(url: Column) -> Column:
    return F.replace(netloc(url), F.lit(":"), F.lit("_"))


def slug(url: Column, title: Column) -> Column:
    """The path, or the title, as lower-case ASCII words joined by hyphens, 80 characters at most; Latin letters lose their accents, Cyrillic and Greek ones are written in Latin."""
    base = F.regexp_replace(path(url), "^/+|/+$", "")
    base = F.when(base != "", base).when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.lit("index"))
    single = ASCII_OF | {c: x for c, x in IN_LATIN.items() if len(x) == 1}
    plain = F.translate(F.lower(base), "".join(single) + SILENT, "".join(single.values()))  # silent signs go
    for letter, written in (WRITTEN_OUT | {c: x for c, x in IN_LATIN.items() if len(x) > 1}).items():
        plain = F.replace(plain, F.lit(letter), F.lit(written))
    out = F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
    return F.when(out == "", F.lit("index")).otherwise(out)
