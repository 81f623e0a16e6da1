"""Normalising functions for published text, as built-in column expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of units by key, words that end a unit's name, and entities of scraped text.
UNIT_ALIASES = {
    "hr": "Human Resources",
    "human-resource": "Human Resources",
    "human-resources": "Human Resources",
    "it": "Information Technology",
    "information-technology": "Information Technology",
    "technology-services": "Information Technology",
    "is": "Information Technology",
    "business-office": "Finance",
    "finance": "Finance",
    "business-services": "Finance",
    "fiscal-services": "Finance",
    "front-office": "Front Office",
    "main-office": "Front Office",
    "pw": "Public Works",
    "public-works": "Public Works",
    "dpw": "Public Works",
    "parks-and-rec": "Parks and Recreation",
    "parks-rec": "Parks and Recreation",
    "pd": "Police",
    "fd": "Fire",
    "ems": "Emergency Medical Services",
    "oig": "Office of Inspector General",
}
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse_whitespace(c: Column) -> Column:
    """Zero-width characters dropped, other blanks and line ends made spaces, runs of them one, ends trimmed."""
    c = F.regexp_replace(c, r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    c = F.regexp_replace(c, r"[\x{00A0}\x{2007}\x{202F}\x{2009}\x{2002}\x{2003}\t\r\n]", " ")
    return F.trim(F.regexp_replace(c, " {2,}", " "))


@functools.cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Letters of the Latin blocks, full-width forms and ligatures, with what compatibility decomposition leaves of them
    without marks: single ones as two strings for translate(), longer ones by letter."""
    one, to, more = [], [], {}
    for k in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x2150), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(k)) if not 0x300 <= ord(x) <= 0x36F)
        if plain == chr(k) or not plain:
            continue
        if len(plain) == 1:
            one.append(chr(k))
            to.append(plain)
        else:
            more[chr(k)] = plain
    return "".join(one), "".join(to), more


def without_marks(c: Column) -> Column:
    """Compatibility letters made plain and marks U+0300 to U+036F dropped, for Latin text: NFKD without marks."""
    one, to, more = _folds()
    names = F.create_map(*[F.lit(v) for kv in more.items() for v in kv])

    def longer(c: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"[{''.join(more)}]"), F.lit(0)))  # few texts hold any
        return F.aggregate(found, c, lambda text, x: F.replace(text, x, F.element_at(names, x)))

    plain = let(F.translate(c, one, to), lambda c: F.when(F.translate(c, "".join(more), "") == c, c).otherwise(longer(c)))
    return F.regexp_replace(plain, r"[\x{0300}-\x{036F}]", "")


def key_of(c: Column) -> Column:
    """The key for exact matching: without accents, lower case, runs of anything but letters and digits one hyphen."""
    return F.trim(F.regexp_replace(F.lower(without_marks(collapse_whitespace(c))), "[^a-z0-9]+", "-"), F.lit("-"))


def plain_key(c: Column) -> Column:
    """Like key_of, but accented letters are no letters: they become hyphens, as other signs do."""
    return F.trim(F.regexp_replace(F.lower(collapse_whitespace(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def title_case(c: Column) -> Column:
    """Lower case, but ASCII letters upper case where no ASCII letter, digit or underscore stands before them."""
    low = F.split(F.lower(collapse_whitespace(c)), "")
    before = F.concat(F.array(F.lit(" ")), low)
    starts = lambda x, k: x.rlike("^[a-z]$") & ~F.get(before, k).rlike("^[A-Za-z0-9_]$")
    return F.array_join(F.transform(low, lambda x, k: F.when(starts(x, k), F.upper(x)).otherwise(x)), "")


def is_shouting(c: Column) -> Column:
    """Three ASCII letters or more, all capital."""
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return (F.length(letters) >= 3) & (letters == F.upper(letters))


def calm(c: Column) -> Column:
    """Title case for what shouts; all else only with white space collapsed."""
    return let(collapse_whitespace(c), lambda own: F.when(is_shouting(own), title_case(own)).otherwise(own))


def joined_acronyms(c: Column) -> Column:
    """Dots go from letters that each have one, two of them or more: U.S.D.A. and I.S.D. become words."""
    # A mark takes the place of every dot that another letter and dot follow; the last dot stands behind the last mark.
    c = F.regexp_replace(c, r"(?<![A-Za-z0-9_])([A-Za-z])\.(?=[A-Za-z]\.)", "$1\x01")
    return F.regexp_replace(F.regexp_replace(c, r"(?<=\x01)([A-Za-z])\.", "$1"), "\x01", "")


def county_name(c: Column) -> Column:
    """'County of Harris', 'Harris Co.' and 'HARRIS' as 'Harris'."""
    c = F.regexp_replace(collapse_whitespace(c), r"(?i)^county\s+of\s+", "")
    c = F.regexp_replace(c, r"(?i)\s+(?:county|co\.?|parish|borough)\s*$", "")
    return calm(F.regexp_replace(c, "[.,]+$", ""))


def organization_key(c: Column, suffixes: list[str] = []) -> Column:  # noqa: B006
    """A comparable name: acronyms without dots, the given words dropped, longer ones first, then as a key."""
    c = joined_acronyms(collapse_whitespace(c))
    for s in sorted(suffixes, key=lambda s: -len(s)):
        c = F.regexp_replace(c, rf"(?i)(?<![A-Za-z0-9_])\Q{s}\E(?![A-Za-z0-9_])", " ")
    return key_of(c)


def unit_name(c: Column, more: dict[str, str] = {}) -> Column:  # noqa: B006
    """An abbreviation's full name; else the name without 'Department' and the like at its end."""
    names = F.create_map(*[F.lit(v) for kv in (UNIT_ALIASES | more).items() for v in kv])
    rest = F.regexp_replace(collapse_whitespace(c), r"(?i)\s*(?:department|dept\.?|office|division|bureau)\s*$", "")
    return F.coalesce(F.element_at(names, key_of(c)), calm(rest))


def phone(c: Column) -> Column:
    """Ten digits, or eleven with a leading 1, as 123-456-7890, and ' ext 5' if there is an extension; else null."""
    ending = r"(?i)(?:ext(?:ension)?\.?|x|#)\s*(\d+)\s*$"
    extra = F.regexp_extract(c, ending, 1)
    d = F.regexp_replace(F.regexp_replace(c, ending, ""), "[^0-9]", "")
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    whole = F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4))
    return F.when(F.length(d) == 10, F.concat(whole, F.when(extra != "", F.concat(F.lit(" ext "), extra)).otherwise("")))


def snippet(c: Column, size: int = 300) -> Column:
    """At most size characters, the last an ellipsis if some were cut."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size - 1), F.lit("…"))).otherwise(c)


def text_content(html: Column) -> Column:
    """Markup dropped, the common entities decoded, white space collapsed."""
    c = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, plain in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def share(c: Column) -> Column:
    """Kept between 0 and 1; what is no number is 0."""
    return F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def grade(c: Column) -> Column:
    """A school grade: PK, KG, or two digits from 01 to 12; else null."""
    t = F.upper(F.trim(c))
    n = F.regexp_extract(t, r"^(?:GRADE\s*)?0*(\d{1,2})(?:ST|ND|RD|TH)?$", 1)
    known = F.when(t.isin("PK", "PRE-K", "PREK", "EE"), "PK").when(t.isin("K", "KG", "KINDERGARTEN"), "KG")
    return known.when((n != "") & n.cast("int").between(1, 12), F.lpad(n, 2, "0"))


# Cells of official files.
def cell(c: Column) -> Column:
    """Trimmed, without a leading apostrophe that spreadsheets add; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(c), "^'", "")), F.lit(""))


def number(c: Column) -> Column:
    return F.regexp_replace(cell(c), ",", "").try_cast("double")


def iso_date(c: Column) -> Column:
    """2024-03-09 from that, or from 3/9/2024; else null."""
    own = cell(c)
    return F.date_format(F.coalesce(F.try_to_date(own, "yyyy-MM-dd"), F.try_to_date(own, "M/d/yyyy")), "yyyy-MM-dd")


def zip_code(five: Column, four: Column) -> Column:
    """12345, or 12345-6789 where both parts are known."""
    a, b = cell(five), cell(four)
    return F.when(a.isNotNull(), F.concat_ws("-", F.lpad(a, 5, "0"), F.lpad(b, 4, "0")))


def address(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *map(cell, parts)), F.lit(""))


# Hashes.
def short_hash(c: Column, size: int = 32) -> Column:
    return F.substring(F.sha2(c, 256), 1, size)


def record_key(*parts: Column) -> Column:
    """24 digits of a hash over the parts; null and empty parts count as empty, and which is which matters."""
    return short_hash(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 24)


def stable_json(**fields: Column) -> Column:
    """One JSON text with its keys in order, nulls included."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_hash(html: Column) -> Column:
    """A hash that renders of one page share: comments, form tokens, long hex, times and blanks do not count."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r'(?i)name="(csrf|_token|authenticity_token)"\s+value="[^"]*"', 'name="$1" value=""')
    c = F.regexp_replace(c, r"(?i)\b[0-9a-f]{32,64}\b", "")
    c = F.regexp_replace(c, r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?\b", "")
    return F.sha2(F.trim(F.regexp_replace(c, r"\s+", " ")), 256)


