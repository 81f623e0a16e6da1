"""E-mail addresses: syntax, decoding, classes and local-part patterns, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import key_of, let

LOCAL = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
PLAIN = rf"{LOCAL}(?:\.{LOCAL})*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}}"
SPELLED = r"(?i)\b([a-z0-9_%+-]+(?:\s*[\[({]?\s*(?:dot|d0t)\s*[\])}]?\s*[a-z0-9_%+-]+|\.[a-z0-9_%+-]+)*)\s*[\[({]?\s*\bat\b\s*[\])}]?\s*([a-z0-9-]+(?:\s*[\[({]?\s*(?:\bdot\b|\bd0t\b)\s*[\])}]?\s*[a-z0-9-]+|\.[a-z0-9-]+)+)"
# Named entities of addresses, free providers, and the patterns of local parts.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&commat;": "@", "&period;": ".", "&amp;": "&"}
PERSONAL = (
    "gmail.com googlemail.com yahoo.com ymail.com rocketmail.com hotmail.com outlook.com live.com msn.com aol.com aim.com icloud.com me.com mac.com "
    "protonmail.com proton.me pm.me gmx.com gmx.net mail.com zoho.com yandex.com fastmail.com comcast.net verizon.net att.net sbcglobal.net "
    "bellsouth.net cox.net charter.net earthlink.net juno.com roadrunner.com optonline.net windstream.net frontier.com me.co inbox.com"
).split()
PATTERNS = [
    "{first}.{last}",
    "{first}_{last}",
    "{first}-{last}",
    "{first}{last}",
    "{f}{last}",
    "{f}.{last}",
    "{first}{l}",
    "{first}.{l}",
    "{last}{f}",
    "{last}.{first}",
    "{last}{first}",
    "{f}{m}{last}",
    "{first}.{m}.{last}",
    "{first}",
    "{last}",
]
SHARED = ["info", "office", "contact", "help", "support", "hr", "frontoffice", "records", "webmaster"]


def domain(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", -1))


def local_part(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", 1))


def is_valid(address: Column) -> Column:
    """At most 254 characters, one @, a local part of up to 64 without dots at its ends or in a row, and a domain of
    labels that neither begin nor end with a hyphen, the last of two letters or more. Null is not valid."""
    shape = address.rlike(rf"^{LOCAL}(?:\.{LOCAL})*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}}$")
    return F.coalesce((F.length(address) <= 254) & (F.length(F.substring_index(address, "@", 1)) <= 64) & shape, F.lit(False))


def without_entities(c: Column) -> Column:
    """Numeric entities, hexadecimal and decimal, and the named ones of addresses, decoded."""

    def one(text: Column, entity: Column) -> Column:
        hexa = F.regexp_extract(entity, "^&#[xX]([0-9a-fA-F]+);$", 1)
        code = let(hexa, lambda h: F.when(h != "", F.conv(h, 16, 10)).otherwise(F.regexp_extract(entity, "([0-9]+)", 1)).cast("int"))
        # By its four bytes, since char() knows only one.
        letter = lambda k: F.decode(F.unhex(F.lpad(F.hex(k), 8, "0")), "utf-32")
        return F.replace(text, entity, let(code, lambda k: F.when(k <= 0x10FFFF, letter(k)).otherwise("")))

    def decoded(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(0)))
        text = F.aggregate(found, text, one)
        for entity, plain in ENTITIES.items():
            text = F.regexp_replace(text, "(?i)" + entity, plain)
        return text

    return let(c, lambda text: F.when(F.contains(text, F.lit("&")), decoded(text)).otherwise(text))


def cloudflare(encoded: Column) -> Column:
    """An address hidden as hexadecimal bytes, each but the first exclusive-or the first; null if it is none."""

    def shown(hexa: Column) -> Column:
        key = F.conv(F.substring(hexa, 1, 2), 16, 10).cast("int")
        at = F.sequence(F.lit(3), F.greatest(F.length(hexa), F.lit(3)), F.lit(2))
        byte = lambda own: lambda k: F.char(F.conv(F.substring(hexa, k, 2), 16, 10).cast("int").bitwiseXOR(own))
        out = F.lower(F.array_join(let(key, lambda own: F.transform(at, byte(own))), ""))
        return F.when(hexa.rlike("^(?:[0-9a-f]{2}){2,}$"), let(out, lambda own: F.when(own.rlike(PLAIN), own)))

    return let(F.lower(F.trim(encoded)), shown)


def _plain(decoded: Column) -> Column:
    found = F.transform(F.regexp_extract_all(decoded, F.lit(PLAIN), F.lit(0)), lambda a: F.lower(a))
    return F.filter(F.array_distinct(found), is_valid)


def _spelled(decoded: Column) -> Column:
    dots = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)\s*[\[({]?\s*\b(?:dot|d0t)\b\s*[\])}]?\s*", "."), r"\s+", "")
    found = F.regexp_extract_all(decoded, F.lit(SPELLED), F.lit(0))
    made = F.transform(found, lambda m: F.lower(F.concat(dots(F.regexp_extract(m, SPELLED, 1)), F.lit("@"), dots(F.regexp_extract(m, SPELLED, 2)))))
    return F.filter(F.array_distinct(made), is_valid)


def plain_addresses(c: Column) -> Column:
    """Distinct valid addresses of a text, entities decoded, lower case, in order."""
    return _plain(without_entities(c))


def spelled_addresses(c: Column) -> Column:
    """Distinct valid addresses written with words: jane dot smith at example dot org, jane [at] example.org."""
    return _spelled(without_entities(c))


def addresses(c: Column) -> Column:
    """array<struct<address, form>>: plain ones first, then those only spelled out."""
    as_ = lambda form: lambda a: F.struct(a.alias("address"), F.lit(form).alias("form"))
    both = lambda plain, spelled: F.concat(F.transform(plain, as_("plain")), F.transform(F.array_except(spelled, plain), as_("spelled")))
    return let(without_entities(c), lambda text: let(_plain(text), lambda plain: both(plain, _spelled(text))))


def of_mailto(href: Column) -> Column:
    """The address of a mailto link, percent signs and entities decoded, lower case; null if it is none."""
    own = F.regexp_extract(F.trim(href), r"(?i)^mailto:([^?]*)", 1)
    # A plus sign is itself in such a link.
    plain = let(own, lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))
    return let(F.lower(F.trim(without_entities(plain))), lambda out: F.when(is_valid(out), out))


def is_personal(address_domain: Column) -> Column:
    return F.lower(F.trim(address_domain)).isin(PERSONAL)


def tokens(first: Column, middle: Column, last: Column) -> Column:
    """struct<first, middle, last, f, m, l>: keys of a name's parts without hyphens, and their first letters."""
    own = {k: F.replace(key_of(F.coalesce(c, F.lit(""))), F.lit("-"), F.lit("")) for k, c in (("first", first), ("middle", middle), ("last", last))}
    return F.struct(*[c.alias(k) for k, c in own.items()], *[F.substring(c, 1, 1).alias(k[0]) for k, c in own.items()])


def rendered(pattern: str, t: Column) -> Column:
    """The local part that a pattern gives for tokens; null if it needs one that is empty."""
    names = {"first", "middle", "last", "f", "m", "l"}
    out = [F.lit(x) if x not in names else F.nullif(t[x], F.lit("")) for x in pattern.replace("{", "\0").replace("}", "\0").split("\0") if x]
    return F.concat(*out)


def matching_patterns(local: Column, t: Column) -> Column:
    """The patterns whose rendering is this local part."""
    return F.array_compact(F.array(*[F.when(rendered(p, t) == local, p) for p in PATTERNS]))


def names_person(local: Column, t: Column) -> Column:
    """Whether a local part holds a person's first or last name of three letters or more."""
    own = F.regexp_replace(F.lower(local), "[^a-z]", "")
    held = lambda part: (F.length(part) >= 3) & F.contains(own, part)
    return F.coalesce((F.length(own) >= 3) & (held(t["last"]) | held(t["first"])), F.lit(False))


def kind(address: Column, plainly_shown: Column, inferred: Column, names: Column, shared: list[str] = SHARED) -> Column:  # noqa: B006
    """invalid, general_inbox, inferred_candidate, published or decoded_published, in that order."""
    own = F.lower(F.trim(address))
    local = F.substring_index(own, "@", 1)
    compact = F.regexp_replace(local, "[._-]", "")
    begins = F.lit(False)
    for p in shared:
        begins = begins | (compact.startswith(p) & (F.length(compact) <= len(p) + 12) & ~compact.rlike("[0-9]{3,}"))
    general = (local.isin(shared) | compact.isin(shared) | begins) & ~names
    return F.when(~is_valid(own), "invalid").when(general, "general_inbox").when(inferred, "inferred_candidate").when(plainly_shown, "published").otherwise("decoded_published")


def inference_confidence(consistency: Column, support: Column) -> Column:
    """At most 0.95: consistency, with a bonus that is full from 20 examples on, in hundredths."""
    raw = consistency * (0.75 + 0.25 * F.least(F.lit(1.0), support / 20.0))
    return F.least(F.lit(0.95), F.floor(raw * 100 + 0.5) / 100)
