"""What a page of HTML holds: its text, and the people that it lists. Small helpers of the extraction operator.

A page is a flat table of elements in the order of their beginnings, each with its parent and the place after its last
descendant; nothing recurses, so markup of any depth is read in one pass.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

# Elements that break lines, that hold no text, that have no end, and headings of columns by field.
BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p section table td th tr ul".split())
SILENT = {"script", "style", "noscript", "template"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = {
    "name": r"^(full )?name$|^(staff|employee|person|official)( name)?$",
    "title": r"title|position|role|^job",
    "department": r"department|division|office|unit",
    "email": r"e-?mail",
    "phone": r"phone|telephone|ext",
}
PHONE = re.compile(r"(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}")
ADDRESS = re.compile(r"[\w!#$%&'*+/=?^`{|}~.-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
OPEN_REFERENCE = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
CONTAINERS = ("@graph", "itemListElement", "item", "member", "members", "employee", "employees")

# Words of headings over directories, words of titles, and what no person is called.
HEADING_TERMS = (
    "staff|employee|employees|personnel|directory|our team|team|leadership|administration|officials|elected officials|contacts|contact us|departments|offices|divisions|who we are"
).split("|")
TITLE_TERMS = frozenset(
    "director deputy assistant associate manager supervisor coordinator specialist analyst technician officer chief administrator clerk secretary aide inspector engineer planner attorney counsel auditor accountant operator driver "
    "custodian mechanic nurse librarian commissioner mayor sheriff marshal captain sergeant lieutenant firefighter paramedic dispatcher president chairman chairwoman treasurer assessor registrar representative liaison ombudsman warden".split()
)
LABEL_WORDS = frozenset(
    "front main general central office offices department dept division bureau agency commission authority board committee council team staff reception desk line info information administration headquarters hq branch unit section district "
    "hall center centre clerk records permits licensing planning zoning police fire dispatch emergency safety security health clinic library parks recreation maintenance facilities technology transportation transit utilities water sewer "
    "sanitation streets elections treasurer assessor attendance registrar nurse".split()
)
NO_NAME = re.compile(r"(?i)^(name|staff|employee|title|position|email|phone|department|back to top|more|view|details)$|click here|read more|learn more|contact us|view profile")
NO_PROFILE = re.compile(r"(?i)^(contact|about|our|meet|welcome|view|read|next|previous)\b")
ASIDE, MAIN, HOLDERS = {"nav", "header", "footer", "aside"}, {"main", "article", "li", "td"}, {"li", "td", "tr", "div", "p", "article", "section"}
IMPLIED = ("li", "tr", "td", "th", "dt", "dd", "p")  # elements that a sibling of their kind ends


class Page(HTMLParser):
    """Elements by number, 0 for the page: tag, attrs, parent, end (the number after the last descendant); text(n)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.end = ["#root"], [{}], [-1], [0]
        #: Whether an element lies in page furniture, in a main part, and the nearest one that holds a record.
        self.aside, self.main, self.holder = [False], [False], [-1]
        self.parts: list[str] = []
        self.begin, self.stop = [0], [0]
        self.now, self.silent = 0, 0
        self.open: dict[str, int] = {}
        self.feed(html)
        self.close()
        while self.now >= 0:
            self._closed()

    def _closed(self) -> None:
        n = self.now
        self.open[self.tag[n]] = self.open.get(self.tag[n], 1) - 1
        self.silent -= self.tag[n] in SILENT
        self.end[n] = len(self.tag)
        if self.tag[n] in BLOCKS:
            self.parts.append("\n")
        self.stop[n] = len(self.parts)
        self.now = self.parent[n]

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED and self.tag[self.now] == tag:
            self._closed()
        n, up = len(self.tag), self.now
        own = {k: v or "" for k, v in attrs}
        self.tag.append(tag)
        self.attrs.append(own)
        self.parent.append(up)
        self.end.append(n + 1)
        self.aside.append(self.aside[up] or tag in ASIDE)
        self.main.append(self.main[up] or tag in MAIN or own.get("role") == "main")
        self.holder.append(n if tag in HOLDERS else self.holder[up])
        if tag in BLOCKS:
            self.parts.append("\n")
        self.begin.append(len(self.parts))
        self.stop.append(len(self.parts))
        if tag not in VOID:
            self.now = n
            self.silent += tag in SILENT
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if tag in VOID or not self.open.get(tag):
            return  # nothing of that kind is open
        while self.tag[self.now] != tag:
            self._closed()
        self._closed()

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
        elif self.tag[self.now] == "script":
            self.attrs[self.now]["#text"] = self.attrs[self.now].get("#text", "") + data

    def all(self, n: int, *tags: str) -> Iterator[int]:
        """Descendants, of these kinds."""
        return (k for k in range(n + 1, self.end[n]) if not tags or self.tag[k] in tags)

    def children(self, n: int) -> Iterator[int]:
        k = n + 1
        while k < self.end[n]:
            yield k
            k = self.end[k]

    def text(self, n: int = 0) -> str:
        """Lines of blocks, white space collapsed."""
        lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in "".join(self.parts[self.begin[n] : self.stop[n]]).split("\n"))
        return "\n".join(x for x in lines if x)

    def line(self, n: int) -> str:
        return " ".join(self.text(n).split())

    def has(self, n: int, word: str) -> bool:
        return word in self.attrs[n].get("class", "").lower()


def only_closed(html: str) -> str:
    """Markup in which every ampersand that begins no reference with a semicolon stands for itself."""
    return OPEN_REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html)


def field_of(heading: str) -> str | None:
    own = re.sub(r"[^a-z -]+", "", heading.lower()).strip()
    return next((f for f, p in HEADINGS.items() if re.search(p, own)), None)


def addresses_in(page: Page, n: int) -> list[str]:
    """Addresses of an element's links and text, lower case, in order, each once; those that attributes hide, too."""
    found = []
    for k in (n, *page.all(n)):
        own = page.attrs[k]
        href = own.get("href", "")
        if href.lower().startswith("mailto:"):
            found.append(href[7:].split("?")[0].replace("%40", "@"))
        hidden = own.get("data-cfemail", "")
        if re.fullmatch("(?:[0-9a-fA-F]{2}){2,}", hidden):
            data = bytes.fromhex(hidden)
            found.append(bytes(b ^ data[0] for b in data[1:]).decode("latin-1"))
        if own.get("data-user") and own.get("data-domain"):
            found.append(f"{own['data-user']}@{own['data-domain']}")
    found += ADDRESS.findall(page.text(n))
    return list(dict.fromkeys(x.strip().lower() for x in found if ADDRESS.fullmatch(x.strip())))


def looks_like_name(value: str) -> bool:
    own = " ".join(value.split())
    return 3 <= len(own) <= 120 and bool(re.search("[A-Za-z]", own)) and not NO_NAME.search(own) and len(own.split()) <= 6 and "@" not in own


def looks_like_title(value: str) -> bool:
    """A heading of a table, or a text with a word of titles."""
    own = " ".join(value.split()).lower()
    return bool(re.fullmatch("name|staff|employee|title|position|email|phone|department|office|organization", own)) or not TITLE_TERMS.isdisjoint(re.split("[^a-z]+", own))


def is_label(value: str) -> bool:
    words = [w for w in re.split("[^a-z]+", value.lower()) if w]
    return bool(words) and LABEL_WORDS.issuperset(words)


def is_profile_name(name: str) -> bool:
    return looks_like_name(name) and not NO_PROFILE.search(name) and len(name.split()) >= 2 and not is_label(name) and not looks_like_title(name)


def title_in(text: str) -> str | None:
    """The first segment of a text that reads as a title."""
    for part in re.split(r"[|•\n]|\s{2,}|,\s", text):
        own = " ".join(part.split())
        if 3 <= len(own) <= 90 and "@" not in own and field_of(own) is None and looks_like_title(own):
            return own
    return None


def phone_in(text: str) -> str | None:
    found = PHONE.search(text)
    digits = re.sub(r"\D", "", found[0])[-10:] if found else ""
    return f"{digits[:3]}-{digits[3:6]}-{digits[6:]}" if digits else None


def name_in(page: Page, n: int) -> str | None:
    """The name of an element that stands for a person: of what is called so, headings, strong words, links, or its line."""
    kinds = [lambda k: page.has(k, "name"), *(lambda k, t=t: page.tag[k] == t for t in ("h1", "h2", "h3", "h4", "h5", "strong", "b")), lambda k: page.tag[k] == "a" and "href" in page.attrs[k]]
    for kind in kinds:
        k = next((k for k in page.all(n) if kind(k)), None)
        if k is not None and looks_like_name(own := page.line(k)) and not looks_like_title(own):
            return own
    own = " ".join(re.split("[|,•\n]", page.text(n))[0].split())
    return own if looks_like_name(own) and not looks_like_title(own) else None


Person = dict


def _person(strategy: str, sure: float, name, title=None, department=None, phone=None, emails=(), profile=None) -> Person | None:
    name = " ".join(str(name or "").split())
    if not looks_like_name(name):
        return None
    clean = lambda x: " ".join(str(x).split()) or None if x else None
    return {"name": name, "title": clean(title), "department": clean(department), "phone": clean(phone), "emails": list(emails), "profile": profile, "strategy": strategy, "confidence": sure}


def json_people(value) -> Iterator[Person]:
    """Persons of a JSON-LD value, at most six containers deep."""
    stack = [(value, 0)]
    while stack:
        own, depth = stack.pop()
        if isinstance(own, list):
            stack += [(x, depth) for x in reversed(own)]
        elif isinstance(own, dict) and depth <= 6:
            kinds = own.get("@type") or ""
            if "Person" in (kinds if isinstance(kinds, list) else [kinds]):
                mails = [own["email"]] if isinstance(own.get("email"), str) else own.get("email") or []
                name = own.get("name") or " ".join(str(own.get(k) or "") for k in ("givenName", "familyName"))
                yield _person("structured", 0.95, name, own.get("jobTitle"), own.get("department"), own.get("telephone"), [str(m).removeprefix("mailto:").lower() for m in mails])
            stack += [(own[key], depth + 1) for key in reversed(CONTAINERS) if key in own]


def structured(page: Page) -> Iterator[Person]:
    for n in page.all(0, "script"):
        if "ld+json" in page.attrs[n].get("type", ""):
            try:
                yield from json_people(json.loads(page.attrs[n].get("#text", "")))
            except (ValueError, RecursionError):
                continue
    for n in page.all(0):
        if page.attrs[n].get("itemtype", "").rstrip("/").endswith("schema.org/Person"):
            own = {}
            for k in page.all(n):
                if "itemprop" in page.attrs[k]:
                    own.setdefault(page.attrs[k]["itemprop"], page.attrs[k].get("content") or page.text(k))
            yield _person("structured", 0.95, own.get("name"), own.get("jobTitle"), own.get("department"), own.get("telephone"), addresses_in(page, n))


def tables(page: Page) -> Iterator[Person]:
    """Rows of tables whose first row names a column of names, and one more."""
    for n in page.all(0, "table"):
        rows = [[c for c in page.children(r) if page.tag[c] in ("td", "th")] for r in page.all(n, "tr")]
        rows = [r for r in rows if r]
        fields = [field_of(page.text(c)) for c in rows[0]] if rows else []
        if "name" not in fields or len({*fields} - {None}) < 2:
            continue
        for cells in rows[1:]:
            own = {f: page.text(c) for f, c in zip(fields, cells) if f}
            yield _person("table", 0.9, own.get("name"), own.get("title"), own.get("department"), own.get("phone"), [m for c in cells for m in addresses_in(page, c)])


def cards(page: Page) -> Iterator[Person]:
    """Siblings of one shape (parent, element, first class), three at least, that hold a name and an address or title. The
    first shape that gives anybody ends the search."""
    shapes: dict[tuple, list[int]] = {}
    for n in page.all(0, "div", "li", "article", "section"):
        first = (page.attrs[n].get("class", "").split() or [""])[0]
        if first or page.tag[n] in ("li", "article"):
            shapes.setdefault((page.parent[n], page.tag[n], first), []).append(n)
    for (_, tag, _), own in shapes.items():
        found = []
        for n in own if len(own) >= 3 else ():
            name, emails = name_in(page, n), addresses_in(page, n)
            if name is None or page.aside[n]:
                continue
            text = page.text(n)
            named = next((page.line(k) for k in page.all(n) if any(page.has(k, w) for w in ("title", "position", "role", "job"))), "")
            title = named if named and named != name else title_in(text.replace(name, " ", 1))
            if emails or title:
                link = next((h for k in page.all(n, "a") if (h := page.attrs[k].get("href")) and not re.match("(?i)mailto:|tel:|#|javascript:", h) and (re.search("(?i)staff|profile|bio|person|employee|directory|user|detail", h) or page.line(k) == name)), None)
                found.append(_person("card", 0.8 if emails else 0.6, name, title, None, phone_in(text), emails, link))
        yield from found
        if found:
            return


def definitions(page: Page) -> Iterator[Person]:
    """Terms that are names, two at least, with the definitions right after them."""
    for n in page.all(0, "dl"):
        own = list(page.children(n))
        if sum(page.tag[k] == "dt" for k in own) < 2:
            continue
        for a, b in zip(own, own[1:]):
            if page.tag[a] == "dt" and page.tag[b] == "dd" and looks_like_name(page.line(a)):
                text = page.text(b)
                yield _person("definition", 0.7, page.line(a), title_in(text), None, phone_in(text), addresses_in(page, b))


def mail_links(page: Page) -> Iterator[Person]:
    """Links to addresses, with the name that they show, or else the nearest one around them."""
    for n in page.all(0, "a"):
        if page.attrs[n].get("href", "").lower().startswith("mailto:"):
            around = page.holder[n] if page.holder[n] >= 0 else n
            text, shown = page.text(around), page.line(n)
            yield _person("mailto", 0.45, shown if looks_like_name(shown) else name_in(page, around), title_in(text), None, phone_in(text), addresses_in(page, n))


def profile_links(page: Page) -> Iterator[Person]:
    """Names in the main part of a page headed as a directory that only link to pages of their own."""
    heading = " ".join(page.text(n) for n in page.all(0, "h1", "h2")).lower()
    if any(term in heading for term in HEADING_TERMS):
        for n in page.all(0, "a"):
            href, name = page.attrs[n].get("href", ""), page.line(n)
            if href and page.main[n] and not page.aside[n] and is_profile_name(name) and not re.match("(?i)mailto:|tel:|#|javascript:", href):
                yield _person("profile", 0.65, name, profile=href)


def single_profile(html: str) -> Person | None:
    """The person of a page with one main part of one heading, a name, and one address; several addresses or persons
    can be others'."""
    page = Page(html)
    mains = [n for n in page.all(0) if (page.tag[n] in ("main", "article") or page.attrs[n].get("role") == "main") and sum(1 for _ in page.all(n, "h1")) == 1]
    if len(mains) != 1:
        return None
    (n,) = mains
    inside = [k for k in page.all(n) if not page.aside[k] or page.aside[n]]
    name = next((page.line(k) for k in inside if page.tag[k] == "h1"), "")
    if not is_profile_name(name):
        return None
    gone = {m for k in page.all(n) if page.aside[k] and not page.aside[n] for m in addresses_in(page, k)} if any(page.aside[k] for k in page.all(n)) else set()
    emails = [m for m in addresses_in(page, n) if m not in gone]
    others = sum(page.attrs[k].get("itemtype", "").find("Person") >= 0 or any(page.has(k, w) for w in ("person", "staff", "member")) for k in inside)
    return _person("single", 0.75, name, None, None, None, emails) if len(emails) == 1 and others <= 1 else None


def _same(p: Person) -> tuple:
    return p["name"].lower(), (p["title"] or "").lower()


def people_of(html: str) -> list[Person]:
    """Everyone a page lists: by structured data, tables, cards and definition lists; of records with one name and title
    the surer one, the earlier on ties, filled from the other. Links to addresses only where these find nobody, and
    links to profiles only where those don't, either."""
    page = Page(html)
    found: dict[tuple, Person] = {}

    def add(strategy) -> None:
        for p in strategy(page):
            if p is None:
                continue
            old = found.get(_same(p))
            if old is None:
                found[_same(p)] = p
                continue
            first, second = (old, p) if old["confidence"] >= p["confidence"] else (p, old)
            found[_same(p)] = {k: (list(dict.fromkeys(first[k] + second[k])) if k == "emails" else first[k] if first[k] is not None else second[k]) for k in first}

    for strategy in (structured, tables, cards, definitions):
        add(strategy)
    for last in (mail_links, profile_links):
        if not found:
            add(last)
    return list(found.values())


def next_page(html: str) -> tuple[str, str] | None:
    """(how, link) to the page after this one: rel=next, a link called next, or the number after the current one."""
    page = Page(html)
    for n in page.all(0, "a", "link"):
        if "next" in page.attrs[n].get("rel", "").lower().split():
            return "rel", page.attrs[n].get("href", "")
    links = [(page.line(n), page.attrs[n].get("href", "")) for n in page.all(0, "a")]
    for text, href in links:
        if re.fullmatch(r"(?i)(?:next(?: page)?|older)\s*[›»>→]*|[›»→]", text):
            return "text", href
    current = next((x for n in page.all(0, "span", "strong", "em", "b") if (x := page.line(n)).isdigit()), None)
    if current:
        return next((("number", href) for text, href in links if text == str(int(current) + 1)), None)
    return None
