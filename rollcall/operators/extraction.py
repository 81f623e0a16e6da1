"""People from pages: each page is parsed where it lies, in Arrow batches; what follows is built-in expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions.text import collapse_whitespace, record_key
from ..shared import spread
from ..shipping import ship

COLUMNS = "page_id long, place int, name string, title string, department string, phone string, emails array<string>, profile string, strategy string, confidence double"

FIELDS = ("name", "title", "department", "phone", "emails", "profile", "strategy", "confidence")
ARROW = pa.schema([("page_id", pa.int64()), ("place", pa.int32()), *((c, pa.string()) for c in FIELDS[:4]), ("emails", pa.list_(pa.string())), ("profile", pa.string()), ("strategy", pa.string()), ("confidence", pa.float64())])


def _mapped(pages: DataFrame, function, schema: str, arrow: pa.Schema) -> DataFrame:
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [r for key, html in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in function(key, html or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, schema)


def people(pages: DataFrame) -> DataFrame:
    """COLUMNS: everyone that pages (page_id, html) list, in their order; null and empty pages list nobody."""
    return _mapped(pages, lambda key, html: [(key, k, *(p[f] for f in FIELDS)) for k, p in enumerate(P.people_of(html))], COLUMNS, ARROW)


def profiles(pages: DataFrame) -> DataFrame:
    """COLUMNS: the person of each page that is one person's own."""
    return _mapped(spread(pages), lambda key, html: [(key, 0, *(p[f] for f in FIELDS))] if (p := P.single_profile(html)) else [], COLUMNS, ARROW)


def records(found: DataFrame) -> DataFrame:
    """found with a key over its fields, and whether one of its addresses is shared by others of the page."""
    each = found.select("page_id", "place", F.explode("emails").alias("email")).groupBy("page_id", "email").agg(F.count_distinct("place").alias("n"))
    shared = found.select("page_id", "place", F.explode("emails").alias("email")).join(each.filter("n > 1"), ["page_id", "email"]).select("page_id", "place").distinct().withColumn("shared", F.lit(True))
    key = record_key(F.col("name"), F.col("title"), F.col("department"), F.array_join("emails", "|"))
    return found.join(shared, ["page_id", "place"], "left").withColumn("shared", F.coalesce("shared", F.lit(False))).withColumn("record_key", key)


def texts(pages: DataFrame, closed: bool = False) -> DataFrame:
    """(page_id, text): the text of pages by blocks, scripts and styles left out. closed: only character references that
    end with a semicolon are read; browsers also read some without one."""
    return _mapped(pages, lambda key, html: [(key, P.Page(P.only_closed(html) if closed else html).text())], "page_id long, text string", pa.schema([("page_id", pa.int64()), ("text", pa.string())]))


def next_pages(pages: DataFrame) -> DataFrame:
    """(page_id, how, link): pages that another one follows."""
    arrow = pa.schema([("page_id", pa.int64()), ("how", pa.string()), ("link", pa.string())])
    return _mapped(pages, lambda key, html: [(key, *found)] if (found := P.next_page(html)) else [], "page_id long, how string, link string", arrow)


def detection_score(url_score: Column, html: Column) -> Column:
    """How likely a page lists people: the greatest of its URL's score, headings, mail links, markup and tables."""
    mails = F.size(F.regexp_extract_all(html, F.lit("(?i)href=[\"']mailto:"), F.lit(0)))
    return F.greatest(
        url_score * 0.6,
        F.when(html.rlike(r"(?i)<h[1-3][^>]*>[^<]*\b(?:staff|directory|faculty|employees|our team)\b"), 0.6).otherwise(0.0),
        F.when(mails >= 5, 0.7).when(mails >= 1, 0.45).otherwise(0.0),
        F.when(html.rlike(r"(?i)schema\.org/Person|\"@type\"\s*:\s*\"Person\""), 0.75).otherwise(0.0),
        F.when(html.rlike(r"(?is)<table.*?<th[^>]*>\s*(?:full )?name\s*<"), 0.8).otherwise(0.0),
    )


def json_records(column: Column, schema: str) -> Column:
    """array<struct>: the records of a JSON text, under the first of the known names that holds any, one level of
    'data' deep, or the text itself where it is an array."""
    known = ("people", "staff", "employees", "results", "items", "records")
    paths = [f"$.{k}" for k in known] + [f"$.data.{k}" for k in known] + ["$.data", "$"]
    arrays = [F.from_json(F.when(F.get_json_object(column, p).startswith("["), F.get_json_object(column, p)), f"array<struct<{schema}>>") for p in paths]
    return F.coalesce(*arrays)


def json_next(column: Column) -> Column:
    """struct<how, value> of what follows a JSON page: a cursor, a next URL, an offset, or a page number; null if nothing."""
    get = lambda p: F.get_json_object(column, p)
    n = lambda p: get(p).cast("long")
    as_ = lambda how, value: F.struct(F.lit(how).alias("how"), value.cast("string").alias("value"))
    return (
        F.when(F.coalesce(get("$.next_cursor"), F.lit("")) != "", as_("cursor", get("$.next_cursor")))
        .when(F.coalesce(get("$.next"), F.lit("")) != "", as_("url", get("$.next")))
        .when(n("$.offset") + n("$.limit") < n("$.total"), as_("offset", n("$.offset") + n("$.limit")))
        .when(n("$.page") < n("$.pages"), as_("page", n("$.page") + 1))
    )


# Where JSON bodies hold their records, and what they call fields, in the order in which these are tried.
COLLECTIONS = ("data", "results", "items", "records", "staff", "employees", "people", "rows", "directory")
ALIASES = {
    "full": ("full_name", "fullName", "displayName", "display_name", "name", "staff_name", "employee_name"),
    "first": ("first_name", "firstName", "given_name", "givenName", "first"),
    "last": ("last_name", "lastName", "family_name", "familyName", "last", "surname"),
    "title": ("title", "job_title", "jobTitle", "position", "role", "assignment"),
    "email": ("email", "email_address", "emailAddress", "mail", "work_email"),
    "phone": ("phone", "phone_number", "phoneNumber", "telephone", "work_phone"),
    "department": ("department", "dept", "division", "team"),
    "id": ("id", "staff_id", "staffId", "employee_id", "employeeId", "uuid", "guid"),
    "profile": ("profile_url", "profileUrl", "url", "link", "permalink"),
}
DEEPEST = 4
_MAP, _ARRAY = "map<string,variant>", "array<variant>"


def parsed_json(body: Column) -> Column:
    """A JSON object or array as VARIANT; null for anything else."""
    return F.when(F.trim(body).rlike(r"^[\[{]"), F.try_parse_json(F.trim(body)))


def collection(value: Column, depth: int = 0) -> Column:
    """array<map<string,variant>>: the records of a body, null if it holds none. An array is the records themselves; in an
    object an array under a known name is, the first of these; else the first one that isn't empty within its members,
    those of known names first, then by name, down to DEEPEST objects. Members that are no objects are no records."""
    rank = lambda k: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, COLLECTIONS)), k), F.lit(0)), F.lit(len(COLLECTIONS) + 1))
    objects = lambda a: F.filter(F.transform(a, lambda x: F.try_variant_get(x, "$", _MAP)), lambda x: x.isNotNull())
    whole, members = F.try_variant_get(value, "$", _ARRAY), F.try_variant_get(value, "$", _MAP)
    names = F.transform(F.array_sort(F.transform(F.map_keys(members), lambda k: F.struct(rank(k).alias("r"), k.alias("k")))), lambda x: x["k"])
    known = F.filter(F.transform(F.filter(names, lambda k: k.isin(*COLLECTIONS)), lambda k: F.try_variant_get(members[k], "$", _ARRAY)), lambda a: a.isNotNull())
    out = F.when(whole.isNotNull(), objects(whole)).when(F.size(known) > 0, objects(F.try_element_at(known, F.lit(1))))
    if depth < DEEPEST:
        within = F.filter(F.transform(names, lambda k: collection(members[k], depth + 1)), lambda a: F.coalesce(F.size(a), F.lit(0)) > 0)
        out = out.otherwise(F.try_element_at(within, F.lit(1)))
    return out


def json_field(record: Column, field: str) -> Column:
    """The first value of a field's names that is a text which isn't blank, or a number."""

    def own(name: str) -> Column:
        value = record[name]
        kind = F.schema_of_variant(value)
        text = F.variant_get(value, "$", "string")
        return F.when(kind == "STRING", F.nullif(collapse_whitespace(text), F.lit(""))).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), text)

    return F.coalesce(*[own(n) for n in ALIASES[field]])


def person_name(c: Column) -> Column:
    """Whether a text may be a person's name: what pages.looks_like_name() says."""
    return F.length(c).between(3, 120) & c.rlike("[A-Za-z]") & ~c.rlike(P.NO_NAME.pattern) & (F.size(F.split(c, " ")) <= 6) & ~F.contains(c, F.lit("@"))


def json_people(bodies: DataFrame) -> DataFrame:
    """(page_id, place, name, title, department, phone, email, id, profile, confidence) of the records of JSON bodies
    (page_id, body) that have a name. Each body is parsed once; bodies that are no JSON give none."""
    found = bodies.select("page_id", F.posexplode(collection(parsed_json(F.col("body")))).alias("place", "record"))
    get = {f: json_field(F.col("record"), f) for f in ALIASES}
    rows = found.select("page_id", "place", *[c.alias(f) for f, c in get.items()])
    name = F.coalesce("full", F.nullif(F.concat_ws(" ", "first", "last"), F.lit("")))
    out = rows.withColumn("name", name).filter(person_name(F.col("name")))
    return out.select("page_id", "place", "name", "title", "department", "phone", F.lower("email").alias("email"), "id", "profile", F.lit(0.92).alias("confidence"))


def json_score(url: Column, content_type: Column, body: Column) -> Column:
    """How likely a source is a JSON directory: its URL 0.4, its type 0.6, records with names 0.9; 0 if the body can't be
    read. A null body says nothing."""
    records = collection(parsed_json(body))
    named = F.coalesce(F.exists(records, lambda r: json_field(r, "full").isNotNull() | json_field(r, "last").isNotNull()), F.lit(False))
    shown = F.greatest(F.when(url.rlike(r"(?i)/(api|rest|json|graphql)(/|$|\?)"), 0.4).otherwise(0.0), F.when(body.isNotNull() & content_type.rlike(r"(?i)application/(json|.*\+json)"), 0.6).otherwise(0.0), F.when(named, 0.9).otherwise(0.0))
    return F.when(body.isNotNull() & parsed_json(body).isNull(), 0.0).otherwise(shown)
