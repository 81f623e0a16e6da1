"""URL and host functions over the pages, and over forms derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import standard_urls as W
from ..functions import urls as U
from .base import query, table

HINTS = {"/(?:en|fr)/[0-9]+": 0.4, r"page=[0-9]+": 0.7, "/de/": 0.2}
#: The canonical form of the pages' URLs as SQL: they have no user info, ports or doubled slashes.
PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
ASKED = r"regexp_replace(regexp_replace(coalesce(regexp_extract(url, '\?([^#]*)', 1), ''), '(^|&)(?:ref|utm_source)=[^&]*', '', 'g'), '^&', '')"
CANONICAL = rf"regexp_extract(url, '^[a-z]+://[^/?#]+') || CASE WHEN {PATH} IN ('', '/') THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END || CASE WHEN {ASKED} = '' THEN '' ELSE '?' || {ASKED} END"
HOST = r"regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\.', '')"


@query(f"""SELECT page_id, {HOST} AS host, {CANONICAL} AS canonical FROM pages""")
def x50_x51_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", U.host_of(F.col("url")).alias("host"), U.canonical(F.col("url")).alias("canonical"))


@query(f"""SELECT page_id, {CANONICAL.replace("|| CASE WHEN " + ASKED + " = ''", "|| CASE WHEN TRUE").replace("THEN '' ELSE '?' || " + ASKED, "THEN '' ELSE ''")} || '?a=1&a=0&b=' AS canonical,
{HOST} AS host, NULL AS mail FROM pages""")
def x50_url_forms(spark, d):
    """User info, upper case, default ports, trailing dots, doubled slashes, unsorted parameters."""
    url = F.col("url")
    scheme = F.regexp_extract(url, "^([a-z]+)://", 1)
    port = F.when(scheme == "https", ":443").otherwise(":80")
    made = F.concat(F.upper(scheme), F.lit("://user:pass@"), F.upper(F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)), F.lit("."), port, F.replace(F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("/"), F.lit("//")), F.lit("/?b&utm_id=9&a=1&GCLID=x&a=0#top"))
    mail = U.canonical(F.concat(F.lit("ftp://"), F.regexp_extract(url, "^[a-z]+://(.*)", 1)))
    return table(spark, d, "pages").select("page_id", U.canonical(made).alias("canonical"), U.host_of(made).alias("host"), mail.alias("mail"))


@query(f"""SELECT page_id, array_to_string(list_slice(string_split({HOST}, '.'), -2, -1), '.') AS site, 'k' || page_id || '.k12.tx.us' AS school, 'ci.town' || page_id || '.tx.us' AS city, 'body' || page_id || '.gov.uk' AS abroad FROM pages""")
def x52_registrable(spark, d):
    made = lambda a, b: F.concat(F.lit(a), F.col("page_id").cast("string"), F.lit(b))
    labels = ["k12", "ci", "co"]
    return table(spark, d, "pages").select(
        "page_id",
        U.registrable(U.host_of(F.col("url"))).alias("site"),
        U.registrable(made("mail.www.k", ".k12.tx.us"), labels).alias("school"),
        U.registrable(made("mail.ci.town", ".tx.us"), labels).alias("city"),
        U.registrable(made("www.body", ".gov.uk")).alias("abroad"),
    )


@query(r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 9 WHEN 2 THEN 10 END AS exclusion, CASE WHEN page_id % 4 < 3 THEN 0.0 WHEN regexp_matches(url, 'page=[0-9]+') THEN 0.7
WHEN regexp_matches(url, '/(?:en|fr)/[0-9]+') THEN 0.4 WHEN regexp_matches(url, '/de/') THEN 0.2 ELSE 0.0 END AS score FROM pages""")
def x53_exclusion_and_score(spark, d):
    base = F.regexp_replace("url", "[#].*$", "")
    made = F.expr("CASE page_id % 4 WHEN 0 THEN '/News/x' WHEN 1 THEN '/a.PDF' WHEN 2 THEN '?month=3' ELSE '' END")
    url = F.when(F.col("page_id") % 4 == 3, base).otherwise(F.concat(F.lit("https://h.org"), made))
    return table(spark, d, "pages").select("page_id", U.exclusion(url).alias("exclusion"), U.directory_score(url, HINTS).alias("score"))


@query(r"""SELECT page_id, href, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || CASE WHEN regexp_replace(href, '/+$', '') = '' THEN '/' ELSE regexp_replace(href, '/+$', '') END END AS target
FROM (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"?#]*)"', 1)) AS href FROM pages) WHERE NOT regexp_matches(href, '//|/\.')""")
def x54_h14_links(spark, d):
    """The links of a page, resolved."""
    links = table(spark, d, "pages").select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="(/[^"?#]*)"'), F.lit(1)))).alias("href"))
    return links.filter(~F.col("href").rlike(r"//|/\.")).select("page_id", "href", U.resolved(F.col("href"), F.col("url")).alias("target"))


@query(rf"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/a/c' AS beside, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/c?x=1' AS above, regexp_extract(url, '^([a-z]+:)', 1) || '//o.org/' AS other,
NULL AS mail FROM pages""")
def x54_relative_links(spark, d):
    base = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), F.lit("/a/b/d?q#f"))
    go = lambda href: U.resolved(F.lit(href), base)
    return table(spark, d, "pages").select("page_id", go("../c/.").alias("beside"), go("../.././c?x=1#y").alias("above"), go("//O.org").alias("other"), go("mailto:a@b.org").alias("mail"))


@query(rf"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/' AS root, TRUE AS own, regexp_matches({PATH}, '^/en/') OR {PATH} = '/en' AS in_en, FALSE AS elsewhere FROM pages""")
def x55_website_scope(spark, d):
    url = F.col("url")
    root = U.website_root(url)
    return table(spark, d, "pages").select("page_id", root.alias("root"), U.in_scope(url, root).alias("own"), U.in_scope(url, F.concat(root, F.lit("en"))).alias("in_en"), U.in_scope(url, F.lit("https://o.org")).alias("elsewhere"))


@query(rf"""SELECT page_id FROM pages WHERE {HOST} = 'example.org' OR {HOST} LIKE '%.example.org' OR {HOST} LIKE '%.tiontion.example.com'""")
def x56_approved_hosts(spark, d):
    approved = spark.createDataFrame([("example.org",), ("tiontion.example.com",)], "domain string")
    own = table(spark, d, "pages").select("page_id", F.explode(U.domain_suffixes(U.host_of(F.col("url")))).alias("domain"))
    return own.join(F.broadcast(approved), "domain", "left_semi").select("page_id").distinct()


@query(r"""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'http://s' || s_suppkey || '.org/' WHEN 2 THEN 'https://s' || s_suppkey || '.org/a' ELSE NULL END AS website,
CASE s_suppkey % 4 WHEN 0 THEN 'not_http' WHEN 1 THEN 'api_host' WHEN 2 THEN 'api_path' ELSE 'data_file' END AS reason FROM supplier""")
def x57_x58_websites(spark, d):
    k = F.col("s_suppkey").cast("string")
    n = F.col("s_suppkey") % 4
    raw = F.when(n == 0, F.lit(" N/A ")).when(n == 1, F.concat(F.lit("S"), k, F.lit(".org"))).when(n == 2, F.concat(F.lit("https://s"), k, F.lit(".ORG/a/"))).otherwise(F.lit(""))
    machine = F.when(n == 0, F.concat(F.lit("ftp://s"), k)).when(n == 1, F.lit("https://api.s.org/")).when(n == 2, F.lit("http://s.org/wp-json/x")).otherwise(F.lit("http://s.org/a/list.JSON?x"))
    return table(spark, d, "supplier").select("s_suppkey", U.published_website(raw).alias("website"), U.machine_reason(machine).alias("reason"))


_ENCODED = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) > 127 THEN url_encode(c) ELSE c END), '')"


@query(rf"""SELECT page_id, href, regexp_extract(url, '^[a-z]+://[^/?#]+') || CASE WHEN rtrim(href, '/') = '' THEN '/' ELSE {_ENCODED.format("rtrim(href, '/')")} END AS target
FROM (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)""")
def x54_all_links(spark, d):
    """Every link of a page, resolved as browsers do: letters of all scripts come percent-encoded."""
    links = table(spark, d, "pages").select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))).alias("href"))
    return links.select("page_id", "href", W.resolved_of(spark, F.col("href"), F.col("url")).alias("target"))


@query(rf"""SELECT page_id, 'https://xn--bcher-kva.' || {HOST} || {_ENCODED.format(f"rtrim({PATH}, '/')")} || '/x%20y?a=%C3%A9&k=' || page_id AS wide, CASE WHEN page_id < 256 THEN 'http://10.0.0.' || page_id ELSE 'http://10.0.' || page_id // 256 || '.' || page_id % 256 END || '/' AS numbers,
'http://' || {HOST} || '/top' AS odd, NULL AS bad FROM pages""")
def x50_standard_forms(spark, d):
    """Hosts in other scripts, numbers as hosts, backslashes, white space and dots: read as browsers do."""
    url, k = F.col("url"), F.col("page_id").cast("string")
    host, path = F.regexp_replace(F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1), r"^www\.", ""), F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1)
    forms = {
        "wide": F.concat(F.lit(" HTTPS://me@Bücher."), F.upper(host), F.lit(".:443"), path, F.lit("/./q/../x y/?k="), k, F.lit("&utm_id=4&a=é#z")),
        "numbers": F.concat(F.lit("http://10."), k, F.lit(":80/..")),
        "odd": F.concat(F.lit("http:\\\\"), host, F.lit("\\a\\..\\\ttop/")),
        "bad": F.concat(F.lit("http://a b."), host),
    }
    return table(spark, d, "pages").select("page_id", *[W.canonical_of(spark, c).alias(n) for n, c in forms.items()])
