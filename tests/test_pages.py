"""Pages: markup of any depth, what stands for a name or a title, records met twice, single profiles."""

import time

from rollcall.functions import pages as P


def test_markup_that_is_never_closed():
    began = time.time()
    deep = "<b>" * 100_000 + '<p>Ana Stone <a href="mailto:a@x.org">Ana Stone</a></p>' + "</i>" * 100_000
    assert [(p["name"], p["emails"], p["strategy"]) for p in P.people_of(deep)] == [("Ana Stone", ["a@x.org"], "mailto")]
    assert P.Page("<div>" * 50_000 + "x" + "</div>" * 50_000).text() == "x"
    assert P.next_page("<li>" * 50_000 + "<a rel=next href=?p=2>") == ("rel", "?p=2")
    assert time.time() - began < 20


def test_elements_and_text():
    page = P.Page('<main>a<br>b<script>var x="<p>";</script><p>c<p>d &amp; e<ul><li>f<li>g</ul></b></main>h<style>p{}</style>')
    assert page.text() == "a\nb\nc\nd & e\nf\ng\nh"
    assert [page.tag[k] for k in page.children(0)] == ["main", "style"]
    main = next(iter(page.all(0, "main")))
    assert page.text(main) == "a\nb\nc\nd & e\nf\ng" and [page.line(k) for k in page.all(main, "li")] == ["f", "g"]


def test_names_and_titles():
    assert [P.looks_like_name(x) for x in ("Ana Stone", "More", "x@y.org", "Jo", "one two three four five six seven", "12345", "Read more here")] == [True, False, False, False, False, False, False]
    assert P.title_in("Ana Stone | 555-0100 | Deputy Clerk, Records") == "Deputy Clerk" and P.title_in("Wizard\nTitle") is None
    assert P.is_profile_name("Ana Stone") and not P.is_profile_name("Fire Department") and not P.is_profile_name("About Ana Stone") and not P.is_profile_name("Office Manager")
    assert P.phone_in("call +1 (512) 555-0100 now") == "512-555-0100"


def test_one_person_by_two_ways():
    ld = '<script type="application/ld+json">[{"@type":["Person"],"name":"Ana Stone","jobTitle":"City Manager","email":["mailto:A@x.org"]}]</script>'
    table = "<table><tr><th>Name<th>Title<th>Phone<th>Email<tr><td>ANA STONE<td>City manager<td>555 010 0000<td>b@x.org<tr><td>Ana Stone<td>Clerk<td><td></table>"
    got = P.people_of(ld + table)
    assert [(p["name"], p["title"], p["phone"], p["emails"], p["confidence"]) for p in got] == [("Ana Stone", "City Manager", "555 010 0000", ["a@x.org", "b@x.org"], 0.95), ("Ana Stone", "Clerk", None, [], 0.9)]


def test_cards_by_shape():
    card = '<div class="tile big"><h3>{0}</h3><span class="job-title">{1}</span><a href="/staff/{0}">more</a></div>'
    got = P.people_of("".join(card.format(n, t) for n, t in (("Ana Stone", "Wizard"), ("Li Lee", "Clerk"), ("Omar Kim", ""), ("Read more", "x"))))
    assert [(p["name"], p["title"], p["profile"], p["confidence"]) for p in got] == [("Ana Stone", "Wizard", "/staff/Ana Stone", 0.6), ("Li Lee", "Clerk", "/staff/Li Lee", 0.6)]
    assert P.people_of("".join(card.format(n, "Clerk") for n in ("Ana Stone", "Li Lee"))) == []


def test_single_profiles():
    one = "<main><h1>Ana Stone</h1><p>write to a@x.org</p>{}</main>"
    assert P.single_profile(one.format(""))["emails"] == ["a@x.org"]
    assert P.single_profile(one.format("<footer>b@x.org</footer>"))["emails"] == ["a@x.org"]
    for more in ("<p>b@x.org", '<p class="person">x<p class="person">y', "<h1>Li Lee</h1>", "</main><article><h1>Li Lee</h1></article>"):
        assert P.single_profile(one.format(more)) is None


def test_words_of_references_without_a_semicolon(spark, tmp_path):
    import duckdb

    from rollcall.queries import ORACLES, QUERIES

    html = ["<title>a&amp; b &amp;&amp;&amp</title><p>x&copy &lt;y&gt;</p>", "<p>a&ampb &mdash;c&mdash d&#39;e & f&"]
    spark.createDataFrame([(k, "http://h.org/", h) for k, h in enumerate(html)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(c.execute(ORACLES["h1_page_words"]).fetchall())
    assert {r.page_id: r.words for r in QUERIES["h1_page_words"](spark, str(tmp_path)).collect()} == want
    assert P.Page("a&amp").text() == "a&"  # a browser's reading stays the usual one
