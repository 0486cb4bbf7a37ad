"""Text, URL, HTML and nested expressions on edge rows."""

import json

import pytest
from pyspark.sql import functions as F

from matricula.functions import display, html as H, nested, numeric as N, text as T, urls as U

L = F.lit


@pytest.mark.parametrize(
    "cell,expected",
    [("12", 12.0), (" 3.5 ", 3.5), ("NA", None), ("", None), ("NULL", None), ("PrivacySuppressed", None),
     ("abc", None), ("3.5d", None), (None, None), ("-2", -2.0), ("1e3", 1000.0)],
)
def test_parse_number(one, cell, expected):
    assert one(N.parse_number(L(cell).cast("string"))) == (expected,)


def test_net_price_takes_the_positive_variant(one):
    assert one(
        N.net_price(L("NULL"), L("100")), N.net_price(L("-5"), L("7")), N.net_price(L("0"), L("NA"), L(9.0)),
    ) == (100.0, 7.0, 9.0)


def test_size_band_edges(one):
    assert one(*[N.size_band(L(x).cast("double")) for x in (None, 4999.0, 5000.0, 14999.0, 15000.0)]) == (
        "medium", "small", "medium", "medium", "large",
    )


def test_clamps_guard_null(one):
    assert one(
        N.clamp01(L(None).cast("double")), N.confidence_or_zero(L("x")), N.confidence_or_zero(L("7")),
        N.confidence_or_zero(L(None).cast("string")), N.confidence_or_zero(L("-1")),
    ) == (None, 0.0, 1.0, 0.0, 0.0)


@pytest.mark.parametrize(
    "a,b",
    [
        ("University of Freedonia, Lakeside", "University of Freedonia-Lakeside"),
        ("University of Sylvania–Hilltop", "University of Sylvania-Hilltop"),
        ("Plains State University-Main Campus", "The Plains State University"),
        ("University of Arcadia at Bay", "University of Arcadia Bay"),
    ],
)
def test_names_meet_on_one_key(one, a, b):
    left, right = one(T.normalize_name(L(a)), T.normalize_name(L(b)))
    assert left == right


def test_word_boundaries_are_respected(one):
    assert one(T.normalize_name(L("Athens Theatre"))) == ("athenstheatre",)


def test_slugs(one):
    assert one(
        T.slugify(L(" St. John's -- College ")), T.slugify_folded(L("Universitè Éà")), T.slugify(L("Éa"))
    ) == ("st-john-s-college", "universite-ea", "a")


def test_match_name_and_same_name(one):
    assert one(
        T.match_name(L("Inès Béla Martí (a poet)")), T.match_name(L("O'Neil-Smith")),
        T.institution_key(L("Univ. of  X")), T.institution_key(L("")),
    ) == ("ines bela marti", "o neil smith", "univ of x", None)


@pytest.mark.parametrize(
    "title,expected",
    [("Associate Professor of Law", True), ("Dean of the Faculty and Professor", True), ("Provost", False),
     ("Trustee Emeritus", False), ("Gardener", None), ("", None), (None, None), ("Professorial", None),
     ("Head Coach", False), ("Artist-in-Residence", True), ("Chief Financial Officer", False)],
)
def test_classify_role(one, title, expected):
    assert one(T.classify_role(L(title).cast("string"))) == (expected,)


@pytest.mark.parametrize(
    "name,school,expected",
    [("Ann Lee | Cedar Hill College", "Cedar Hill College", "Ann Lee"),
     ("Ann Lee - Cedar Hill", "Cedar Hill College", "Ann Lee"),
     ("Ann Lee: The Cedar Hill College Site", "Cedar Hill College", "Ann Lee"),
     ("Ann Lee - Poet", "Cedar Hill College", "Ann Lee - Poet"),
     (" | Cedar Hill College", "Cedar Hill College", None),
     ("  ", "X", None)],
)
def test_strip_boilerplate(one, name, school, expected):
    assert one(T.strip_boilerplate(L(name), L(school))) == (expected,)


def test_method_label(one):
    t, f = L(True), L(False)
    assert one(T.method_label(t, t, f, t), T.method_label(f, f, f, f)) == ("sitemap+department+search", "none")


def test_city_state(one):
    assert one(T.city_state(L("Athens, ga ")), T.city_state(L("Paris, France")), T.city_state(L("A, B, TX"))) == (
        "GA", None, "TX",
    )


@pytest.mark.parametrize(
    "url,expected",
    [("HTTPS://WWW.X.edu/People/?id=1#top", "https://www.x.edu/People?id=1"), ("http://x.edu", "http://x.edu/"),
     ("http://x.edu/a/", "http://x.edu/a"), ("http://x.edu/a?", "http://x.edu/a")],
)
def test_normalize_url(one, url, expected):
    assert one(U.normalize_url(L(url))) == (expected,)


@pytest.mark.parametrize(
    "url,expected",
    [("https://home.cedar.edu/x", "cedar.edu"), ("www.elm.ac.uk", "elm.ac.uk"), ("cs.elm.ac.uk/", "elm.ac.uk"),
     ("localhost", "localhost"), ("", None), (None, None), ("https://a.b.edu:8080/", "b.edu")],
)
def test_registrable_domain(one, url, expected):
    assert one(U.registrable_domain(L(url).cast("string"))) == (expected,)


@pytest.mark.parametrize(
    "base,href",
    [("https://x.edu/a/b", "c"), ("https://x.edu/a/b/", "c"), ("https://x.edu/a/b", "../c"), ("https://x.edu/a/b", "/c/../d"),
     ("https://x.edu/a/b?q=1", "?q=2"), ("https://x.edu/a/b", "//y.org/z"), ("https://x.edu", "c"),
     ("https://x.edu/a/b", "http://z.com/q"), ("https://x.edu/a/b/", "./c?x=1#f"), ("https://x.edu/a/b", "../../../c")],
)
def test_resolve_like_the_standard_library(one, base, href):
    from urllib.parse import urljoin

    assert one(U.resolve(L(base), L(href))) == (urljoin(base, href),)


@pytest.mark.parametrize(
    "href,text,rel,expected",
    [("https://x.edu/faculty/?letter=B", "B", "", "pagination"), ("https://x.edu/faculty?page=2", "go", "", "pagination"),
     ("https://x.edu/people/page/3/", "three", "", "pagination"), ("https://x.edu/people/jane", "Jane", "next", "pagination"),
     ("https://x.edu/people/jane", "Jane", "", "profile"), ("https://x.edu/files/img.php?id=2", "pic", "", "ignore"),
     ("https://x.edu/people/cv.pdf", "CV", "", "ignore"), ("https://x.edu/news", "News", "", "ignore"),
     ("https://x.edu/faculty?page=", "none", "", "ignore")],
)
def test_classify_link(one, href, text, rel, expected):
    assert one(U.classify_link(L(href), L("https://x.edu/faculty/"), L(text), L(rel))) == (expected,)


@pytest.mark.parametrize(
    "url,expected",
    [("https://x.edu/faculty/", True), ("https://x.edu/directory/faculty/index.html", True), ("https://x.edu/people.php", True),
     ("https://x.edu/faculty/jane-doe", False), ("https://x.edu/news/", False)],
)
def test_directory_index(one, url, expected):
    assert one(U.is_directory_index(L(url))) == (expected,)


PAGE = """<!DOCTYPE html><html><head><title>Jane Doe | Acme</title><meta content='Jane "JD" Doe' name="author">
<script type="application/ld+json">{bad json}</script>
<script type="application/ld+json">{"@graph":[{"@type":"WebPage","name":"x"},{"@type":["Thing","Person"],"name":" Jane Doe ",
"jobTitle":"Professor","worksFor":{"name":"Physics"},"email":"mailto:jd@acme.edu","telephone":"555-111-2222"}]}</script></head>
<body><nav>Menu</nav><!-- <a href="/hidden">no</a> --><h1>Jane Doe, Professor of Physics</h1>
<p>R&amp;D  lab</p><a href='mailto:jane%2Bx@acme.edu?subject=hi'>mail</a><a href="tel: 555 ">t</a><a href=/people/x rel=next>more</a>
<script>var a = "<a href='/js'>x</a>";</script></body></html>"""


def test_page_hints(one):
    page = L(PAGE)
    person, hint, author, links, text = one(
        H.jsonld_person(page), H.parse_hint(page), H.meta_author(page), H.anchors(page), H.visible_text(page)
    )
    assert (person.name, person.title, person.department, person.email, person.phone) == (
        "Jane Doe", "Professor", "Physics", "jd@acme.edu", "555-111-2222",
    )
    assert (hint.name, hint.title) == ("Jane Doe", "Professor of Physics")
    assert author == 'Jane "JD" Doe'
    assert [(a.href, a.rel) for a in links] == [("mailto:jane%2Bx@acme.edu?subject=hi", ""), ("tel: 555", ""), ("/people/x", "next")]
    assert text == "Jane Doe, Professor of Physics R&D lab mail t more"
    mail, tel = one(H.first_mailto(H.anchors(page)), H.first_tel(H.anchors(page)))
    assert (mail, tel) == ("jane+x@acme.edu", "555")


def test_no_structured_person(one):
    (person,) = one(H.jsonld_person(L('<script type="application/ld+json">[{"@type":"Org"}]</script>')))
    assert person.name is None and person.email is None


@pytest.mark.parametrize(
    "text,expected",
    [("write a.b@x.edu now", "a.b@x.edu"), ("jd [at] acme.edu", "jd@acme.edu"), ("jd (at) acme (dot) edu", "jd@acme.edu"),
     ("jd AT acme DOT edu", "jd@acme.edu"), ("look at the dot on it", None), ("élan@é.fr", "élan@é.fr")],
)
def test_email_in_text(one, text, expected):
    assert one(H.email_in_text(L(text))) == (expected,)


def test_grounding(one):
    null = L(None).cast("string")
    assert one(
        H.grounded_email(L("A@x.edu"), L("mail a@X.edu"), null), H.grounded_email(L("b@x.edu"), L("mail a@x.edu"), null),
        H.grounded_email(L("b@x.edu"), L(""), L("B@x.edu")), H.grounded_email(L("not mail"), L("not mail"), null),
        H.grounded_phone(L("(555) 111.2222"), L("call 555-111-2222"), null), H.grounded_phone(L("123"), L("123"), null),
        H.grounded_phone(L("555-111-3333"), L("555-111-2222"), L("5551113333")),
    ) == ("A@x.edu", None, "b@x.edu", None, "(555) 111.2222", None, "555-111-3333")


def test_gates(one):
    assert one(H.looks_like_html(L("  <!DOCTYPE HTML>")), H.looks_like_html(L("{}")), H.soft_404(L("Sorry, this page left"))) == (
        True, False, True,
    )


def test_sitemaps(one):
    index = '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> a </loc></sitemap></sitemapindex>'
    got = one(*[H.sitemap_entries(L(x)) for x in (index, "<urlset><url><loc>b</loc></url><url><loc></loc></url></urlset>", "<urlset><loc>")])
    assert [(g.kind, g.locs) for g in got] == [("sitemapindex", ["a"]), ("urlset", ["b"]), ("urlset", [])]


def test_excerpt_order_and_cut(one):
    (got, cut) = one(
        H.excerpt(L("<body><p>rest</p><h2>B</h2><a href='#'>l</a><a href='#'>l</a><h1>A</h1></body>")), H.excerpt(L("<h1>abcdef</h1>"), 12)
    )
    assert got == "Headings: B | A\nLinks: l\nText: rest" and cut == "Headings: ab"


def test_claims_and_labels(spark):
    row = spark.sql(
        "select map('P31', array(named_struct('id', 'Q5')), 'P106', array(named_struct('id', cast(null as string)), named_struct('id', 'Q1')),"
        " 'P570', array(named_struct('id', cast(null as string)))) claims, map('P31', cast(null as array<struct<id:string>>)) none"
    ).select(
        nested.claim_ids(F.col("claims"), "P106"), nested.is_human(F.col("claims")), nested.life_status(F.col("claims")),
        nested.life_status(F.col("none")), nested.sitelink_count(L(None).cast("map<string,string>")),
        nested.occupation_labels(F.array(*[L(x) for x in ("Scientist", "a", "b", "c", "d", "e")])),
        nested.award_labels(F.array(*[L(x) for x in "aabcdefg"])),
    ).first()
    assert tuple(row) == (["Q1"], True, "historical", "current", 0, list("abcd"), list("abcdef"))


def test_recent_affiliation_and_plausibility(spark):
    aff = "array(named_struct('institution', named_struct('id', 'https://o/I1'), 'years', array(2019, 2024)))"
    row = spark.sql(
        f"select {aff} a, slice({aff}, 1, 0) e, array('Chemistry') f, array('Engineering') eng, array('History') his, cast(null as array<string>) n, slice(array('x'), 1, 0) z"
    ).select(
        *[nested.affiliated_recently(F.col(c), L(i), L(y)) for c, i, y in (("a", "I1", 2023), ("a", "I1", 2025), ("a", "I2", 2000), ("e", "I2", 2000))],
        *[nested.plausible_here(F.col(f), F.col(g)) for f, g in (("f", "eng"), ("f", "his"), ("f", "n"), ("z", "eng"), ("f", "z"))],
    ).first()
    assert tuple(row) == (True, False, False, True, True, False, True, False, True)


def test_scalar_or_list(one):
    got = one(*[nested.scalar_or_list(L(x).cast("string")) for x in ('["a","b"]', "plain", '{"a":1}', None, "12")])
    assert got == (["a", "b"], ["plain"], [], [], [])


def test_display(one):
    v = lambda x: L(x).cast("double")
    p = L("observed")
    assert one(
        display.stat_text(v(0.155), p, "percent"), display.stat_text(v(1234.5), p, "money"), display.stat_text(v(3.954), p, "decimal"),
        display.stat_text(v(1550), p, "score"), display.stat_text(v(25000), p, "number"), display.stat_text(v(None), p, "number"),
        display.stat_text(v(None), L("not_applicable"), "number"), display.stat_note(v(1), L("editorial")),
        display.stat_note(v(None), L("not_applicable")), display.tier_label(L("extreme_reach")), display.tier_label(L(None).cast("string")),
    ) == ("16%", "$1,235", "3.95", "1550", "25,000", "—", "n/a", "est.", "not used at this school", "Extreme reach", None)


def test_character_references_and_nested_noise(one):
    import html as stdlib

    cases = ["Jos&eacute; &#64; &#x40;&#X2013; &rsquo;s &amp;lt; &unknown; &notin; &", "&#150; &#0; &#xD800; &#1114112; &#99999999999; &#233 x", "plain", "&NotEqualTilde;&nbsp;z&copy;"]
    got = one(*(H.unescape(L(c)) for c in cases))
    assert list(got) == [stdlib.unescape(c).replace("\xa0", " ") for c in cases]
    pages = ["<body>a<header>b<nav>c</nav>d</header>e</body>", "<body>a<nav>b<nav>c</nav>d</nav>e</body>", "<body>a<footer>never closed <b>x</b></body>",
             "<body>a</nav>b<svg/>c<script>if (a < b) '<nav>'</script>d</body>", "<body>x<style>y</body>"]
    assert list(one(*(H.visible_text(L(p)) for p in pages))) == ["a e", "a e", "a", "a b c d", "x"]


_ANN = {"@type": "Person", "name": " Ann ", "jobTitle": "Prof", "worksFor": {"name": "Physics"}, "email": "MAILTO:a@x.edu", "telephone": "1"}
_FOUND = ("Ann", "Prof", "Physics", "a@x.edu", "1")


@pytest.mark.parametrize("scripts,expected", [
    ([_ANN], _FOUND),
    (["{bad", [[{"@graph": [{"@type": "Org"}, [{"@graph": [_ANN]}]]}]]], _FOUND),
    (["[" * 30 + json.dumps(_ANN) + "]" * 30], _FOUND),
    ([{"@graph": [{"@type": "Org"}]}, {"@graph": [{"@graph": []}, _ANN]}], _FOUND),
    ([[{"@type": "Person", "name": "First"}, _ANN]], ("First", None, None, None, None)),
    ([{"@graph": {"@type": "Person"}, "@type": ["X", "Person"], "name": 5, "affiliation": "Dept "}], (None, None, "Dept", None, None)),
    ([{"@type": "Person", "name": "B", "worksFor": "", "affiliation": {"name": "Chem"}}], ("B", None, "Chem", None, None)),
    ([{"@type": "Person", "name": "C", "worksFor": [{"name": "Q"}], "affiliation": "z"}], ("C", None, None, None, None)),
    ([{"mainEntity": _ANN}], (None,) * 5),
    (["7", '"Person"', "null", "", "[[]]"], (None,) * 5),
])
def test_nested_jsonld(one, scripts, expected):
    page = "".join(f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>' for x in scripts)
    (person,) = one(H.jsonld_person(L(page)))
    assert tuple(person) == expected


@pytest.mark.parametrize("html,text", [
    ('<p title="a > b">x</p>', "x"), ("<p title='a > b' data-y=\"c'>d\">x</p>y", "x y"), ("<p don't>x</p>", "x"), ("<P CLASS=a>x<BR/>y</P>", "x y"),
    ("a < b and c > d", "a d"), ("<div data-x='</nav>'><NAV a='>'>menu</NAV>z</div>", "z"), ("<p a=\"" + "q" * 20000 + ">\">x</p>", "x"),
])
def test_tags_with_quoted_values(one, html, text):
    assert one(H.visible_text(L(html))) == (text,)


def test_links_without_an_end_tag(one):
    (links,) = one(H.anchors(L("<A class=x HREF=/a>one <a href='/b?x=1>2' REL=next>two</A> rest <a href=\"/c\">three<p>more</p>")))
    assert [(a.href, a.text, a.rel) for a in links] == [("/a", "one", ""), ("/b?x=1>2", "two", "next"), ("/c", "three more", "")]


def test_meta_in_any_form(one):
    page = L("<META CONTENT='a > \"b\"' NAME = author><meta name=\"other\" content='name=author'><meta property='og:title' content=T>")
    assert one(H.meta_author(page), H.meta_name(page)) == ('a > "b"', "T")
