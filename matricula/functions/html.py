"""Reading HTML as text columns: visible text, anchors, hints, structured data.

Pages are scanned with linear regular expressions inside the JVM; the one
Python helper reads sitemap XML, where a parser is needed to tell a malformed
document from an empty one.
"""

from __future__ import annotations

from html import entities
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matricula import fixed_values as V
from matricula.functions.text import blank_to_null, collapse

_COMMENT = r"(?s)<!--.*?-->"
#: The inside of a tag: quoted values may hold `>`; possessive, so a tag is read once. A tag with an odd quote ends at its first `>`.
_QUOTED = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""
_TAG = rf"(?s)<(?:{_QUOTED}|[^>]*+)>"
_HEAD = rf"(?is)<head\b{_QUOTED}>.*?</head\s*>|<title\b{_QUOTED}>.*?</title\s*>"
_HEADING = rf"(?is)<h[1-6]\b{_QUOTED}>(.*?)</h[1-6]\s*>"
#: A link ends at its end tag, at the next link or with the page.
_ANCHOR = rf"(?is)<a\s({_QUOTED}|[^>]*+)>(.*?)(?:</a\s*>|(?=<a\s)|\z)"
_RAW_TEXT = ("script", "style")
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)"
#: Names of the HTML standard, without their semicolon.
_NAMED = {name[:-1]: value for name, value in entities.html5.items() if name.endswith(";")}
#: Looked up before all others.
_COMMON = {name: _NAMED[name] for name in ("amp", "lt", "gt", "quot", "apos", "nbsp")}
#: Numbers that stand for Windows-1252 bytes.
_WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _map(values: dict[str, str]) -> Column:
    """A constant map, folded to a literal by the optimizer."""
    return F.map_from_arrays(*(F.split(F.lit("\x1f".join(x)), "\x1f", -1) for x in (values.keys(), values.values())))


_JSONLD = r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _drop_blocks(html: Column, tags: tuple[str, ...]) -> Column:
    """Markup outside the elements of these tags, nested ones included.

    Scripts and styles hold no markup and end at their own end tag. For the others
    a depth runs over the start and end tags; an element never closed reaches to the end.
    """
    raw, nested = [t for t in tags if t in _RAW_TEXT], [t for t in tags if t not in _RAW_TEXT]
    if raw:
        html = F.regexp_replace(html, rf"(?is)<({'|'.join(raw)})\b{_QUOTED}>.*?(?:</\1\s*>|\z)", " ")
    if not nested:
        return html
    tag = rf"(?i)</?(?:{'|'.join(nested)})\b{_QUOTED}>"

    def outside(markup: Column) -> Column:
        found = F.regexp_extract_all(markup, F.lit(tag), F.lit(0))
        pieces = F.split(markup, tag, -1)
        start = F.struct(F.get(pieces, F.lit(0)).alias("text"), F.lit(0).alias("depth"))
        after = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        steps = F.zip_with(found, after, lambda t, p: F.struct(
            F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1).alias("by"), p.alias("text")))

        def step(seen: Column, s: Column) -> Column:
            depth = F.greatest(seen["depth"] + s["by"], F.lit(0))
            return F.struct(F.when(depth > 0, seen["text"]).otherwise(F.concat(seen["text"], F.lit(" "), s["text"])).alias("text"),
                            depth.alias("depth"))

        return F.when(F.size(found) == 0, markup).otherwise(F.aggregate(steps, start, step)["text"])

    return _bound(html, outside)


def unescape(text: Column) -> Column:
    """Named, decimal and hexadecimal character references decoded, once over; unknown names stay.

    Numbers follow the HTML rules: 128-159 are those of Windows-1252, and what is no
    character becomes U+FFFD. A non-breaking space becomes a space, as in all texts here.
    """

    def character(code: Column) -> Column:
        known = F.try_element_at(_map({str(k): v for k, v in _WINDOWS.items()}), code.cast("string"))
        fine = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.coalesce(known, F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), F.lit("\ufffd"))

    def decoded(reference: Column) -> Column:
        digits = F.regexp_extract(reference, "(?i)^&#x?0*([0-9a-f]{0,8})", 1)
        hexadecimal = F.lower(reference).startswith("&#x")
        number = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
        long = F.length(F.regexp_replace(reference, "^&#[xX]?0*|;$", "")) > 8
        name = F.substring(reference, F.lit(2), F.length(reference) - 2)  # named ones end in a semicolon
        return F.when(reference.startswith("&#"), F.when(long, F.lit("\ufffd")).otherwise(character(F.coalesce(number, F.lit(0))))).otherwise(
            F.coalesce(F.try_element_at(_map(_COMMON), name), F.try_element_at(_map(_NAMED), name), reference))

    def joined(t: Column) -> Column:
        pieces = F.split(t, _REFERENCE, -1)
        found = F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0)), decoded)
        both = F.zip_with(found, F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda c, p: F.concat(c, p))
        return F.when(t.contains("&"), F.replace(F.concat(F.get(pieces, F.lit(0)), F.array_join(both, "")), F.lit("\xa0"), F.lit(" "))).otherwise(t)

    return _bound(text, joined)


def tags_to_text(fragment: Column) -> Column:
    return collapse(unescape(F.regexp_replace(fragment, _TAG, " ")))


def body_markup(html: Column) -> Column:
    """Body markup without comments, head and noise elements."""
    return _drop_blocks(
        F.regexp_replace(F.regexp_replace(html, _COMMENT, " "), _HEAD, " "), V.NOISE_TAGS
    )


def visible_text(html: Column) -> Column:
    return tags_to_text(body_markup(html))


def excerpt(html: Column, max_chars: int | None = None) -> Column:
    """Headings, then link texts, then the remaining text; the first `max_chars` of it, if given."""
    markup = body_markup(html)

    def texts(pattern: str, group: int) -> Column:
        found = F.transform(F.regexp_extract_all(markup, F.lit(pattern), F.lit(group)), tags_to_text)
        return F.array_distinct(F.filter(found, lambda t: t != ""))

    headings, links = texts(_HEADING, 1), texts(_ANCHOR, 2)
    rest = tags_to_text(F.regexp_replace(F.regexp_replace(markup, _HEADING, " "), _ANCHOR, " "))
    whole = F.concat_ws(
        "\n",
        F.when(F.size(headings) > 0, F.concat(F.lit("Headings: "), F.array_join(headings, " | "))),
        F.when(F.size(links) > 0, F.concat(F.lit("Links: "), F.array_join(links, " | "))),
        F.when(rest != "", F.concat(F.lit("Text: "), rest)),
    )
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def attribute(attrs: Column, name: str) -> Column:
    raw = F.regexp_extract(attrs, rf"(?is)(?:^|\s){name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return unescape(F.regexp_replace(raw, "^[\"']|[\"']$", ""))


def anchors(html: Column) -> Column:
    """array<struct<href, text, rel>> of every `<a href>` outside comments and scripts."""
    markup = _drop_blocks(F.regexp_replace(html, _COMMENT, " "), ("script", "style"))
    pairs = F.arrays_zip(
        F.regexp_extract_all(markup, F.lit(_ANCHOR), F.lit(1)).alias("attrs"),
        F.regexp_extract_all(markup, F.lit(_ANCHOR), F.lit(2)).alias("inner"),
    )
    built = F.transform(
        pairs,
        lambda a: F.struct(
            F.trim(attribute(a["attrs"], "href")).alias("href"),
            tags_to_text(a["inner"]).alias("text"),
            attribute(a["attrs"], "rel").alias("rel"),
        ),
    )
    return F.filter(built, lambda a: a["href"] != "")


def usable_href(href: Column) -> Column:
    lowered = F.lower(href)
    skip = lowered.startswith("#")
    for prefix in V.IGNORED_SCHEMES:
        skip = skip | lowered.startswith(prefix)
    return ~skip


def looks_like_html(body: Column) -> Column:
    return F.lower(body).rlike("<html|<body|<!doctype html")


def soft_404(body: Column) -> Column:
    return F.lower(body).rlike("|".join(V.SOFT_404_MARKERS))


# ----------------------------------------------------------------- hints ----
def email_in_text(text: Column) -> Column:
    """First e-mail, after undoing the bracketed and upper-case AT/DOT disguises."""
    # Most texts hold no at-sign in any form; one scan settles them.
    suspect = text.contains("@") | text.rlike(r"\sAT\s|(?i)[\[(]\s*at\s*[\])]")
    plain = F.regexp_replace(text, V.BRACKET_AT, "@")
    plain = F.regexp_replace(plain, V.BRACKET_DOT, ".")
    plain = F.regexp_replace(plain, "(?U)" + V.BARE_AT, "@")
    plain = F.regexp_replace(plain, "(?U)" + V.BARE_DOT, ".")
    found = F.regexp_extract(plain, "(?U)" + V.EMAIL_PATTERN, 0)
    return F.when(suspect, F.nullif(found, F.lit("")))


def phone_in_text(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, V.PHONE_PATTERN, 0))


def first_mailto(links: Column) -> Column:
    def address(link: Column) -> Column:
        raw = F.trim(F.substring_index(link["href"].substr(F.lit(8), F.length(link["href"])), "?", 1))
        # a plus sign is literal here; a broken escape keeps the text as written
        return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)

    mails = F.filter(links, lambda a: F.lower(a["href"]).startswith("mailto:"))
    return F.get(F.filter(F.transform(mails, address), lambda m: m != ""), F.lit(0))


def first_tel(links: Column) -> Column:
    found = F.filter(
        F.transform(
            F.filter(links, lambda a: F.lower(a["href"]).startswith("tel:")),
            lambda a: F.trim(a["href"].substr(F.lit(5), F.length(a["href"]))),
        ),
        lambda t: t != "",
    )
    return F.get(found, F.lit(0))


def meta_content(html: Column, key: str, value: str) -> Column:
    """Content of the first `<meta key="value" content=...>`, attributes in either order."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)<meta\b({_QUOTED})/?>"), F.lit(1))
    named = F.filter(tags, lambda t: F.lower(F.trim(attribute(t, key))) == value)
    return blank_to_null(attribute(F.get(named, F.lit(0)), "content"))


def meta_author(html: Column) -> Column:
    return meta_content(html, "name", "author")


def meta_name(html: Column) -> Column:
    return F.coalesce(
        meta_content(html, "property", "og:title"),
        meta_author(html),
        meta_content(html, "name", "twitter:title"),
    )


def element_text(html: Column, tag: str) -> Column:
    return tags_to_text(F.regexp_extract(html, rf"(?is)<{tag}\b{_QUOTED}>(.*?)</{tag}\s*>", 1))


def parse_hint(html: Column) -> Column:
    """struct<name, title> guessed from `<h1>`, else `<title>`, split at the first comma."""
    h1, title = element_text(html, "h1"), element_text(html, "title")
    source = F.when(h1 != "", h1).otherwise(title)
    comma = F.locate(",", source)
    return F.struct(
        blank_to_null(F.substring_index(source, ",", 1)).alias("name"),
        F.when(
            comma > 0, blank_to_null(F.substring(source, comma + F.lit(1), F.length(source)))
        ).alias("title"),
    )


_VARIANTS = "array<variant>"


def _kind(value: Column) -> Column:
    """Type of a VARIANT value, an empty text for none."""
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _members(value: Column) -> Column:
    """Items of a JSON list, those of an object's `@graph` list, or the value itself."""
    graph = F.try_variant_get(value, '$["@graph"]', "variant")
    return (
        F.when(_kind(value).startswith("ARRAY"), F.try_variant_get(value, "$", _VARIANTS))
        .when(_kind(graph).startswith("ARRAY"), F.try_variant_get(graph, "$", _VARIANTS))
        .otherwise(F.array(value))
    )


def ld_objects(body: Column) -> Column:
    """array<variant> of the objects of a JSON-LD text, in their order: lists and `@graph` lists are followed into
    one another to any depth. Text that is no JSON has none."""
    parsed = F.try_parse_json(body)
    # each step opens one level; no text has more levels than opening brackets
    levels = F.sequence(F.lit(1), F.length(body) - F.length(F.replace(body, F.lit("["))) + 1)

    def step(seen: Column, _: Column) -> Column:
        nested = F.exists(seen, lambda v: _kind(v).startswith("ARRAY") | _kind(F.try_variant_get(v, '$["@graph"]', "variant")).startswith("ARRAY"))
        return F.when(nested, F.flatten(F.transform(seen, _members)).cast(_VARIANTS)).otherwise(seen)

    found = F.aggregate(levels, F.array(parsed).cast(_VARIANTS), step)
    return F.when(parsed.isNull(), F.array().cast(_VARIANTS)).otherwise(F.filter(found, lambda v: _kind(v).startswith("OBJECT")))


def _ld_text(value: Column, path: str) -> Column:
    """A text that is one in the JSON, not a number or a flag."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(_kind(found) == "STRING", blank_to_null(F.try_variant_get(found, "$", "string")))


def _ld_filled(value: Column, path: str) -> Column:
    """The value at a path, null when it is missing or empty."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(~F.coalesce(F.to_json(found), F.lit("null")).isin("null", '""', "{}", "[]", "0", "false"), found)


def jsonld_person(html: Column) -> Column:
    """First JSON-LD Person of a page, wherever lists and `@graph` lists hold it; bad JSON is skipped."""
    bodies = F.regexp_extract_all(html, F.lit(_JSONLD), F.lit(1))
    objects = F.flatten(F.transform(bodies, ld_objects))

    def is_person(value: Column) -> Column:
        types = F.try_variant_get(value, '$["@type"]', "variant")
        return (_ld_text(value, '$["@type"]') == "Person") | (
            _kind(types).startswith("ARRAY") & F.exists(
                F.try_variant_get(types, "$", _VARIANTS), lambda v: _ld_text(v, "$") == "Person"))

    def fields(person: Column) -> Column:
        employer = F.coalesce(_ld_filled(person, "$.worksFor"), _ld_filled(person, "$.affiliation"))
        return F.struct(
            _ld_text(person, "$.name").alias("name"),
            _ld_text(person, "$.jobTitle").alias("title"),
            F.coalesce(_ld_text(employer, "$.name"), _ld_text(employer, "$")).alias("department"),
            blank_to_null(F.regexp_replace(_ld_text(person, "$.email"), "(?i)^mailto:", "")).alias("email"),
            _ld_text(person, "$.telephone").alias("phone"),
        )

    people = F.filter(objects, lambda v: F.coalesce(is_person(v), F.lit(False)))
    return fields(F.get(people, F.lit(0)))


def grounded_email(value: Column, text: Column, hint: Column) -> Column:
    """A proposed e-mail survives only if the hint or the page text holds it."""
    candidate = F.trim(value)
    wellformed = candidate.rlike(f"(?U)^(?:{V.EMAIL_PATTERN})$")
    seen = F.coalesce(F.lower(hint) == F.lower(candidate), F.lit(False)) | F.lower(text).contains(
        F.lower(candidate)
    )
    return F.when(wellformed & seen, candidate)


def grounded_phone(value: Column, text: Column, hint: Column) -> Column:
    """Digit-wise grounding of a proposed phone number, seven digits at least."""

    def digits(c: Column) -> Column:
        return F.regexp_replace(c, r"\D", "")

    candidate, number = F.trim(value), digits(value)
    seen = F.coalesce(digits(hint) == number, F.lit(False)) | digits(text).contains(number)
    return F.when((F.length(number) >= 7) & seen, candidate)


# --------------------------------------------------------------- sitemaps ---
def sitemap_entries(xml: Column) -> Column:
    """struct<kind, locs> of a sitemap document; malformed XML is an empty urlset."""

    def read(doc: str | None) -> tuple[str, list[str]]:
        try:
            root = ElementTree.fromstring(doc or "")
        except ElementTree.ParseError:
            return "urlset", []
        names = ((node.tag.rsplit("}", 1)[-1], (node.text or "").strip()) for node in root.iter())
        locs = [text for tag, text in names if tag == "loc" and text]
        index = root.tag.rsplit("}", 1)[-1] == "sitemapindex"
        return ("sitemapindex" if index else "urlset"), locs

    def read_all(docs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(d) for d in docs], columns=["kind", "locs"])

    shape = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("locs", T.ArrayType(T.StringType())),
        ]
    )
    return F.pandas_udf(read_all, shape)(xml)
