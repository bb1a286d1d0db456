"""Column functions on HTML text: tokens, then text, attributes and elements from them, then entities.

A page is cut from left to right into comments, scripts and the like with all they hold, tags and text. A tag ends
at the first `>` outside its quoted values; where a quote never ends, at the first `>` at all. Elements are found
by a fold over the tokens with the stack of open elements: void elements are not stacked, an end tag closes what was
opened since its start tag, an end tag without one closes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import bind, strip

# What is markup. Within a tag each character can be read in one way only, so nothing is tried twice (`*+`),
# and a tag that does not end is given up in linear time; then the simpler form of a tag is tried.
_PLAIN = r"[^>\"'=]*"
_BODY = rf"{_PLAIN}(?:=\s*(?:\"[^\"]*\"|'[^']*'|){_PLAIN})*+"
HIDDEN = (r"<!--.*?(?:-->|\z)" + "".join(
    rf"|<{name}(?:[\s/]{_BODY})?>.*?(?:</{name}\s*>|\z)" for name in ("script", "style", "template")) + r"|<![^>]*>|<\?[^>]*>")
TAG = rf"</?[a-z]{_BODY}>|</?[a-z][^>]*>"
TOKEN = rf"(?is){HIDDEN}|{TAG}|[^<]+|<"
TAG_NAME = r"^</?([a-zA-Z][^\s/>]*)"
ATTRIBUTE = r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Every named character of the HTML standard that ends with a semicolon.
ENTITIES = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
LONGEST = max(map(len, ENTITIES))
#: Looked up first, as a map is searched from its start.
COMMON = ("amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "middot", "ndash", "mdash")


def decode_entities(text: Column) -> Column:
    """Named and numeric characters, each decoded once.

    The text is cut at every `&`; a piece that starts with a known name or a
    number gets its character, any other gets its `&` back.
    """
    def named(entities: dict[str, str]) -> Column:
        return F.from_json(F.lit(json.dumps(entities)), "map<string,string>")

    few, all_ = named({name: ENTITIES[name] for name in COMMON}), named(ENTITIES)

    def char(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def number(name: Column) -> Column:
        hexed = F.conv(F.substr(name, F.lit(3)), 16, 10)
        code = F.when(name.rlike("^#[0-9]{1,7}$"), F.substr(name, F.lit(2))).when(
            name.rlike("^#[xX][0-9a-fA-F]{1,6}$"), hexed).cast("bigint")
        return F.when(code.between(1, 55295) | code.between(57344, 1114111), char(code))

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, f"^(#?[A-Za-z0-9]{{1,{LONGEST}}});", 1)
        found = F.when(name.startswith("#"), number(name)).when(name != "", F.coalesce(
            F.try_element_at(few, name), F.try_element_at(all_, name)))
        return bind(found, lambda c: F.when(
            c.isNotNull(), F.concat(c, F.substr(p, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), p)))

    def joined(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""))

    return bind(F.split(text, "&"), joined)


def tokens(html: Column) -> Column:
    """The page in pieces: markup and text, in order; together they are the page."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def _is_text(token: Column) -> Column:
    return ~F.regexp_like(token, F.lit("(?i)^<[/a-z!?]"))


def page_text(html: Column) -> Column:
    """Visible text: no scripts, styles, comments or tags; entities decoded."""
    return decode_entities(F.regexp_replace(html, f"(?is){HIDDEN}|{TAG}", ""))


def attributes(tag: Column) -> Column:
    """map<name, value> of a tag: names in small letters, values decoded; the last of equal names counts."""
    found = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))
    pairs = F.transform(found, lambda a: F.struct(
        F.lower(F.regexp_extract(a, ATTRIBUTE, 1)).alias("name"),
        decode_entities(F.concat(*[F.regexp_extract(a, ATTRIBUTE, i) for i in (2, 3, 4)])).alias("value")))
    return bind(pairs, lambda p: F.map_from_entries(F.filter(p, lambda x, i: ~F.exists(
        F.slice(p, i + 2, F.size(p)), lambda later: later["name"] == x["name"]))))


def element_text(page: Column, name: str, ends_at: Sequence[str] = ()) -> Column:
    """Text of the first element of a name in a page's tokens, each text node stripped; null without one.

    It ends with its end tag, with that of an element around it, or with any tag named in `ends_at`.
    """
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("inside"),
                     F.array().cast("array<string>").alias("texts"), F.lit(False).alias("done"))

    def tag(state: Column, token: Column, tag_name: Column) -> Column:
        place = F.array_position(F.reverse(state["open"]), tag_name)
        ends, empty = F.startswith(token, F.lit("</")), F.endswith(token, F.lit("/>")) | tag_name.isin(*VOID)
        found = ~ends & (state["inside"] == 0) & (tag_name == name)
        stack = F.when(ends & (place > 0), F.slice(state["open"], F.lit(1), F.size(state["open"]) - place.cast("int"))).when(
            ends | empty, state["open"]).otherwise(F.concat(state["open"], F.array(tag_name)))
        depth = F.when(found, F.size(state["open"]) + 1).otherwise(state["inside"])
        stops = (state["inside"] > 0) & tag_name.isin(*ends_at) if ends_at else F.lit(False)
        return bind(stack, lambda s: F.struct(s.alias("open"), depth.alias("inside"), state["texts"].alias("texts"),
                                              (stops | ((depth > 0) & (F.size(s) < depth))).alias("done")))

    def step(state: Column, token: Column) -> Column:
        text = F.struct(state["open"].alias("open"), state["inside"].alias("inside"),
                        F.concat(state["texts"], F.array(token)).alias("texts"), F.lit(False).alias("done"))
        tag_name = F.lower(F.regexp_extract(token, TAG_NAME, 1))
        return F.when(state["done"], state).when(_is_text(token), F.when(state["inside"] > 0, text).otherwise(state)).otherwise(
            bind(tag_name, lambda t: F.when(t == "", state).otherwise(tag(state, token, t))))

    def finished(state: Column) -> Column:
        return F.when(state["inside"] > 0, F.array_join(F.transform(state["texts"], lambda t: strip(decode_entities(t))), ""))

    # A script or the like is one token that begins as a tag does: it opens nothing.
    seen = F.filter(page, lambda t: ~F.regexp_like(t, F.lit(r"(?is)^<(?:script|style|template)[\s/>]")))
    return F.aggregate(seen, start, step, finished)


def title_tag(page: Column) -> Column:
    return element_text(page, "title")


def first_h1(page: Column) -> Column:
    return element_text(page, "h1")


def first_b(page: Column) -> Column:
    """First bold text; an unclosed one ends at the next break or paragraph."""
    return element_text(page, "b", ("br", "p"))


def _meta(page: Column, attribute: str, value: str) -> Column:
    """The content of the first <meta> tag whose attribute has the value; null without one."""
    tags = F.transform(F.filter(page, lambda t: F.regexp_like(t, F.lit(r"(?i)^<meta[\s/]"))), attributes)
    fitting = F.filter(tags, lambda m: F.coalesce(F.try_element_at(m, F.lit(attribute)) == value, F.lit(False)))
    return F.try_element_at(F.get(fitting, F.lit(0)), F.lit("content"))


def meta_description(page: Column) -> Column:
    return _meta(page, "name", "description")


def og_title(page: Column) -> Column:
    return _meta(page, "property", "og:title")


def best_title(*candidates: Column) -> Column:
    """Candidates of none or several words, joined by ' - '; null when none is left."""
    kept = F.filter(F.array(*candidates), lambda c: c.isNotNull() & (c != "") & (
        F.regexp_count(c, F.lit(r"\S+")) != 1))
    return F.nullif(F.array_join(kept, " - "), F.lit(""))
