"""Names and markup: normal forms, suffixes, HTML and escape handling, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.values import once

# What must be the same wherever names are matched.
#: Vendors that stand before a colon.
COLON_VENDORS = ("openai", "anthropic", "google", "moonshotai", "z.ai")
#: Spellings of organisations, replaced wherever they stand.
ORGANISATIONS = (("moonshot ai", "moonshot"), ("z ai", "zai"))
#: Endings that a name may lose, in the order in which they are tried.
SUFFIXES = ("non reasoning", "reasoning", "thinking", "adaptive", "preview", "latest", "default", "medium", "high", "low", "max", "xhigh")
#: Named character references.
ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "))
#: Vendors and their other spellings.
VENDORS = {
    "openai": (), "anthropic": (), "google": (), "moonshot": ("moonshotai",), "zai": ("z-ai", "z.ai"), "xai": (), "alibaba": (), "deepseek": (),
    "mistral": (), "meta": (), "minimax": (), "nvidia": (), "baidu": (), "tencent": (), "inclusionai": (), "xiaomi": (),
}
# End of the fixed values.

#: A character reference behind its ``&``: a name, or a number in decimal or hexadecimal.
REFERENCE = "^(?:(amp|" + "|".join(name for name, _ in ENTITIES) + ")|#[+]?0*([0-9]+)|#[xX][+]?0*([0-9a-fA-F]+));"


def character(code: Column) -> Column:
    """The character of a code point; NULL for what is none."""
    known = (code >= 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def html_unescape(s: Column) -> Column:
    """Named references, and numbered ones to any character, in one pass from left to right: what comes out is never read again."""

    def put(part: Column, i: Column) -> Column:
        name, decimal, hexed = (F.regexp_extract(part, REFERENCE, k) for k in (1, 2, 3))
        named = F.when(name == "amp", "&")
        for entity, char in ENTITIES:
            named = named.when(name == entity, char)
        code = F.when((decimal != "") & (F.length(decimal) < 8), decimal).when((hexed != "") & (F.length(hexed) < 7), F.conv(hexed, 16, 10)).cast("long")
        rest = F.substring(part, F.locate(";", part) + 1, F.length(part))
        return F.when(i == 0, part).otherwise(F.coalesce(F.concat(F.coalesce(named, character(code)), rest), F.concat(F.lit("&"), part)))

    return once(s, lambda t: F.when(t.contains("&"), F.array_join(F.transform(F.split(t, "&"), put), "")).otherwise(t))


def html_escape(s: Column) -> Column:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(char), F.lit(ref))
    return s


def normalize_name(s: Column) -> Column:
    """Lower-case words of ASCII letters and digits, one blank apart; a point stays between digits."""
    s = F.trim(F.lower(html_unescape(s)))
    for vendor in COLON_VENDORS:
        s = F.replace(s, F.lit(f"{vendor}:"), F.lit(f"{vendor} "))
    s = F.regexp_replace(s, r"(?<![0-9])[.]|[.](?![0-9])", " ")
    s = F.trim(F.regexp_replace(s, r"[^a-z0-9.]+", " "))
    for spelling, short in ORGANISATIONS:
        s = F.replace(s, F.lit(spelling), F.lit(short))
    return s


def alphanumeric(normal: Column) -> Column:
    return F.regexp_replace(normal, "[^a-z0-9]", "")


def compact_key(s: Column) -> Column:
    return alphanumeric(normalize_name(s))


def strip_suffix(normal: Column) -> Column:
    """A normal name without its last known ending; NULL if it has none or is one itself."""
    ending = "|".join(map(re.escape, sorted(SUFFIXES, key=len, reverse=True)))
    rest = F.regexp_extract(normal, f"^(.+?) (?:{ending})$", 1)
    return F.when(~normal.isin(*SUFFIXES) & (rest != ""), rest)


def stripped_forms(normal: Column) -> Column:
    """The name without one ending, two, and so on, as an array. Each takes a word off, so there are no more than words."""

    def all_of(name: Column) -> Column:
        def further(forms: Column, _: Column) -> Column:
            last = F.coalesce(F.try_element_at(forms, F.lit(-1)), name)
            return once(strip_suffix(last), lambda one: F.when(one.isNotNull(), F.concat(forms, F.array(one))).otherwise(forms))

        return F.aggregate(F.split(name, " "), F.array().cast("array<string>"), further)

    return F.coalesce(once(normal, all_of), F.array().cast("array<string>"))


def contains_phrase(normal: Column, phrase: str) -> Column:
    """Whether whole words of a normal text are ``phrase``."""
    return F.concat(F.lit(" "), normal, F.lit(" ")).contains(f" {phrase} ")


def extract_model(s: Column) -> Column:
    """Without a date in brackets at the end, what stands after the last ' + '."""
    s = F.regexp_replace(F.trim(s), r"\s*\(\s*[0-9]{4}-[0-9]{2}-[0-9]{2}\s*\)$", "")
    return F.when(s.contains(" + "), F.trim(F.substring_index(s, " + ", -1))).otherwise(s)


def parse_accuracy(s: Column) -> Column:
    """82.0 of '82.0% ± 2.2'."""
    from plumbline.functions.values import finite, number_like

    return finite(number_like(F.trim(F.rtrim(F.trim(F.substring_index(s, "±", 1)), F.lit("%"))), trim=True))


def cell_text(s: Column) -> Column:
    """Text of an HTML cell: no tags, one blank between words, no blank of any script at the ends."""
    words = F.regexp_replace(html_unescape(F.regexp_replace(s, "<[^>]*>", "")), r"[\t\n\f\r ]+", " ")
    return F.regexp_replace(words, r"^\p{Zs}+|(?<!\p{Zs})\p{Zs}+\z", "")


def unescape_once(s: Column) -> Column:
    r"""One layer of ``\"`` and ``\\`` off, from left to right."""
    return F.regexp_replace(s, r'\\(["\\])', "$1")


def attr_values(html: Column, attr: str) -> Column:
    """Texts between ``attr="`` and the next quote."""
    return F.regexp_extract_all(html, F.lit(f'{attr}="([^"]*)"'), F.lit(1))


def display_name(canonical_id: Column) -> Column:
    return F.substring_index(canonical_id, "/", -1)


def vendor_of_id(s: Column) -> Column:
    return F.nullif(F.substring_index(s, "/", 1), F.lit(""))


def vendor_name(s: Column) -> Column:
    """The usual spelling of a vendor; unknown ones in lower case."""
    low = F.lower(s)
    out = low
    for name, others in VENDORS.items():
        if others:
            out = F.when(low.isin(*others), name).otherwise(out)
    return out


def name_in_vendor(canonical_id: Column) -> Column:
    """The second part of vendor/name, or all of it."""
    return F.coalesce(F.try_element_at(F.split(canonical_id, "/"), F.lit(2)), canonical_id)


def tokens(normal: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: t != ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard of the words of two normal names; two empty ones are alike."""
    a, b = tokens(a), tokens(b)
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)
