"""Expressions over listing texts and item variations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    COUNTRY_OF_ORIGIN,
    DESCRIPTION_BOILERPLATE,
    HANDMADE_NOTE,
    HANDMADE_NOTE_PATTERN,
    SECTION_HEADINGS,
    SECTION_STARTS,
    STORY_ENDS,
)
from .text import as_col, strip

VARIATION_FIELDS = ("size", "style", "color", "material")


def _last_part(field: str) -> str:
    """Pattern of the last part of a kind, its value as group 1; a key that names two kinds is of the first."""
    word = {"color": "colou?r"}
    before = "|".join(word.get(f, f) for f in VARIATION_FIELDS[: VARIATION_FIELDS.index(field)])
    first = rf"(?![^:;,]*(?:{before}))" if before else ""
    return rf"(?is)\A(?:.*[;,])?{first}[^:;,]*{word.get(field, field)}[^:;,]*:([^;,]*)"


def extract_variations(c: Column | str) -> Column:
    """``Size: L, Color: Red`` -> struct(size, style, color, material); the last part of a kind wins."""

    def names(field: str, text: Column) -> Column:
        return text.contains("color") | text.contains("colour") if field == "color" else text.contains(field)

    def is_kind(field: str, key: Column) -> Column:
        # a key that names two kinds is of the first
        others = [~names(f, key) for f in VARIATION_FIELDS[: VARIATION_FIELDS.index(field)]]
        return reduce(lambda a, b: a & b, others, names(field, key))

    low = F.lower(as_col(c))
    pairs = F.transform(
        F.filter(F.split(as_col(c), r"[;,]\s*", -1), lambda p: p.contains(":")),
        lambda p: F.struct(F.lower(F.substring_index(p, ":", 1)).alias("key"), p.alias("part")),
    )

    def last(pairs: Column, field: str) -> Column:
        mine = F.try_element_at(F.filter(pairs, lambda p: is_kind(field, p["key"])), F.lit(-1))["part"]
        value = strip(F.substr(mine, F.instr(mine, F.lit(":")) + 1))
        # the list is searched only for a kind that the text names anywhere
        return F.when(names(field, low), value).alias(field)

    def searched(field: str) -> Column:
        found = F.get(F.regexp_extract_all(as_col(c), F.lit(_last_part(field)), F.lit(1)), F.lit(0))
        return F.when(names(field, low), strip(found)).alias(field)

    # the one element is the list of pairs: as a variable it is built once, not once for each field
    listed = F.transform(F.array(pairs), lambda ps: F.struct(*[last(ps, f) for f in VARIATION_FIELDS]))[0]
    # a lambda is interpreted: in short texts of ASCII the part is searched by a pattern
    plain = as_col(c).rlike(r"\A[\x00-\x7f]{0,2000}\z")
    return F.when(plain, F.struct(*[searched(f) for f in VARIATION_FIELDS])).otherwise(listed)


def clean_description(c: Column | str) -> Column:
    """Whole text, line by line: trimmed, blank and boilerplate lines dropped. Null gives an empty text."""
    lines = F.transform(F.split(F.coalesce(as_col(c), F.lit("")), "\n", -1), lambda line: strip(line))

    def keep(line: Column) -> Column:
        wanted = line != ""
        for phrase in DESCRIPTION_BOILERPLATE:
            wanted = wanted & ~line.contains(phrase)
        return wanted

    return F.array_join(F.filter(lines, keep), "\n")


_SECTION_END = r"(?=\n\s*(?:" + "|".join(SECTION_STARTS) + r")|\s*$)"
_STORY_END = "(?im)^(?:" + "|".join(STORY_ENDS) + ")"


def _section(text: Column, heading: str) -> Column:
    body = F.regexp_extract(text, "(?ism)^" + heading + "(.*?)" + _SECTION_END, 1)
    return F.replace(strip(body), F.lit("\n"), F.lit(" "))


def parse_listing_description(c: Column | str) -> Column:
    """Cleaned description -> struct of 11 fields; a missing section is an empty text."""
    text = as_col(c)
    fields = {}
    for name, headings in SECTION_HEADINGS.items():
        found = [F.when(text.rlike("(?im)^" + h), _section(text, h)) for h in headings]
        fields[name] = F.coalesce(*found, F.lit(""))
    fields["note"] = F.when(text.rlike("(?im)^" + HANDMADE_NOTE_PATTERN), F.lit(HANDMADE_NOTE)).otherwise(F.lit(""))
    head = F.split(text, _STORY_END, 2).getItem(0)
    story_lines = F.filter(F.transform(F.split(head, "\n", -1), lambda line: strip(line)), lambda line: line != "")
    fields["story"] = F.array_join(story_lines, "\n")
    fields["country"] = F.lit(COUNTRY_OF_ORIGIN)
    order = ("story", *SECTION_HEADINGS, "note", "country")
    return F.when(text.isNotNull(), F.struct(*[fields[n].alias(n) for n in order]))
