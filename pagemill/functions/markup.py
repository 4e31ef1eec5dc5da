"""Anchors and entities of HTML as column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.urls import let

#: What holds no links: comments, and elements whose text is no markup.
NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
#: Attributes of a tag up to its end; quoted values may hold what would end it.
ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
#: An anchor with its text, which ends with it or where another begins.
ANCHOR = rf"(?is)<a(?=[\s/])({ATTRIBUTES})>(.*?)(?=</a\s*>|<a[\s/]|\z)"
#: The first ``href`` among attributes, passing over others with their values.
_VALUE = r"""("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
HREF = rf"""(?is)^(?:[\s/"']++(?!href[\s=])[^\s/=>"']++(?:\s*+=\s*+{_VALUE})?+)*+[\s/"']++href\s*+=\s*+{_VALUE}"""
ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,10});"
#: Blanks around a piece of text.
ENDS = r"(?U)^\s+|\s+$"


def _character(entity: Column) -> Column:
    """The character of an entity without ``&`` and ``;``; null for one that is not known."""
    names = name2codepoint | {"apos": 39}
    known = F.create_map(*(F.lit(x) for name, code in names.items() for x in (name, chr(code))))
    code = F.when(entity.rlike("^#[xX]"), F.conv(F.substring(entity, 3, 8), 16, 10)).otherwise(F.substring(entity, 2, 8)).try_cast("long")
    fits = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    point = F.decode(F.unhex(F.lpad(F.hex(F.when(fits, code)), 8, "0")), "UTF-32")
    return F.when(entity.startswith("#"), point).otherwise(F.try_element_at(known, entity))


def unescaped(text: Column) -> Column:
    """Text with its entities replaced: numbers, and the names of HTML 4; others stay as they are."""

    def replaced(t: Column) -> Column:
        one = lambda e: F.coalesce(_character(F.regexp_extract(e, ENTITY, 1)), e)
        joined = F.zip_with(F.split(t, ENTITY), F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)), lambda a, e: F.concat(a, F.coalesce(one(e), F.lit(""))))
        return F.when(t.rlike(ENTITY), F.array_join(joined, "")).otherwise(t)

    return let(text, replaced)


def anchors(html: Column) -> Column:
    """The anchors of a page that have an address, in order: array of ``href`` and ``text``, entities replaced; null for a null page.

    Values may be in double, single or no quotes. Comments, scripts and styles hold no anchors. The text is that of all pieces
    between tags, each without blanks around it, put together.
    """

    def anchor(a: Column) -> Column:
        given = F.regexp_extract(F.regexp_extract(a, ANCHOR, 1), HREF, 2)
        pieces = F.transform(F.split(F.regexp_extract(a, ANCHOR, 2), "(?s)<[^>]*>"), lambda p: F.regexp_replace(unescaped(p), ENDS, ""))
        bare = let(given, lambda v: F.when(v.rlike("""^["']"""), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v))
        return F.struct(F.when(given != "", F.regexp_replace(unescaped(bare), ENDS, "")).alias("href"), F.array_join(pieces, "").alias("text"))

    found = F.transform(F.regexp_extract_all(F.regexp_replace(html, NO_MARKUP, ""), F.lit(ANCHOR), F.lit(0)), anchor)
    return F.filter(found, lambda a: a["href"].isNotNull())
