"""URL functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import lexicon as L


def begins(pattern: str) -> str:
    """A cheap look ahead at three characters, for alternatives that begin with three letters or blanks each; empty for others."""
    parts = [re.match(r"[a-z ]{3}(?![?*+{])", p) for p in pattern.split("|")]
    return f"(?={''.join('[' + ''.join(sorted({p[0][k] for p in parts})) + ']' for k in range(3))})" if all(parts) else ""


def first_type(text: Column, types: dict[str, list[str]], default: str) -> Column:
    """The first type any of whose patterns is found; types stand in order."""
    out = None
    for name, patterns in types.items():
        hit = text.rlike(begins("|".join(patterns)) + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def host(url: Column) -> Column:
    """Host in lower case without ``www.``; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), r"^www\.", "")


def same_domain(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def url_type(url: Column, types: dict[str, list[str]] = L.URL_TYPES) -> Column:
    """Page type by patterns anywhere in the URL; null counts as empty."""
    return first_type(F.lower(F.coalesce(url, F.lit(""))), types, "other")


def is_pdf(url: Column) -> Column:
    low = F.lower(url)
    return low.endswith(".pdf") | low.contains("/pdf/") | low.contains("format=pdf")


def _without_dots(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments resolved."""
    empty = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(path, "/"),
        empty,
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.array_append(done, s)),
    )
    return F.array_join(parts, "/")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, although the body may name it often."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def base_parts(base: Column) -> Column:
    """What relative links need of a page's address: struct of ``scheme``, ``origin`` and ``folder``."""
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*/|/)?", 1)
    return F.struct(
        F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1).alias("scheme"),
        F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1).alias("origin"),
        let(folder, lambda f: F.when(f == "", F.lit("/")).otherwise(f)).alias("folder"),
    )


def absolute_url(link: Column, base: Column) -> Column:
    """As ``normalize_url``, with the ``base_parts`` of the page."""

    def absolute(link: Column, low: Column) -> Column:
        return (
            F.when(low.startswith("http://") | low.startswith("https://"), link)
            .when(low.startswith("//"), F.concat(F.when(base["scheme"] == "", F.lit("https")).otherwise(base["scheme"]), F.lit(":"), link))
            .when(low.startswith("/"), F.concat(base["origin"], link))
            .otherwise(F.concat(base["origin"], _without_dots(F.concat(base["folder"], F.regexp_replace(link, r"[?#].*$", "")))))
        )

    def cut(full: Column) -> Column:
        path = F.regexp_extract(full, r"^[A-Za-z]+://[^/]*(.*)$", 1)
        return F.when(path.isin("", "/"), full).otherwise(F.regexp_replace(full, "/+$", ""))

    def page(link: Column) -> Column:
        skip = link.isNull() | (link == "") | link.rlike("(?i)^(mailto:|tel:|javascript:|data:|#)")
        full = let(F.lower(link), lambda low: F.regexp_replace(absolute(link, low), r"[?#].*$", ""))
        return F.when(~skip, let(full, lambda f: F.nullif(cut(f), F.lit(""))))

    return let(F.trim(link), page)


def normalize_url(url: Column, base: Column) -> Column:
    """Absolute URL without query, fragment and trailing slash (a bare domain keeps its own); null for what is no page link."""
    return let(base_parts(base), lambda parts: absolute_url(url, parts))


def link_key(url: Column) -> Column:
    """What counts as one and the same link."""
    return F.lower(F.regexp_replace(url, "/+$", ""))


def link_score(url: Column, text: Column, weights: dict[str, int] | None = None) -> Column:
    """Sum of the weights of the keywords found in URL or link text, one more for two strong ones, 0 at least."""
    weights = weights or (L.LINK_HIGH | L.LINK_LANGUAGE | L.LINK_POSITIVE | L.LINK_NEGATIVE)

    def score(both: Column) -> Column:
        total = sum((F.when(both.contains(k), w).otherwise(0) for k, w in weights.items()), F.lit(0))
        strong = sum((both.contains(k).cast("int") for k in (L.LINK_HIGH | L.LINK_LANGUAGE)), F.lit(0))
        return F.greatest(total + (strong >= 2).cast("int"), F.lit(0))

    return let(F.lower(F.concat(url, F.lit(" "), F.coalesce(text, F.lit("")))), score)


def candidate_urls(base: Column, types: Column, most: int = L.CANDIDATES) -> Column:
    """Likely URLs of page types: beside, below, at the parent and root of ``base``, and as ``.html``; without repeats."""
    origin = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    beside = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z]+://[^/]*(?:/.*/|/)?)", 1)
    beside = F.when(beside.endswith("/"), beside).otherwise(F.concat(beside, F.lit("/")))
    below = F.when(base.rlike("[?#]"), beside).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/")))
    parent = F.when(path.contains("/"), F.concat(origin, F.regexp_replace(path, "/[^/]*$", ""), F.lit("/")))

    def of(t: Column) -> Column:
        html = F.when(~t.endswith(".html"), F.concat(beside, t, F.lit(".html")))
        made = F.array(F.concat(beside, t), F.concat(below, t), F.concat(parent, t), F.concat(origin, F.lit("/"), t), html)
        return F.filter(made, lambda u: u.isNotNull())

    return F.slice(F.array_distinct(F.flatten(F.transform(types, of))), 1, most)
