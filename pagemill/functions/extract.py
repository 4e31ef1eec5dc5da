"""Rule-based extraction of admission facts from text, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import lexicon as L
from pagemill.functions.urls import let


_AMOUNT = r"\s*[\d,]+(?:\.\d{1,2})?"
_UNIT = r"\s*+(?:year|month|semester|term)s?"
_LABEL = r"(?i)[dca][elp][aop](?:(?<=dea)dline|(?<=clo)sing\s+date|(?<=app)(?:ly\s+by|lications?\s+(?:close|due|by)))[^.]{0,120}?(?=\d|[jfmasond][aepuco][nbrylgptvc])"
_FEE_WORDS = r"[tfcrp][ueohra][ieast](?<=tui|fee|cos|cha|rat|pri|cre)(?:(?<=tui)tion|(?<=fee)|(?<=cos)t|(?<=cha)rge|(?<=rat)e|(?<=pri)ce|(?<=cre)dit\s+hour)"
_DOMESTIC_WORDS = r"[uhdria][koenr](?:[ms\-k](?<=hom|dom|res|in-|ark)(?:(?<=hom)e|(?<=dom)estic|(?<=res)ident|(?<=in-)state|(?<=ark)ansas\s+resident)|(?<=uk))"
_INTERNATIONAL_WORDS = r"[ionf][nvou][tenr](?<=int|ove|non|out|for)(?:(?<=int)ernational|(?<=ove)rseas|(?<=non)-(?:EU|UK|resident)|(?<=out)-of-state|(?<=for)eign\s+student)"
#: Patterns that find the same but take the characters they begin with by classes, one after the other, before they tell the words apart: most places of a text
#: fail at the first class, where an alternation or a look ahead costs several steps. Numbers are taken whole, as what follows them is no digit.
BEGINS = {
    L.IELTS_BAND: (
        r"(?i)[nma][oit][\sn](?:(?<=no\s)\s*+(?:band|component|skill)\s+(?:below|less\s+than)|(?<=min)imum\s+(?:of\s+)?|(?<=at\s)\s*+least\s+)\d\.\d"
        r"(?:\s+in\s+(?:each|any|all|writing|reading|listening|speaking))?"
    ),
    L.FEE: (
        rf"(?i)(?:[£€$]{_AMOUNT}|[\d,]++(?:\.\d\d?+)?+\s*+(?:[£€$]|USD|GBP|CAD|AUD|NZD|SGD|HKD)"
        rf"|[ugcanshdji][sbauzgkheopn][dpfkyr](?<=usd|gbp|cad|aud|nzd|sgd|hkd|chf|sek|nok|dkk|jpy|cny|inr){_AMOUNT})"
        r"(?:\s*(?:per\s+(?:year|annum|semester|credit(?:\s+hour)?|module)|/year|/credit|p\.a\.|annually))?"
    ),
    L.FEE_CONTEXT: rf"(?i){_FEE_WORDS}[^\n]{{0,250}}",
    L.DOMESTIC_CONTEXT: rf"(?i){_DOMESTIC_WORDS}[^\n]{{0,200}}",
    L.INTERNATIONAL_CONTEXT: rf"(?i){_INTERNATIONAL_WORDS}[^\n]{{0,200}}",
    L.DURATION: (
        rf"(?i)[\dotfse](?:[nwhoi][eoruvxg](?<=one|two|thr|fou|fiv|six|twe|eig)(?:(?<=one|two|six)|(?<=twe)(?:lve|nty.four)|(?<=thr)ee|(?<=fou)r|(?<=fiv)e|(?<=eig)hteen){_UNIT}"
        rf"|(?<=\d)\d*+(?:\.\d++)?+(?:{_UNIT}|\s*+(?:-|to)\s*+\d++(?:\.\d++)?+{_UNIT}))"
        r"(?:\s*(?:full.time|part.time|of\s+study|programme|program|course))?"
    ),
    L.GPA: r"(?i)g[pr]a(?:(?<=gpa)|(?<=gra)de\s+point\s+average)[^.]{0,60}?\d\.\d+\s*(?:/\s*4\.0|out\s+of\s+4)?",
    L.UK_GRADE: (
        r"(?i)[f2ult][i:poh][r12pwi](?:(?<=fir)st.class|(?<=2:[12])|(?<=upp)er\s+second|(?<=low)er\s+second|(?<=thi)rd.class)"
        r"(?:\s+honours)?(?:\s+degree)?(?:[^.]{0,40}?\d+%)?"
    ),
    L.DEADLINE: _LABEL + L.DATE,
}


def quick(pattern: str) -> str:
    """The same matches in fewer steps, if ``BEGINS`` has the pattern; groups within may be lost."""
    return BEGINS.get(pattern, pattern)


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(quick(pattern)), F.lit(0))


def first_match(text: Column, pattern: str) -> Column:
    """First match, trimmed; null if there is none."""
    return let(F.trim(F.regexp_extract(text, quick(pattern), 0)), lambda m: F.when(m != "", m))


def distinct_matches(text: Column, pattern: str, most: int = 3) -> Column:
    return F.slice(F.array_distinct(F.transform(all_matches(text, pattern), lambda x: F.trim(x))), 1, most)


def ielts(text: Column) -> Column:
    """First overall score, with the first band score of the whole text."""
    with_band = lambda overall: let(first_match(text, L.IELTS_BAND), lambda band: F.concat(overall, F.coalesce(F.concat(F.lit(", no band below "), F.regexp_extract(band, r"\S+$", 0)), F.lit(""))))
    return let(first_match(text, L.IELTS), lambda overall: F.when(overall.isNotNull(), with_band(overall)))


#: ``TOEFL_TABLE`` without going back in cells, which hold no bar.
_TABLE = L.TOEFL_TABLE.replace("[^|]*", "[^|]*+").replace("[^|]+", "[^|]++")


def toefl(text: Column) -> Column:
    """Scores of a band table if there is one, else the first mention."""
    head = F.lit("TOEFL iBT: ")

    def scores(before: Column, after: Column) -> Column:
        return (
            F.when((before != "") & (after != ""), F.concat(head, before, F.lit(" (before Jan 2026) or "), after, F.lit(" (after Jan 2026)")))
            .when(before != "", F.concat(head, before))
            .when(after != "", F.concat(head, after))
        )

    row = F.regexp_extract(text, _TABLE, 0)
    cells = lambda r: F.when(r != "", scores(*(F.trim(F.regexp_extract(r, _TABLE, k)) for k in (1, 2))))
    table = F.when(text.contains("|"), let(row, cells))
    return F.coalesce(table, first_match(text, L.TOEFL))


def fee_amounts(text: Column) -> Column:
    """Amounts near words about fees; failing these, up to four amounts anywhere. Empty if there are none."""
    near = distinct_matches(text, L.FEE_CONTEXT, 8)
    amounts = F.array_distinct(F.flatten(F.transform(near, lambda c: F.transform(all_matches(c, L.FEE), lambda x: F.trim(x)))))
    return let(amounts, lambda a: F.when(F.size(a) > 0, a).otherwise(distinct_matches(text, L.FEE, 4)))


def labelled_fee(text: Column, context: str) -> Column:
    """First amount in the first three places that the label introduces."""
    amounts = F.transform(distinct_matches(text, context, 3), lambda c: F.trim(F.regexp_extract(c, quick(L.FEE), 0)))
    return F.get(F.filter(amounts, lambda a: a != ""), 0)


#: What stands at the end of a match of ``DEADLINE`` as one group.
_DEADLINE_DATE = f"{_LABEL}({L.DATE})"


def deadlines(text: Column, most: int = 3) -> Column:
    dates = F.transform(F.regexp_extract_all(text, F.lit(_DEADLINE_DATE), F.lit(1)), lambda d: F.trim(d))
    return F.slice(F.array_distinct(dates), 1, most)


def _some(array: Column) -> Column:
    return let(array, lambda a: F.when(F.size(a) > 0, a))


#: How each finding is looked for.
FINDINGS = {
    "ielts": ielts,
    "toefl": toefl,
    "pte": lambda t: first_match(t, L.PTE),
    "duolingo": lambda t: first_match(t, L.DUOLINGO),
    "fee_amounts": lambda t: _some(fee_amounts(t)),
    "domestic_fee": lambda t: labelled_fee(t, L.DOMESTIC_CONTEXT),
    "international_fee": lambda t: labelled_fee(t, L.INTERNATIONAL_CONTEXT),
    "duration": lambda t: first_match(t, L.DURATION),
    "gpa": lambda t: F.coalesce(first_match(t, L.GPA), first_match(t, L.UK_GRADE)),
    "deadlines": lambda t: _some(deadlines(t)),
}
#: What ``fill_english`` and ``fill_fees`` take from findings.
ENGLISH_GAPS = ("ielts", "toefl", "pte")
FEE_GAPS = ("domestic_fee", "international_fee", "fee_amounts")


def hints(text: Column, names: Iterable[str] = FINDINGS, given: dict[str, Column] | None = None) -> Column:
    """The named findings as one struct, which is made once although a query may name its fields often; null where nothing is found.

    Each finding is a search of its own and the struct is made whole, so a query names the findings that it shows. Where a value of ``given``
    is neither null nor empty, the finding of its name is not looked for.
    """
    given = given or {}
    missing = lambda n: F.nullif(given[n], F.lit("")).isNull()
    finding = lambda n, t: F.when(missing(n), FINDINGS[n](t)) if n in given else FINDINGS[n](t)
    return let(text, lambda t: F.struct(*(finding(n, t).alias(n) for n in names)))


TELLING = ("program", "course", "admission", "requirement")


def _windows(text: Column, headers: Column, width: int) -> Column:
    """What stands from each header's first place on, joined by line ends."""
    found = F.filter(headers, lambda h: text.contains(h))
    return F.array_join(F.transform(found, lambda h: F.substring(text, F.position(h, text), F.lit(width))), "\n")


def section_text(text: Column, headers: Column, wanted: tuple[str, ...] = TELLING, width: int = 2000) -> Column:
    """What stands after the headers: ``width`` characters from each one's first place, telling headers first."""
    telling = lambda h: F.lower(h).rlike("|".join(wanted))
    return _windows(text, F.concat(F.filter(headers, telling), F.filter(headers, lambda h: ~telling(h))), width)


def section_hints(text: Column, headers: Column, wanted: tuple[str, ...] = TELLING, width: int = 2000) -> Column:
    """``hints`` of the windows after telling headers, gaps filled from those after the others; where both give nothing, of the whole text."""
    telling = lambda h: F.lower(h).rlike("|".join(wanted))
    groups = (F.filter(headers, telling), F.filter(headers, lambda h: ~telling(h)))
    first, then = (let(_windows(text, g, width), lambda t: F.when(t != "", hints(t))) for g in groups)
    names = list(L.HINT_LINES)
    both = let(first, lambda a: let(then, lambda b: F.struct(*(F.coalesce(a[n], b[n]).alias(n) for n in names))))
    empty = lambda x: F.coalesce(*(x[n].cast("string") for n in names)).isNull()
    return F.when(F.size(headers) > 0, let(both, lambda x: F.when(empty(x), hints(text)).otherwise(x))).otherwise(hints(text))


def hint_lines(h: Column) -> Column:
    """Findings as lines of text; empty without any."""
    separators = {"fee_amounts": ", ", "deadlines": "; "}
    value = lambda n: F.array_join(h[n], separators[n]) if n in separators else h[n]
    some = F.filter(F.array(*(F.concat(F.lit(label), value(n)) for n, label in L.HINT_LINES.items())), lambda x: x.isNotNull())
    return let(some, lambda x: F.when(F.size(x) == 0, "").otherwise(F.concat_ws("\n", F.lit(L.HINT_HEAD), F.array_join(x, "\n"), F.lit(L.HINT_TAIL))))


def currency(amounts: Column) -> Column:
    """Currency of the last amount that shows one."""
    codes = F.transform(amounts, lambda a: F.coalesce(*(F.when(a.contains(s), code) for s, code in L.CURRENCIES.items())))
    return F.try_element_at(F.filter(codes, lambda c: c.isNotNull()), F.lit(-1))


def fill_english(english: Column, h: Column) -> Column:
    """Test scores, with gaps filled from findings; a TOEFL finding must have ten characters and a number."""
    given = lambda k: F.nullif(english[k], F.lit(""))
    good = F.when((F.length(h["toefl"]) >= 10) & h["toefl"].rlike(r"\d{2,3}"), h["toefl"])
    out = F.struct(
        F.coalesce(given("ielts"), h["ielts"]).alias("ielts"),
        F.coalesce(given("toefl"), good).alias("toefl"),
        F.coalesce(given("pte"), h["pte"]).alias("pte"),
        english["duolingo"].alias("duolingo"),
        english["notes"].alias("notes"),
    )
    return F.when(english.isNotNull() | out["ielts"].isNotNull() | out["toefl"].isNotNull() | out["pte"].isNotNull(), out)


def fill_fees(fees: Column, h: Column) -> Column:
    """Fees, with gaps filled from findings: labelled amounts, else all amounts as notes; then the currency."""
    given = lambda k: F.nullif(fees[k], F.lit(""))
    domestic = F.coalesce(given("domestic"), h["domestic_fee"])
    international = F.coalesce(given("international"), h["international_fee"])
    bare = given("domestic").isNull() & given("international").isNull() & given("notes").isNull()
    notes = F.when(bare & domestic.isNull() & international.isNull() & h["fee_amounts"].isNotNull(), F.array_join(h["fee_amounts"], "; ")).otherwise(fees["notes"])
    out = F.struct(
        domestic.alias("domestic"),
        international.alias("international"),
        F.coalesce(given("currency"), currency(h["fee_amounts"])).alias("currency"),
        notes.alias("notes"),
    )
    return F.when(fees.isNotNull() | F.coalesce(out["domestic"], out["international"], out["currency"], out["notes"]).isNotNull(), out)


def fill_text(value: Column, finding: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), finding)


def json_object(raw: Column, schema: str) -> Column:
    """The outermost object of a text that may have fences or prose around it; null where it is none, missing keys null."""
    return F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), schema)
