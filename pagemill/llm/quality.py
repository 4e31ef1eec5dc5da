"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose measure reaches a cutoff. Cutoffs of each rule are tried from the
strictest (which rejects least) to the loosest on labelled documents that took no part in choosing
anything else: the count of good documents that a cutoff rejects is binomial, and the exact binomial
tail says how surely the rate of false rejections lies below the rule's limit. Testing in this fixed
order stops at the first cutoff that can't be certified, so a rule needs no correction for its many
cutoffs; over rules and strata the error is shared out evenly (Bonferroni). Of the certified cutoffs
the one that does most good on the other labelled documents is taken. With a confidence of
``1 - error``, in every stratum at most ``risk`` of the good documents are rejected by all rules together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.decontaminate import words_of
from pagemill.llm.shared import staged, without

#: Blanks between words, and characters that count as symbols.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Base rules: fewest words, and the largest share of words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Limit of false rejections in a stratum, chance that any limit is broken, good documents that weigh as much as one that a rule is meant to find.
RISK, ERROR, COST = 0.05, 0.05, 20
#: Labelled documents that flagged words are learned from, their least share of toxic documents and least precision, and how many there are at most.
SAMPLE_ROWS, LEAST_SHARE, LEAST_PRECISION, MOST_FLAGGED = 20_000, 0.1, 0.9, 256
#: Strata with thresholds that are broadcast at most; beyond, they are joined by a shuffle of narrow rows.
BROADCAST_STRATA = 10_000
#: First hexadecimal digits of sha256(document id) of the fold that is learned from; the rest certifies.
LEARNING_DIGITS = "01234"


class Rule(NamedTuple):
    """A measure (SQL over the counts of a text; long, higher is worse) and its cutoffs, from the strictest on."""

    name: str
    measure: str
    cutoffs: Sequence[int]


def steps(top: int, least: int, ratio: float = 0.85) -> list[int]:
    """Cutoffs that fall by a ratio."""
    return sorted({max(least, int(top * ratio**k)) for k in range(1 + math.ceil(math.log(least / top) / math.log(ratio)))}, reverse=True)


def standard_rules() -> list[Rule]:
    """Shares in thousandths, mean word lengths in hundredths, and distinct flagged words."""
    share = lambda part, whole: f"1000 * {part} div greatest({whole}, 1)"
    length = "100 * word_chars div greatest(n_words, 1)"
    return [
        Rule("symbols", share("n_symbols", "word_chars"), steps(1000, 5)),
        Rule("lines", share("n_dup_lines", "n_lines"), steps(1000, 50)),
        Rule("repeats", share("n_repeat_words", "n_words"), steps(500, 20)),
        Rule("long_words", length, steps(3000, 500, 0.95)),
        Rule("short_words", f"1000 - {length}", [1000 - x for x in steps(500, 100, 0.95)[::-1]]),
        Rule("flagged", "n_flagged", [5, 4, 3, 2, 1]),
    ]


# ---------------------------------------------------------------- measures


def text_measures(docs: DataFrame, text: str, flagged: Sequence[str] = ()) -> DataFrame:
    """Put the counts of a text into the place of the text.

    ``n_words`` (runs without blanks), ``word_chars`` (code points in them), ``n_symbols``, ``n_lines`` (with a word),
    ``n_dup_lines`` (equal to an earlier one), ``n_repeat_words`` (words in 3-word windows found twice or more in the
    text, the first included), ``n_flagged`` (distinct words of ``flagged``), all long. A null or empty text has none.

    Windows are found by sorting (64-bit hash, place) of each text: first longs that hold as many bits of the
    hash as the place leaves, then whole hashes of those that met another.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_flagged")
    rest = [c for c in docs.columns if c != text and c not in names]
    df = docs.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split("_text", BLANKS), "")).withColumn("_n", F.size("_words"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_bits", F.length(F.bin(F.col("_n"))))
    gram = "xxhash64(get(_words, {0}), get(_words, {0} + 1), get(_words, {0} + 2))"
    df = df.withColumn("_packed", F.expr(f"sort_array(slice(transform(_words, (w, i) -> shiftleft({gram.format('i')}, _bits) | cast(i as bigint)), 1, greatest(_n - 2, 0)))"))
    same = "shiftright(get(_packed, {}), _bits) <=> shiftright(x, _bits)"
    near = f"(i > 0 and {same.format('greatest(i - 1, 0)')}) or {same.format('i + 1')}"
    df = df.withColumn("_maybe", F.expr(f"transform(filter(_packed, (x, i) -> {near}), x -> cast(x & (shiftleft(1L, _bits) - 1) as int))"))
    df = df.withColumn("_exact", F.expr(f"sort_array(transform(_maybe, p -> struct({gram.format('p')} as h, p as p)))"))
    df = df.withColumn("_places", F.expr("sort_array(transform(filter(_exact, (x, i) -> (i > 0 and get(_exact, greatest(i - 1, 0)).h <=> x.h) or get(_exact, i + 1).h <=> x.h), x -> x.p))"))
    covered = F.expr("aggregate(transform(_places, (p, i) -> cast(least(3, coalesce(get(_places, i + 1) - p, 3)) as bigint)), 0L, (a, b) -> a + b)")
    long = lambda c: c.cast("long")
    flags = F.array(*map(F.lit, flagged)).cast("array<string>")
    return df.select(
        *(F.col(f"`{c}`") for c in rest),
        long(F.col("_n")).alias("n_words"),
        long(F.length(F.regexp_replace("_text", BLANKS, ""))).alias("word_chars"),
        long(F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        (long(F.size(F.array_intersect(words_of(F.col("_text")), flags))) if flagged else F.lit(0).cast("long")).alias("n_flagged"),
    )


def learning(doc: str) -> Column:
    """Whether a document belongs to the fold that is learned from."""
    return F.substring(F.sha2(F.col(doc).cast("string"), 256), 1, 1).isin(*LEARNING_DIGITS)


def flagged_words(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """Words that stand in many toxic documents and hardly any other; at most ``MOST_FLAGGED``.

    Learned from at most ``rows`` labelled documents of the learning fold, those with the least sha256 of their ids:
    a bounded sample. ``labels`` are (doc, toxic); null labels are left out, and so are words of other documents.
    """
    some = labels.filter(learning("doc") & F.col("toxic").isNotNull()).orderBy(F.sha2(F.col("doc").cast("string"), 256), "doc").limit(rows)
    seen = docs.join(F.broadcast(some), "doc").select("toxic", F.array_distinct(words_of(F.col(text))).alias("w"))
    toxic = F.sum((F.col("toxic") == 1).cast("long"))
    counts = seen.select("toxic", F.explode("w").alias("w")).groupBy("w").agg(toxic.alias("t"), F.count("*").alias("n"))
    every = seen.agg(toxic).first()[0] or 0
    found = counts.filter((F.col("t") >= LEAST_SHARE * every) & (F.col("t") >= LEAST_PRECISION * F.col("n")) & (F.col("t") > 0))
    return sorted(r[0] for r in found.orderBy(F.desc("t"), "w").limit(MOST_FLAGGED).collect())


# ---------------------------------------------------------------- thresholds


def log_tail(n: Column, x: Column, rate: float) -> Column:
    """Natural logarithm of P(X <= x) for X binomial (n, rate); for x above the mean 0, which is enough to refuse."""
    odds = math.log(rate / (1 - rate))
    first = n.cast("double") * math.log1p(-rate)
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(term, a["sum"]), F.least(term, a["sum"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    rest = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(x, F.lit(1)).cast("long")), start, add, lambda a: a["sum"])
    return F.when(x > n * rate, F.lit(0.0)).when(x == 0, first).otherwise(rest)


def certified(labelled: DataFrame, rules: Sequence[Rule], risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Every cutoff with its counts and whether it is certified: a row per stratum, rule and cutoff.

    ``labelled`` has ``stratum`` (null is one of its own), ``good`` and ``learn`` (booleans) and ``values`` (the
    rules' measures, in order). Returns ``stratum``, ``rule`` int, ``cutoff`` long, ``n`` and ``x`` (certifying good documents
    and those rejected), ``gain`` (learning documents that are not good and rejected) and ``loss`` (good ones), ``log_p`` and
    ``certified``. Strata without certifying good documents have no rows.
    """
    grids = F.array(*(F.array(*(F.lit(int(c)) for c in r.cutoffs)).cast("array<bigint>") for r in rules))
    each = labelled.select("stratum", "good", "learn", F.posexplode("values").alias("rule", "value"))
    each = each.withColumn("grid", F.get(grids, F.col("rule")))
    # cutoffs fall, so those that reject a value are the last ones of the grid
    each = each.withColumn("first", F.size(F.filter("grid", lambda c: c > F.col("value"))))
    as_long = lambda c: F.sum(c.cast("long"))
    counts = each.groupBy("stratum", "rule", "first").agg(
        as_long(~F.col("learn") & F.col("good")).alias("n"), as_long(F.col("learn") & ~F.col("good")).alias("gain"), as_long(F.col("learn") & F.col("good")).alias("loss")
    )
    # a row per cutoff also where no document lies between two of them; the last counts documents that no cutoff rejects
    lengths = F.array(*(F.lit(len(r.cutoffs)) for r in rules))
    strata = counts.groupBy("stratum").agg(F.sum("n").alias("_n")).filter("_n > 0").drop("_n")
    places = strata.select("stratum", F.posexplode(F.transform(lengths, lambda k: F.sequence(F.lit(0), k))).alias("rule", "at")).select("stratum", "rule", F.explode("at").alias("first"))
    full = places.alias("p").join(counts.alias("c"), F.col("p.stratum").eqNullSafe(F.col("c.stratum")) & (F.col("p.rule") == F.col("c.rule")) & (F.col("p.first") == F.col("c.first")), "left")
    full = full.select("p.stratum", "p.rule", "p.first", *(F.coalesce(F.col(f"c.{k}"), F.lit(0)).alias(k) for k in ("n", "gain", "loss")))
    group = Window.partitionBy("stratum", "rule")
    upto = group.orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    summed = full.select("stratum", "rule", "first", F.sum("n").over(group).alias("n"), F.sum("n").over(upto).alias("x"), F.sum("gain").over(upto).alias("gain"), F.sum("loss").over(upto).alias("loss"))
    summed = summed.withColumn("cutoff", F.get(F.get(grids, F.col("rule")), F.col("first"))).filter(F.col("cutoff").isNotNull())
    tested = summed.withColumn("log_p", log_tail(F.col("n"), F.col("x"), risk / len(rules)))
    tests = strata.agg(F.count("*").alias("m")).withColumn("limit", F.log(F.lit(error) / (F.greatest(F.col("m"), F.lit(1)) * len(rules))))
    passed = tested.crossJoin(F.broadcast(tests)).withColumn("_ok", (F.col("log_p") <= F.col("limit")).cast("int"))  # one row
    return passed.select("stratum", "rule", "cutoff", "n", "x", "gain", "loss", "log_p", (F.min("_ok").over(upto) == 1).alias("certified"))


def chosen(tested: DataFrame, cost: int = COST) -> DataFrame:
    """Of the certified cutoffs of each stratum and rule, that with the most of ``gain - cost * loss`` above 0 (ties: the strictest).

    Returns ``stratum`` and ``cutoffs`` (array of rule and cutoff).
    """
    worth = F.col("gain") - cost * F.col("loss")
    best = F.max_by(F.struct("rule", "cutoff"), F.struct(worth, F.col("cutoff"))).alias("best")
    by_rule = tested.filter(F.col("certified") & (worth > 0)).groupBy("stratum", "rule").agg(best)
    return by_rule.groupBy("stratum").agg(F.sort_array(F.collect_list("best")).alias("cutoffs"))  # at most one of each rule


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    rules: Sequence[Rule] | None = None,
    risk: float = RISK,
    error: float = ERROR,
    cost: int = COST,
) -> DataFrame:
    """Judge documents by base rules and by rules whose thresholds limit false rejections in each stratum.

    ``labels`` has ``doc_id``, ``quality`` and ``toxic`` (0 or 1); good documents have quality 1 and are not toxic. Of repeated
    labels of one id the worst counts; rows with a null in any of the three, and labels of unknown ids, are left out.
    Returns ``doc_id``, the counts of ``text_measures``, ``base_failed`` (too few words, or more than half of them in
    repeated windows), ``kept`` and ``rejected_by`` (names of the rules, in order, comma-joined).

    A row per document: repeated rows are judged alike, null ids stay and are never labelled; a null text has no words and fails
    the base rules; whole texts of any length are counted; a value equal to a cutoff is rejected. A null stratum is one of its
    own. A stratum with too few labels to certify anything, and no labels at all, leave the base rules alone. An empty table gives no rows.
    Other columns are not looked at. Texts are read twice (flagged words, measures) and never shuffled.
    """
    rules = standard_rules() if rules is None else list(rules)
    known = labels.select(F.col(doc_id).alias("doc"), F.col("quality").alias("q"), F.col("toxic").alias("t")).dropna()
    known = known.groupBy("doc").agg(F.min("q").alias("quality"), F.max("t").alias("toxic"))
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    flagged = flagged_words(rows, known)
    seen = staged(text_measures(rows, "text", flagged), "measures")
    valued = seen.withColumn("values", F.array(*(F.expr(r.measure).cast("long") for r in rules)))
    # what the base rules reject is not left for the others to judge
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    labelled = valued.filter(~failed).join(known, "doc").select("stratum", "values", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), learning("doc").alias("learn"))
    limits = staged(chosen(certified(labelled, rules, risk, error), cost), "thresholds").withColumnRenamed("stratum", "_stratum")
    few = limits.count() <= BROADCAST_STRATA
    judged = valued.join(F.broadcast(limits) if few else limits, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    against = F.filter("cutoffs", lambda c: F.get(F.col("values"), c["rule"]) >= c["cutoff"])
    names = F.array(*(F.lit(r.name) for r in rules))
    by = F.coalesce(F.array_join(F.transform(against, lambda c: F.get(names, c["rule"])), ","), F.lit(""))
    out = without(judged, "base_failed", "rejected_by").withColumn("base_failed", failed).withColumn("rejected_by", by)
    return out.select(
        F.col("doc").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_flagged",
        "base_failed", (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept"), "rejected_by",
    )


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with thresholds from all labels by language."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_rules(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
