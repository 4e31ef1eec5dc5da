"""DuckDB SQL of the numbered queries on quality rules, ranked search and resampling."""

from __future__ import annotations

from pagemill.llm import quality, resampling

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE, _INK = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _first_digits(text: str, n: int) -> str:
    """The first hexadecimal digits of a text's SHA-256 as a number."""
    digits = [f"(strpos('0123456789abcdef', substr(sha256({text}), {i + 1}, 1)) - 1) * {16 ** (n - 1 - i)}" for i in range(n)]
    return f"({' + '.join(digits)})::BIGINT"


def _quality() -> str:
    rules = quality.standard_rules()
    cutoffs = ", ".join(f"({r}, {i}, {c})" for r, rule in enumerate(rules) for i, c in enumerate(rule.cutoffs))
    names = "[" + ", ".join(f"'{r.name}'" for r in rules) + "]"
    rate, error, m = quality.RISK / len(rules), quality.ERROR, len(rules)
    digits = ", ".join(f"'{x}'" for x in quality.LEARNING_DIGITS)
    share = lambda a, b: f"(1000 * {a}) // greatest({b}, 1)"
    length = "(100 * word_chars) // greatest(n_words, 1)"
    measures = ", ".join([share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), length, f"1000 - {length}", "n_flagged"])
    return rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
k AS (SELECT doc_id, min(quality) AS q, max(toxic) AS t FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
lw AS (SELECT DISTINCT doc_id, t, unnest({_words('text')}) AS w FROM documents JOIN k USING (doc_id) WHERE substr(sha256(doc_id::VARCHAR), 1, 1) IN ({digits})),
tox AS (SELECT count(*) FILTER (t = 1) AS n FROM documents JOIN k USING (doc_id) WHERE substr(sha256(doc_id::VARCHAR), 1, 1) IN ({digits})),
f AS (SELECT w, count(*) FILTER (t = 1) AS t, count(*) AS n FROM lw GROUP BY 1),
fl AS (SELECT w FROM f, tox WHERE f.t > 0 AND f.t >= {quality.LEAST_SHARE} * tox.n AND f.t >= {quality.LEAST_PRECISION} * f.n),
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest({_words('text')}) AS w FROM documents) JOIN fl USING (w) GROUP BY 1),
b AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(x, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
 (length(x) - length(translate(x, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
 coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(hits.n, 0)::BIGINT AS n_flagged
 FROM (SELECT *, [y FOR y IN string_split(x, chr(10)) IF regexp_matches(y, '{_INK}')] AS l FROM d) d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN hits ON hits.doc_id = d.doc_id),
v AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed, [{measures}] AS vs FROM b),
u(r, i, c) AS (VALUES {cutoffs}),
s AS (SELECT coalesce(lang, chr(0)) AS lang, q = 1 AND t = 0 AS good, substr(sha256(doc_id::VARCHAR), 1, 1) IN ({digits}) AS learn, vs FROM v JOIN k USING (doc_id) WHERE NOT base_failed),
z AS (SELECT lang, r, i, c, count(*) FILTER (good AND NOT learn) AS n, count(*) FILTER (good AND NOT learn AND vs[r + 1] >= c) AS x,
 count(*) FILTER (learn AND NOT good AND vs[r + 1] >= c) AS gain, count(*) FILTER (learn AND good AND vs[r + 1] >= c) AS loss FROM s, u GROUP BY ALL HAVING count(*) FILTER (good AND NOT learn) > 0),
p AS (SELECT *, CASE WHEN x > n * {rate!r}::DOUBLE THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate!r}::DOUBLE) + (n - j) * ln(1 - {rate!r}::DOUBLE))) FROM (SELECT unnest(generate_series(0, x)) AS j)) END AS tail FROM z),
o AS (SELECT *, max(CASE WHEN tail <= {error!r}::DOUBLE / ((SELECT count(DISTINCT lang) FROM z) * {m}) THEN 0 ELSE 1 END) OVER (PARTITION BY lang, r ORDER BY i) = 0 AS ok FROM p),
e AS (SELECT lang, r, c FROM (SELECT *, row_number() OVER (PARTITION BY lang, r ORDER BY gain - {quality.COST} * loss DESC, c DESC) AS k FROM o WHERE ok AND gain > {quality.COST} * loss) WHERE k = 1),
a AS (SELECT doc_id, string_agg(({names})[r + 1], ',' ORDER BY r) AS by_rule FROM v JOIN e ON e.lang = coalesce(v.lang, chr(0)) AND vs[r + 1] >= c GROUP BY 1)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND by_rule IS NULL AS kept, coalesce(by_rule, '') AS rejected_by FROM v LEFT JOIN a ON a.doc_id = v.doc_id"""


_RANKED = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest({_words('text')}) AS t FROM benchmark),
o AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM o GROUP BY 1),
w AS (SELECT t, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, s),
v AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * o.n * s.n) // s.l)) AS v FROM o, s),
r AS (SELECT item_id, doc_id, sum(w * v)::BIGINT AS score FROM q JOIN w USING (t) JOIN v USING (t) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10"""


def _resampled() -> str:
    k, pct = resampling.BUCKETS, resampling.PERCENT
    grams = lambda t: f"SELECT {t}, unnest(w) AS g FROM {t}_w UNION ALL SELECT {t}, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM {t}_w"
    return f"""WITH doc_w AS (SELECT doc_id AS doc, {_words('text')} AS w FROM documents), item_w AS (SELECT item_id AS item, {_words('text')} AS w FROM benchmark),
dg AS ({grams('doc')}), ig AS ({grams('item')}),
crc AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
h AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM dg UNION SELECT DISTINCT g FROM ig)),
y AS (SELECT g, [(16 * (strpos('0123456789ABCDEF', substr(x, 2 * i - 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(x, 2 * i, 1)) - 1)::BIGINT FOR i IN range(1, length(x) // 2 + 1)] AS b FROM h),
b AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, z: xor(c >> 8, t[xor(c & 255, z) + 1])), 4294967295::BIGINT) % {k} AS bucket FROM y, crc),
s AS (SELECT bucket, count(*) AS n FROM dg JOIN b USING (g) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM ig JOIN b USING (g) GROUP BY 1),
gain AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + {k}))::DOUBLE / ((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + {k}))::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
v AS (SELECT doc, count(*) AS n, sum(gain) AS total FROM dg JOIN b USING (g) JOIN gain USING (bucket) GROUP BY 1),
c AS (SELECT doc_w.doc AS doc_id, len(w) AS n_words, coalesce(v.n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / v.n), 0)::BIGINT AS weight, {_first_digits(f"'{resampling.SEED}:' || doc_w.doc::VARCHAR", 8)} AS h FROM doc_w LEFT JOIN v USING (doc)),
o AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM c),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_words >= {resampling.LEAST_WORDS})
SELECT o.doc_id, n_features, weight, score, CASE WHEN rank <= {pct} * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM o LEFT JOIN r USING (doc_id)"""


ORACLE_SQL = {"op11_quality_rules": _quality(), "op12_ranked_search": _RANKED, "op13_resampling": _resampled()}
