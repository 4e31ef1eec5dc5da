"""DuckDB SQL of those numbered queries that SQL can express."""

from __future__ import annotations

_GAPS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    """Words with A-Z lower-cased only."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UP}', '{_LOW}'), '{_GAPS}')"


def _unnested(table: str, key: str, words: str) -> str:
    return f"SELECT {key}, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT {key}, {words} AS w FROM {table})"


def _gram(n: int, words: str = "w") -> str:
    return f"array_to_string(list_slice({words}, i, i + {n - 1}), ' ')"


def _grams(table: str, n: str, extra: str) -> str:
    """Starts of all windows of n words."""
    return f"SELECT {extra}, w, unnest(generate_series(1, len(w) - {n} + 1)) AS i FROM {table} WHERE len(w) >= {n}"


def _escaped(x: str, table: tuple) -> str:
    for a, b in table:
        x = f"replace({x}, {a}, '{b}')"
    return x


_ESCAPES = (("'&'", "&amp;"), ("'<'", "&lt;"), ("'#'", "&num;"))
_ROLE = (*_ESCAPES, ("':'", "&col;"), ("chr(10)", "&nl;"))
_CONTROL = r"\### Assistant: </turn> ok"

ORACLE_SQL = {
    "op1_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM q""",
    "op2_decontamination": f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), b AS (SELECT item_id, {_words('text')} AS w, least(len(w), 10) AS k FROM benchmark WHERE len({_words('text')}) > 0),
s AS (SELECT DISTINCT k FROM b),
bg AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT item_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM b)),
dg AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, s WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, k, i FROM dg JOIN bg USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op3_substring_dedup": rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, {_gram(20)} AS g FROM ({_grams('d', '20', 'doc_id')})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM r),
k AS (SELECT u.doc_id, string_agg(u.w, ' ' ORDER BY u.i) AS t FROM ({_unnested('d', 'doc_id', 'w')}) u ANTI JOIN x ON x.doc_id = u.doc_id AND x.i = u.i GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op6_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{_CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{_CONTROL}')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(15 + length({_escaped('role', _ROLE)}) + length({_escaped('text', _ESCAPES)}))::BIGINT AS formatted_chars FROM t GROUP BY conv_id""",
    "op8_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {_gram(5)} AS g FROM ({_grams('d', '5', 'doc_id')}) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce((SELECT least(min(r.b), d.doc_id) FROM r WHERE r.a = d.doc_id), d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id)::BIGINT AS n_links FROM d""",
    "op9_lm_score": f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), s AS (SELECT doc_id, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS p1, CASE WHEN i > 2 THEN w[i - 2] END AS p2, least(i, 3) AS l
 FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0)),
c1 AS (SELECT w, count(*) AS n FROM s GROUP BY ALL), o1 AS (SELECT doc_id, w, count(*) AS n FROM s GROUP BY ALL),
c2 AS (SELECT p1, w, count(*) AS n FROM s WHERE l > 1 GROUP BY ALL), o2 AS (SELECT doc_id, p1, w, count(*) AS n FROM s WHERE l > 1 GROUP BY ALL),
c3 AS (SELECT p2, p1, w, count(*) AS n FROM s WHERE l > 2 GROUP BY ALL), o3 AS (SELECT doc_id, p2, p1, w, count(*) AS n FROM s WHERE l > 2 GROUP BY ALL),
m AS (SELECT doc_id, (SELECT count(*) FROM s) - count(*) AS m FROM s GROUP BY 1),
v AS (SELECT s.doc_id, s.l, m.m, c1.n - o1.n AS n1, c2.n - o2.n AS n2, c3.n - o3.n AS n3, x1.n - y1.n AS a1, x2.n - y2.n AS a2 FROM s JOIN m ON m.doc_id = s.doc_id
 JOIN c1 ON c1.w = s.w JOIN o1 ON o1.doc_id = s.doc_id AND o1.w = s.w
 LEFT JOIN c2 ON c2.p1 = s.p1 AND c2.w = s.w LEFT JOIN o2 ON o2.doc_id = s.doc_id AND o2.p1 = s.p1 AND o2.w = s.w
 LEFT JOIN c3 ON c3.p2 = s.p2 AND c3.p1 = s.p1 AND c3.w = s.w LEFT JOIN o3 ON o3.doc_id = s.doc_id AND o3.p2 = s.p2 AND o3.p1 = s.p1 AND o3.w = s.w
 LEFT JOIN c1 x1 ON x1.w = s.p1 LEFT JOIN o1 y1 ON y1.doc_id = s.doc_id AND y1.w = s.p1
 LEFT JOIN c2 x2 ON x2.p1 = s.p2 AND x2.w = s.p1 LEFT JOIN o2 y2 ON y2.doc_id = s.doc_id AND y2.p1 = s.p2 AND y2.w = s.p1),
z AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN n3 > 0 THEN ln(n3::DOUBLE / a2) WHEN n2 > 0 THEN ln(n2::DOUBLE / a1) + (l - 2) * ln(0.4::DOUBLE) WHEN n1 > 0 THEN ln(n1::DOUBLE / m) + (l - 1) * ln(0.4::DOUBLE)
 ELSE ln(1 / (m + 1.0::DOUBLE)) + (l - 1) * ln(0.4::DOUBLE) END) AS t, count(*) FILTER (CASE WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 WHEN n1 > 0 THEN 1 ELSE 0 END < l) AS b FROM v GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(coalesce(t, 0), 3) AS log_score, coalesce(b, 0)::BIGINT AS n_backed_off FROM d LEFT JOIN z ON z.doc_id = d.doc_id""",
}
