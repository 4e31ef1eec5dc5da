"""Views with admission vocabulary, derived from the given tables by integer arithmetic.

The given texts hold none of the words that the operators look for, so program texts, records and
page addresses are built from keys. Spark and DuckDB run the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Last path segments of derived page addresses.
TOPICS = ["tuition-and-fees", "english", "entry-requirements", "scholarship", "overview", "news", "syllabus", "visa", "tuition.html/fees", "how-to-apply", "ielts", "contact"]

_topic = f"CASE page_id % {len(TOPICS)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TOPICS)) + " END"


def _text(k: str) -> str:
    c = lambda e: f"cast({e} as string)"
    return f"""concat(
 'Admission requirements for course ', {c(k)}, '.', chr(10), chr(10),
 'IELTS ', {c(f'5 + {k} % 4')}, '.', {c(f'5 * ({k} % 2)')}, ' overall, ', case when {k} % 2 = 0 then 'at least ' else 'no band below ' end, {c(f'4 + {k} % 3')}, '.0 in each.', chr(10), chr(10),
 case when {k} % 5 = 0 then '' else concat('TOEFL iBT ', {c(f'20 + {k} % 120')}, ' minimum.', chr(10), chr(10)) end,
 case when {k} % 3 = 0 then concat('PTE Academic ', {c(f'50 + {k} % 30')}, ' overall.', chr(10), chr(10)) else '' end,
 case when {k} % 4 = 0 then concat('Duolingo English Test ', {c(f'100 + {k} % 40')}, ' minimum.', chr(10), chr(10)) else '' end,
 case when {k} % 7 = 0 then '' else concat('Tuition fees for home students are £', {c(f'9000 + {k} % 900')}, ' per year.', chr(10), 'International students pay £', {c(f'20000 + {k} % 9000')}, ' per annum.', chr(10), chr(10)) end,
 case when {k} % 11 = 0 then concat('Cost of study: $', {c(f'500 + {k} % 90')}, ' per credit hour.', chr(10), chr(10)) else '' end,
 'The programme duration is ', {c(f'1 + {k} % 8')}, case when {k} % 6 = 0 then ' months' else ' years' end, ' full-time.', chr(10), chr(10),
 case when {k} % 2 = 0 then concat('A GPA of 3.', {c(f'{k} % 10')}, ' out of 4 is required for entry.', chr(10), chr(10)) else concat('Progression to the dissertation and thesis stage: upper second honours degree, 2:1 or ', {c(f'60 + {k} % 10')}, '%.', chr(10), chr(10)) end,
 case when {k} % 9 = 0 then '' else concat('Application deadline: ', {c(f'1 + {k} % 28')}, ' January 20', {c(f'20 + {k} % 8')}, '. Applications close by March ', {c(f'1 + {k} % 30')}, ', 20', {c(f'21 + {k} % 7')}, '.', chr(10), chr(10)) end,
 'Modules in semester 1 and scholarships are listed apart.')"""


#: ``k, degree, text`` for each order.
PROGRAMS = f"SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'Undergraduate' WHEN 1 THEN 'Master of Science' ELSE 'PhD' END AS degree, {_text('o_orderkey')} AS text FROM orders"

#: ``page_id, scrape, url, html, content``: pages under derived addresses, 40 to a scrape, with program text for every page.
PAGES = f"""SELECT page_id, cast(floor(page_id / 40) as bigint) AS scrape, concat(regexp_replace(url, '[?#].*$', ''), '/', {_topic}) AS url,
 concat(html, '<a href="/apply?x=1">Apply now</a><a class="b" href="/Apply/">again</a><a href="/fees/p', cast(page_id % 9 as string), '">Tuition <b>fees</b></a><a href="/fees.pdf">fees</a><a href="https://other.org/fees">fees</a><a class=x href=', chr(39), '/fees/q', cast(page_id % 5 as string), chr(39), '>Fees &amp; <i> costs </i></a><A HREF=/ielts/b>English</A><!-- <a href="/tuition/hidden">Tuition</a> --><a href="/', {_topic}, '#x">', {_topic}, '</a>') AS html,
 {_text('page_id')} AS content FROM pages"""

_place = "(page_id % 40)"
_site = "floor(page_id / 40)"
_named = lambda n: f"CASE {n} % {len(TOPICS)} " + " ".join(f"WHEN {k} THEN '{'about' if k in (1, 10) else t}'" for k, t in enumerate(TOPICS)) + " END"
_below = lambda n: f"concat('/prog/', CASE WHEN {_site} % 2 = 0 THEN {_named(n)} ELSE CASE {n} % 3 WHEN 0 THEN 'fees' WHEN 1 THEN 'international/english' ELSE 'curriculum' END END, '/', cast({n} as string))"
_child = lambda j, before, after: f"CASE WHEN {_place} * 3 + {j} < 38 THEN concat({before}, {_below(f'({_place} * 3 + {j})')}, {after}) ELSE '' END"
_children = [("'<a class=\"c\" href=\"'", "'\">more</a>'"), ("'<a href='", "' >more</a>'"), ("'<A HREF=', chr(39)", "'?from=page#x', chr(39), '>more</A>'")]
#: ``page_id, crawl_id, url, html, content``: sites of 40 pages whose anchors, in all forms of quotes, lead to three more each; some are missing pages or
#: have the text of another. The last two are an address made by a pass over English pages and the other view of the page on fees.
SITES = f"""SELECT page_id, cast({_site} as bigint) AS crawl_id, concat('https://u', cast(cast({_site} as bigint) as string), '.edu', CASE WHEN {_place} = 0 THEN '/prog' WHEN {_place} = 1 THEN '/prog/fees'
 WHEN {_place} = 38 THEN '/prog/fees?view=international' WHEN {_place} = 39 THEN CASE {_site} % 3 WHEN 0 THEN '/study/english-language-requirements' WHEN 1 THEN '/english-language-requirements' ELSE '/prog/english/39' END
 ELSE {_below(_place)} END) AS url,
 concat(html, {', '.join(_child(j + 1, *x) for j, x in enumerate(_children))}, '<a href="/prog">up</a>') AS html,
 CASE WHEN {_place} % 10 = 7 THEN concat('Page not found. ', t) WHEN {_place} % 13 = 12 THEN 'Too short' WHEN {_place} = 1 THEN replace(concat(t, t), 'International', 'Other') ELSE concat(t, t) END AS content
 FROM (SELECT page_id, url, html, {_text('k')} AS t FROM (SELECT page_id, url, html, CASE WHEN {_place} BETWEEN 29 AND 36 THEN page_id - 26 ELSE page_id END AS k FROM pages))"""

#: Records of scrapes: fields of each order, some of them missing.
RECORDS = """SELECT o_orderkey AS scrape, o_custkey AS batch, o_orderdate AS created_at,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('University ', cast(o_custkey % 50 as string)) END AS university_name,
 CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE concat('Program ', cast(o_orderkey % 300 as string)) END AS program_name,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Master' END AS degree_level,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat(cast(1 + o_orderkey % 3 as string), ' years') END AS program_duration,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '1 March' END AS application_deadlines,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'GPA 3.0' END AS min_academic_requirement,
 CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'Bachelor' END AS accepted_qualifications,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('IELTS ', cast(5 + o_orderkey % 4 as string)) END AS ielts,
 CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE 'TOEFL 90' END AS toefl,
 CASE WHEN o_orderkey % 8 < 3 THEN NULL ELSE concat('£', cast(9000 + o_orderkey % 900 as string)) END AS domestic,
 CASE WHEN o_orderkey % 9 < 4 THEN NULL ELSE concat('£', cast(20000 + o_orderkey % 900 as string)) END AS international,
 CASE o_orderstatus WHEN 'P' THEN 'processing' WHEN 'F' THEN CASE WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE 'success' END ELSE 'partial' END AS status
 FROM orders"""


def view(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    """A derived view over one given table."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql.replace(f"FROM {table}", "FROM {src}"), src=rows)


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only keys are dealt out before the texts are made, as a table of one row group is otherwise a single task's: by hash, which needs no sort, and in several parts a core."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    return spark.sql(PROGRAMS.replace("FROM orders", "FROM {src}"), src=keys)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PAGES, "pages")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SITES, "pages")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RECORDS, "orders")
