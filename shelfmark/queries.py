"""Core queries over the test tables, each beside the SQL that a second engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BLOCKED, SiteRules
from .functions import text as tx
from .functions import urls, wiki
from .operators import articles as art
from .operators import catalog, crawl, enrich, entities, extract, index, lookups, packed, stats, units
from .plans import ast
from .plans import compile as search
from .plans import parser
from .session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def q(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


# Quantities and packed values.


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.common_quantities(spread(table(spark, d, "unit_tests"))).distinct()


@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_values(spread(table(spark, d, "postprocessing_extracted")), "ingredients", "product_id").distinct()


# The TF-IDF index and search on it.

_TFIDF = """
WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9]+'))) AS term FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT term, count(*) AS n0, cast(sum(tf) AS bigint) AS total_tf FROM p GROUP BY term),
n AS (SELECT count(*)::double AS n FROM documents),
l AS (SELECT doc_id, sqrt(sum(pow(tf * ln(n / n0), 2))) AS l2 FROM p JOIN d USING (term), n GROUP BY doc_id)
"""
_ASKED = "salt caramel sauce sauce unheardofword"


def _tfidf(spark: SparkSession, d: str) -> index.TfIdfIndex:
    return index.build(table(spark, d, "documents"), "doc_id", F.col("text"))


@query(_TFIDF + "SELECT * FROM d")
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    return _tfidf(spark, d).terms


@query(_TFIDF + "SELECT * FROM p")
def tfidf_postings(spark: SparkSession, d: str) -> DataFrame:
    return _tfidf(spark, d).postings


@query(_TFIDF + "SELECT doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9]+')) AS bigint) AS doc_len, round(coalesce(l2, 0), 6) AS l2 FROM documents LEFT JOIN l USING (doc_id)")
def tfidf_docs(spark: SparkSession, d: str) -> DataFrame:
    return _tfidf(spark, d).docs.withColumn("l2", F.round("l2", 6))


_SCORED = _TFIDF + ", a AS (SELECT unnest(['salt', 'caramel', 'sauce', 'sauce', 'unheardofword']) AS term), s AS (SELECT doc_id, sum(tf * ln(n / n0)) AS raw FROM a JOIN p USING (term) JOIN d USING (term), n GROUP BY doc_id) "


@query(_SCORED + "SELECT doc_id, round(raw, 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def search_idf(spark: SparkSession, d: str) -> DataFrame:
    return index.search(_tfidf(spark, d), _ASKED, "idf")


@query(_SCORED + "SELECT doc_id, round(raw / nullif(l2, 0) * 100, 6) AS score FROM s JOIN l USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10")
def search_idf_l2(spark: SparkSession, d: str) -> DataFrame:
    return index.search(_tfidf(spark, d), _ASKED, "idf_l2")


@query(
    _SCORED
    + """, h AS (SELECT doc_id, round(raw / nullif(l2, 0) * 100, 6) AS score FROM s JOIN l USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10)
SELECT doc_id, score, lang, source, cast(row_number() OVER (ORDER BY score DESC, doc_id) AS integer) AS rank FROM h JOIN documents USING (doc_id)"""
)
def search_idf_metadata(spark: SparkSession, d: str) -> DataFrame:
    hits = index.search(_tfidf(spark, d), _ASKED, "idf_l2")
    return index.with_metadata(hits, table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")


# The fielded index and its query language.

FIELDS = ("name", "description", "highlights", "ingredients")


def _fielded(spark: SparkSession, d: str) -> search.FieldedIndex:
    return catalog.build(_enriched(spark, d))


_BM25 = f"""
WITH src AS (SELECT product_id AS doc_id, unnest(['name', 'description', 'highlights', 'ingredients']) AS field, unnest([name, description, highlights, array_to_string(ingredients, ' ')]) AS txt FROM unit_tests),
tk AS (SELECT doc_id, field, regexp_extract_all(lower(txt), {q(tx.WORD)}) AS toks FROM src WHERE txt IS NOT NULL),
pos AS (SELECT doc_id, field, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS p FROM tk),
pst AS (SELECT field, term, doc_id, count(*) AS tf FROM pos GROUP BY ALL),
ln_ AS (SELECT field, doc_id, len(toks) AS dl FROM tk WHERE len(toks) > 0),
fs AS (SELECT field, count(*) AS doc_count, sum(dl) AS sum_tf FROM ln_ GROUP BY field),
cat AS (SELECT product_id AS doc_id, category, brand, nullif(try_cast(price AS double), 0) AS price_num, coalesce(len(ingredients), 0) AS n_ingredients FROM unit_tests)
"""
_SAT = "tf / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * dl / (sum_tf / doc_count)))"
_IDF = "ln(1 + (doc_count - df + 0.5::double) / (df + 0.5::double))"


def _hits_sql(wanted: str) -> str:
    """SQL of ``h(clause, doc_id, score)`` for rows ``w(clause, field, term, boost)``."""
    return f""", w AS ({wanted}), x AS (SELECT w.*, doc_id, tf FROM w JOIN pst USING (field, term)), df AS (SELECT clause, field, term, count(*) AS df FROM x GROUP BY ALL),
h AS (SELECT clause, doc_id, sum(boost * {_IDF} * {_SAT}) AS score FROM x JOIN df USING (clause, field, term) JOIN fs USING (field) JOIN ln_ USING (field, doc_id) GROUP BY ALL)
"""


def _words_sql(clauses: list[tuple[int, str, tuple[str, ...]]]) -> str:
    rows = ", ".join(f"({c}, {q(f)}, {q(t)}, 1.0::double)" for c, t, fields in clauses for f in fields)
    return f"SELECT * FROM (VALUES {rows}) AS v(clause, field, term, boost)"


_TOP = " ORDER BY score DESC, doc_id LIMIT 10"


def _search(spark: SparkSession, d: str, node: ast.Node | None, k: int | None = 10) -> DataFrame:
    return search.search(_fielded(spark, d), node, FIELDS, k)


@query(_BM25 + _hits_sql(_words_sql([(0, "yogurt", ("name",)), (1, "lemon", ("name",))])) + "SELECT doc_id, round(sum(score), 6) AS score FROM h GROUP BY doc_id" + _TOP)
def search_field(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, parser.parse("yogurt lemon", ("name",)))


@query(_BM25 + _hits_sql(_words_sql([(0, "garlic", FIELDS), (1, "granules", FIELDS)])) + "SELECT doc_id, round(sum(score), 6) AS score FROM h GROUP BY doc_id" + _TOP)
def search_multifield(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, parser.parse("garlic granules", FIELDS))


_BOOL = [(0, "chocolate", FIELDS), (1, "honey", FIELDS), (2, "milk", FIELDS), (3, "butter", FIELDS)]
_PIVOT = ", pv AS (SELECT doc_id, " + ", ".join(f"max(CASE WHEN clause = {i} THEN score END) AS s{i}" for i in range(4)) + " FROM h GROUP BY doc_id) "


@query(
    _BM25 + _hits_sql(_words_sql(_BOOL)) + _PIVOT
    + """SELECT doc_id, round(coalesce(s0, 0) + coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0), 6) AS score FROM pv JOIN cat USING (doc_id)
WHERE (s0 IS NOT NULL OR s1 IS NOT NULL) AND (s2 IS NOT NULL OR s3 IS NOT NULL) AND NOT coalesce(lower(category) = 'bakery', false)"""
    + _TOP
)
def search_boolean(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, parser.parse("+(chocolate OR honey) +(milk OR butter) -category:Bakery", FIELDS, ("category", "brand")))


@query(
    _BM25 + _hits_sql(_words_sql(_BOOL)) + _PIVOT
    + "SELECT cast(count(*) AS bigint) AS total_hits FROM pv WHERE (s0 IS NOT NULL OR s1 IS NOT NULL) AND (s2 IS NOT NULL OR s3 IS NOT NULL)"
)
def search_total_hits(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, parser.parse("(chocolate OR honey) AND (milk OR butter)", FIELDS), None).agg(F.count("*").alias("total_hits"))


_NEAR = """SELECT field, term, lv FROM (SELECT field, term, lv, row_number() OVER (PARTITION BY field ORDER BY lv, term) AS n
FROM (SELECT DISTINCT field, term, damerau_levenshtein(term, 'choclate') AS lv FROM pst) WHERE lv <= 2) WHERE n <= 50"""


@query(_BM25 + f"SELECT field, term, round(1.0::double - lv::double / least(length(term), 8), 6) AS boost FROM ({_NEAR})")
def search_fuzzy_expansions(spark: SparkSession, d: str) -> DataFrame:
    near = search.expansions(_fielded(spark, d), [(0, ast.Fuzzy("choclate", FIELDS))])
    return near.select("field", "term", F.round("boost", 6).alias("boost"))


@query(_BM25 + _hits_sql(f"SELECT 0 AS clause, field, term, 1.0::double - lv::double / least(length(term), 8) AS boost FROM ({_NEAR})") + "SELECT doc_id, round(sum(score), 6) AS score FROM h GROUP BY doc_id" + _TOP)
def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, parser.parse("choclate~", FIELDS))


@query(_BM25 + "SELECT doc_id, 1.0::double AS score FROM cat WHERE price_num BETWEEN 2 AND 3")
def search_range_double(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, parser.parse("price_num:[2 TO 3]", FIELDS), None)


@query(
    _BM25 + _hits_sql(_words_sql([(0, "organic", FIELDS)]))
    + "SELECT doc_id, round(score + 1.0, 6) AS score FROM h JOIN cat USING (doc_id) WHERE n_ingredients BETWEEN 5 AND 12 AND NOT coalesce(price_num BETWEEN 0 AND 4, false)"
)
def search_range_int(spark: SparkSession, d: str) -> DataFrame:
    node = ast.Bool(must=(ast.Term("organic", FIELDS), ast.Range("n_ingredients", 5, 12)), must_not=(ast.Range("price_num", 0, 4),))
    return _search(spark, d, node, None)


def _phrase_sql(a: str, b: str, freq: str) -> str:
    return _BM25 + f""", dfs AS (SELECT field, term, count(*) AS df FROM pst WHERE term IN ({q(a)}, {q(b)}) GROUP BY ALL),
i AS (SELECT field, doc_count, sum_tf, sum({_IDF}) AS weight FROM dfs JOIN fs USING (field) GROUP BY ALL), {freq},
o AS (SELECT doc_id, sum(weight * {_SAT}) AS score FROM f JOIN i USING (field) JOIN ln_ USING (field, doc_id) WHERE tf > 0 GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM o"""  # fmt: skip


_EXACT = "f AS (SELECT x.field, x.doc_id, count(*)::double AS tf FROM pos x JOIN pos y ON x.field = y.field AND x.doc_id = y.doc_id AND y.p = x.p + 1 WHERE x.term = 'gluten' AND y.term = 'free' GROUP BY ALL)"
_SLOPPY = """a AS (SELECT field, doc_id, p FROM pos WHERE term = 'source'), b AS (SELECT field, doc_id, p - 1 AS p FROM pos WHERE term = 'fibre'),
st AS (SELECT * FROM a UNION SELECT * FROM b),
e AS (SELECT st.field, st.doc_id, st.p, min(a.p) AS ea, min(b.p) AS eb FROM st JOIN a ON a.field = st.field AND a.doc_id = st.doc_id AND a.p >= st.p
      JOIN b ON b.field = st.field AND b.doc_id = st.doc_id AND b.p >= st.p GROUP BY ALL),
f AS (SELECT field, doc_id, sum(1.0::double / (1 + greatest(ea, eb) - p)) AS tf FROM e WHERE greatest(ea, eb) - p <= 2 GROUP BY ALL)"""


@query(_phrase_sql("gluten", "free", _EXACT))
def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, parser.parse('"gluten free"', FIELDS), None)


@query(_phrase_sql("source", "fibre", _SLOPPY))
def search_phrase_slop(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, parser.parse('"source fibre"~2', FIELDS), None)


# Pages to products.

_RULES = SiteRules()


def _rx_sql(pattern: str, column: str = "body", group: int = 1) -> str:
    got = f"regexp_extract({column}, {q('(?is)' + pattern)}, {group})"
    return f"CASE WHEN length(trim({got})) > 0 THEN {got} END"


def _entities_sql(expr: str) -> str:
    for entity, char in tx.ENTITIES:
        expr = f"replace({expr}, {q(entity)}, {q(char)})"
    return expr


def _strip_sql(expr: str) -> str:
    for p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        expr = f"regexp_replace({expr}, {q(p)}, ' ', 'g')"
    expr = f"regexp_replace({_entities_sql(expr)}, {q('[' + chr(160) + chr(13) + chr(10) + ']')}, ' ', 'g')"
    expr = f"regexp_replace({expr}, {q(r'(?i)^\s*ingredients?\s*[:\-–—]\s*')}, '')"
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'), ' .;,[]')"


_RAW = f"""
WITH b AS (SELECT source_file, coalesce({_rx_sql(_RULES.body, 'html')}, html) AS body FROM html_to_products),
t AS (SELECT *, regexp_extract_all(body, {q('(?is)' + _RULES.trail)}, 1) AS trail FROM b),
r AS (SELECT source_file, {_entities_sql(_rx_sql(_RULES.name))} AS name, {_entities_sql("CASE WHEN length(trim(trail[2])) > 0 THEN trail[2] END")} AS brand, CASE WHEN length(trim(trail[1])) > 0 THEN trail[1] END AS category,
  coalesce({', '.join(_rx_sql(p) for p in _RULES.prices)}) AS price, {_rx_sql(_RULES.ingredients)} AS ingredients, {_rx_sql(_RULES.description)} AS description, {_rx_sql(_RULES.highlights)} AS highlights,
  coalesce({', '.join(_rx_sql(p) for p in _RULES.unit_pairs)}) AS unitpair, trim({_entities_sql(_rx_sql(_RULES.nutrients['energy']))}) AS energy FROM t)
"""


@query(_RAW + "SELECT * FROM r")
def raw_products(spark: SparkSession, d: str) -> DataFrame:
    raw = extract.raw_products(table(spark, d, "html_to_products"))
    return raw.select("source_file", "name", "brand", "category", "price", "ingredients", "description", "highlights", "unitpair", F.col("nutrition_table.energy").alias("energy"))


@query(_RAW + "SELECT source_file, name, price FROM r WHERE name IS NOT NULL AND price IS NOT NULL")
def complete_products(spark: SparkSession, d: str) -> DataFrame:
    return extract.complete(extract.raw_products(table(spark, d, "html_to_products"))).select("source_file", "name", "price")


@query()
def page_products_clean(spark: SparkSession, d: str) -> DataFrame:
    return extract.clean_products(extract.raw_products(table(spark, d, "html_to_products")))


@query(f"SELECT source_file, {_strip_sql('html')} AS plain FROM html_to_products")
def html_plain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "html_to_products").select("source_file", tx.strip_html("html").alias("plain"))


_UNIT = "unitpair"


@query(
    f"""SELECT product_id, {_strip_sql('category')} AS category, {_strip_sql('description')} AS description, {_strip_sql('highlights')} AS highlights,
CASE WHEN unitpair IS NOT NULL THEN regexp_extract(unitpair, {q(r'^\s*([0-9]+(?:\.[0-9]+)?)\s*/')}, 1) END AS unit_price, CASE WHEN unitpair IS NOT NULL THEN regexp_extract(unitpair, {q(r'/\s*([^/]*?)\s*$')}, 1) END AS unit,
try_cast(price AS double) AS price_num FROM postprocessing_extracted"""
)
def clean_products(spark: SparkSession, d: str) -> DataFrame:
    c = extract.clean_products(table(spark, d, "postprocessing_extracted"))
    return c.select("product_id", "category", "description", "highlights", F.col("unit_bundle.price").alias("unit_price"), F.col("unit_bundle.unit").alias("unit"), "price_num")


@query()
def ingredient_tokens(spark: SparkSession, d: str) -> DataFrame:
    from .operators import ingredients as ing

    return table(spark, d, "postprocessing_extracted").select("product_id", F.posexplode(ing.split(tx.strip_html("ingredients"))).alias("pos", "token"))


_KEY = f"nullif(trim(regexp_replace(lower({_entities_sql('name')}), '\\s+', ' ', 'g'), ' '), '')"


@query(f"SELECT product_id, name FROM (SELECT product_id, name, row_number() OVER (PARTITION BY {_KEY} ORDER BY source_file, product_id) AS n FROM unit_tests WHERE {_KEY} IS NOT NULL) WHERE n = 1")
def first_by_name(spark: SparkSession, d: str) -> DataFrame:
    return extract.first_by_name(table(spark, d, "unit_tests")).select("product_id", "name")


@query("SELECT product_id, row_number() OVER (ORDER BY source_file, product_id) AS serial FROM unit_tests")
def serial_ids(spark: SparkSession, d: str) -> DataFrame:
    return extract.with_serial(table(spark, d, "unit_tests").select("product_id", "source_file"), ["source_file", "product_id"]).select("product_id", "serial")


@query()
def page_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "html_to_products").select("source_file", tx.stable_id("source_file").alias("product_id"))


# Links and crawling.

_URL_NORM = """CASE WHEN regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?]*)', 1) <> '' THEN lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?]*)', 1)) ||
  CASE WHEN rest = '' OR rest[1] = '?' THEN '/' || rest ELSE rest END END"""
_PAGES = """pages AS (SELECT DISTINCT m.url, h.html FROM (SELECT DISTINCT url, content_path FROM crawl_meta WHERE content_path IS NOT NULL) m JOIN html_to_products h ON m.content_path = h.source_file),
one AS (SELECT url, html FROM (SELECT m.url, min(m.content_path) AS content_path FROM crawl_meta m WHERE m.content_path IN (SELECT source_file FROM html_to_products) GROUP BY m.url) k JOIN (SELECT DISTINCT source_file, html FROM html_to_products) h ON k.content_path = h.source_file)"""
_LINKS = f"""
WITH {_PAGES},
l0 AS (SELECT url AS referrer, regexp_extract_all(html, {q(urls.HREF)}, 1) AS ls FROM one),
l1 AS (SELECT referrer, unnest(ls) AS link, generate_subscripts(ls, 1) - 1 AS pos FROM l0),
l2 AS (SELECT *, regexp_extract(referrer, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) AS root, regexp_extract(referrer, '^([A-Za-z][A-Za-z0-9+.\\-]*:)', 1) AS scheme, regexp_extract(referrer, '^([^?#]*)', 1) AS page FROM l1),
l3 AS (SELECT *, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN link WHEN link LIKE '//%' THEN scheme || link WHEN link LIKE '/%' THEN root || link WHEN link LIKE '?%' THEN page || link
   WHEN link LIKE '#%' OR link = '' THEN referrer ELSE CASE WHEN page = root THEN root || '/' ELSE regexp_extract(page, '^(.*/)', 1) END || link END AS f FROM l2),
l4 AS (SELECT *, regexp_replace(trim(f), '#.*$', '') AS b FROM l3),
l5 AS (SELECT *, substring(b, length(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?]*)', 1)) + 1) AS rest FROM l4),
links AS (SELECT referrer, cast(pos AS integer) AS pos, {_URL_NORM} AS url FROM l5)
"""


def _stored_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the address under which they were fetched: one page per address (the first stored name). The name is chosen before any text is moved."""
    pages = table(spark, d, "html_to_products").select("source_file", "html")
    meta = table(spark, d, "crawl_meta").select("url", F.col("content_path").alias("source_file")).join(pages.select("source_file"), "source_file", "left_semi")
    return meta.groupBy("url").agg(F.min("source_file").alias("source_file")).join(pages.dropDuplicates(["source_file"]), "source_file").select("url", "html")


@query(_LINKS + "SELECT * FROM links WHERE url IS NOT NULL")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return crawl.outlinks(_stored_pages(spark, d))


_SCOPE = r"https?://[^/]*\.example/products/"


@query(_LINKS + f"SELECT referrer, pos, url FROM links WHERE regexp_matches(url, {q('(?i)^(?:' + _SCOPE + ')')})")
def page_links_in_scope(spark: SparkSession, d: str) -> DataFrame:
    return crawl.outlinks(_stored_pages(spark, d), scope=_SCOPE)


@query(
    "WITH u AS (SELECT DISTINCT url, regexp_replace(trim(url), '#.*$', '') AS b FROM crawl_meta), v AS (SELECT *, substring(b, length(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?]*)', 1)) + 1) AS rest FROM u) "
    f"SELECT url, {_URL_NORM} AS normal FROM v"
)
def urls_normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_meta").select("url").distinct().select("url", urls.normalize(F.col("url")).alias("normal"))


_FRONT = "fr AS (SELECT DISTINCT url FROM crawl_meta WHERE depth = 1)"


@query(
    _LINKS
    + f""", {_FRONT}, seen AS (SELECT DISTINCT url FROM crawl_meta WHERE depth <= 1),
n AS (SELECT l.url, min({{'referrer': l.referrer, 'pos': l.pos}}) AS f FROM links l JOIN fr ON l.referrer = fr.url WHERE l.url IS NOT NULL GROUP BY l.url)
SELECT url, 2 AS depth, f.referrer AS referrer FROM n WHERE url NOT IN (SELECT url FROM seen)"""
)
def crawl_next_frontier(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "crawl_meta")
    frontier = meta.where("depth = 1").select("url").distinct().select("url", F.lit(1).alias("depth"), F.lit(None).cast("string").alias("referrer"))
    return crawl.step(frontier, _stored_pages(spark, d), meta.where("depth <= 1").select("url"))[1]


@query(
    f"""WITH {_PAGES}, {_FRONT} SELECT fr.url, 1 AS depth, CASE WHEN html IS NULL THEN 'error' WHEN length(trim(html)) = 0 THEN 'empty' ELSE 'ok' END AS status,
cast(len(regexp_extract_all(coalesce(html, ''), {q(urls.HREF)}, 1)) AS integer) AS outlink_count, sha256(html) AS content_hash FROM fr LEFT JOIN one USING (url)"""
)
def crawl_visits(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "crawl_meta")
    frontier = meta.where("depth = 1").select("url").distinct().select("url", F.lit(1).alias("depth"), F.lit(None).cast("string").alias("referrer"))
    return crawl.step(frontier, _stored_pages(spark, d), meta.select("url").where("false"))[0].drop("referrer")


@query("SELECT count(*) AS processed, count(*) FILTER (status = 'ok') AS saved, count(DISTINCT url) AS visited, count(*) FILTER (error IS NOT NULL AND error <> '') AS errors FROM crawl_meta")
def crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    return crawl.summary(table(spark, d, "crawl_meta"))


@query("SELECT url, max(fetched_at) AS fetched_at FROM crawl_meta GROUP BY url")
def crawl_latest(spark: SparkSession, d: str) -> DataFrame:
    return crawl.latest(table(spark, d, "crawl_meta")).select("url", "fetched_at")


@query("SELECT sha256(html) AS content_hash, min(source_file) AS source_file, count(*) AS copies FROM html_to_products GROUP BY 1")
def page_contents(spark: SparkSession, d: str) -> DataFrame:
    return crawl.distinct_content(table(spark, d, "html_to_products"))


@query("SELECT source_file, '1700000000_' || substring(sha256(source_file), 1, 12) || '_' || substring(sha256(html), 1, 12) || '.html' AS file_name FROM html_to_products")
def page_file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "html_to_products").select("source_file", tx.page_file_name(F.lit(1700000000), "source_file", "html").alias("file_name"))


# Entities, articles, lookups, enrichment.

_WS = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'), ' ')"
_MAIN = f"trim(regexp_extract({_WS.format('category')}, {q(r'^([^&\-]+?)(?:\s+(?:&|and|-)|\s*$)')}, 1))"
_ENT = f"""
WITH br AS (SELECT DISTINCT brand, {_WS.format('brand')} AS brand_normalized FROM unit_tests WHERE length(trim(brand, ' ')) > 0),
ca AS (SELECT DISTINCT category, {_WS.format('category')} AS category_normalized, {_MAIN} AS category_main FROM unit_tests WHERE length(trim(category, ' ')) > 0),
i0 AS (SELECT unnest(ingredients) AS ingredient FROM unit_tests),
inn AS (SELECT DISTINCT ingredient, {_WS.format('ingredient')} AS ingredient_normalized, {_WS.format('ingredient')} IN ('water', 'salt') OR length({_WS.format('ingredient')}) < 3 AS is_generic FROM i0 WHERE length(trim(ingredient, ' ')) > 0)
"""
_TERMS = """, tt AS (SELECT brand_normalized AS t FROM br UNION ALL SELECT category_normalized FROM ca UNION ALL SELECT category_main FROM ca UNION ALL SELECT ingredient_normalized FROM inn WHERE NOT is_generic),
terms AS (SELECT DISTINCT trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS term FROM tt WHERE trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) <> '')
"""


@query(_ENT + "SELECT * FROM br")
def unique_brands(spark: SparkSession, d: str) -> DataFrame:
    return entities.brands(table(spark, d, "unit_tests"))


@query(_ENT + "SELECT * FROM ca")
def unique_categories(spark: SparkSession, d: str) -> DataFrame:
    return entities.categories(table(spark, d, "unit_tests"))


@query(_ENT + "SELECT * FROM inn")
def unique_ingredients(spark: SparkSession, d: str) -> DataFrame:
    return entities.ingredients(table(spark, d, "unit_tests"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "unit_tests")
    return entities.terms(entities.brands(p), entities.categories(p), entities.ingredients(p))


@query(_ENT + _TERMS + "SELECT * FROM terms")
def entity_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


@query(
    _ENT + _TERMS
    + f"""SELECT wiki_id, wiki_title FROM extract_wiki_articles WHERE wiki_text IS NOT NULL AND NOT regexp_matches(wiki_text, {q(wiki.REDIRECT)})
AND trim(regexp_replace(lower(wiki_title), '[^a-z0-9]+', ' ', 'g')) <> '' AND trim(regexp_replace(lower(wiki_title), '[^a-z0-9]+', ' ', 'g')) IN (SELECT term FROM terms)"""
)
def article_matches(spark: SparkSession, d: str) -> DataFrame:
    dump = table(spark, d, "extract_wiki_articles").select(F.col("wiki_id").alias("id"), F.col("wiki_title").alias("title"), F.lit(0).alias("ns"), F.col("wiki_text").alias("text"))
    return art.matching(art.content_pages(dump), _terms(spark, d)).select(F.col("id").alias("wiki_id"), F.col("title").alias("wiki_title"))


@query(
    f"""SELECT wiki_id, {_WS.format('wiki_title')} AS title_normalized, array_to_string(string_split({_WS.format('wiki_title')}, ' '), '|') AS title_tokens, regexp_matches(wiki_text, {q(wiki.INFOBOX)}) AS has_infobox,
regexp_extract(wiki_text, {q(wiki.INFOBOX_TYPE)}, 1) AS infobox_type, array_to_string(regexp_extract_all(wiki_text, {q(wiki.CATEGORY)}, 1), ';') AS categories,
{q(wiki.URL_PREFIX)} || replace(wiki_title, ' ', '_') AS wiki_url, cast(length(wiki_text) AS integer) AS text_length FROM extract_wiki_articles"""
)
def article_features(spark: SparkSession, d: str) -> DataFrame:
    f = art.featured(table(spark, d, "extract_wiki_articles").select(F.col("wiki_id").alias("id"), F.col("wiki_title").alias("title"), F.col("wiki_text").alias("text")))
    return f.select("wiki_id", "title_normalized", F.array_join("title_tokens", "|").alias("title_tokens"), "has_infobox", "infobox_type", F.array_join("categories", ";").alias("categories"), "wiki_url", "text_length")


_PARA = f"""trim(regexp_replace(regexp_extract(regexp_replace(regexp_replace(wiki_text, '\\{{\\{{[^}}]+\\}}\\}}', ' ', 'g'), '\\[\\[([^\\]]+\\|)?([^\\]]+)\\]\\]', '\\2', 'g'), {q('(?s)' + chr(92) + 'A' + r'\s*(.+?)(?:\n\s*\n|\z)')}, 1), '\\s+', ' ', 'g'))"""
_FACTS = f"""{_PARA} AS wiki_description, regexp_extract(wiki_text, {q(wiki.INTRODUCED)}, 1) AS introduced, regexp_extract(wiki_text, {q(wiki.ORIGIN)}, 1) AS origin, regexp_extract(wiki_text, {q(wiki.WEBSITE)}, 1) AS website"""
_LOOK = f"""
, af AS (SELECT *, {_FACTS}, regexp_matches(wiki_text, {q(wiki.SWEETENER)}) AS is_sweetener, regexp_matches(wiki_text, {q(wiki.ALLERGEN)}) AS is_allergen, regexp_matches(wiki_text, {q(wiki.CARCINOGEN)}) AS is_carcinogenic FROM extract_wiki_articles),
bl AS (SELECT * FROM (SELECT br.*, af.*, row_number() OVER (PARTITION BY brand ORDER BY wiki_id) AS n FROM br JOIN af ON brand_normalized = title_normalized WHERE brand_normalized <> '') WHERE n = 1),
il AS (SELECT * FROM (SELECT inn.*, af.*, row_number() OVER (PARTITION BY ingredient ORDER BY wiki_id) AS n FROM inn JOIN af ON ingredient_normalized = title_normalized WHERE ingredient_normalized <> '') WHERE n = 1)
"""


def _brand_facts(spark: SparkSession, d: str, fanout: bool = False) -> DataFrame:
    return lookups.brand_lookup(entities.brands(table(spark, d, "unit_tests")), table(spark, d, "extract_wiki_articles"), fanout)


def _ingredient_facts(spark: SparkSession, d: str) -> DataFrame:
    return lookups.ingredient_lookup(entities.ingredients(table(spark, d, "unit_tests")), table(spark, d, "extract_wiki_articles"))


@query(_ENT + _LOOK + "SELECT brand, brand_normalized, wiki_id, wiki_title, wiki_url, wiki_description, introduced, origin, website, has_infobox, infobox_type FROM bl")
def brand_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _brand_facts(spark, d).drop("categories")


@query(_ENT + "SELECT brand, wiki_id FROM br JOIN extract_wiki_articles ON brand_normalized = title_normalized WHERE brand_normalized <> ''")
def brand_lookup_fanout(spark: SparkSession, d: str) -> DataFrame:
    return _brand_facts(spark, d, True).select("brand", "wiki_id")


@query(_ENT + _LOOK + "SELECT ingredient, ingredient_normalized, wiki_id, wiki_title, wiki_description, introduced, origin, website, is_sweetener, is_allergen, is_carcinogenic, infobox_type FROM il")
def ingredient_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _ingredient_facts(spark, d).drop("categories", "wiki_url", "has_infobox")


@query(
    _ENT
    + """, t1 AS (SELECT ca.*, a.wiki_id, a.wiki_title, 'main_keyword' AS match_method, CASE WHEN a.wiki_id IS NOT NULL THEN 0.8::double ELSE 0.0::double END AS confidence
FROM ca LEFT JOIN extract_wiki_articles a ON nullif(lower(category_main), '') = a.title_normalized),
t2 AS (SELECT ca.*, a.wiki_id, a.wiki_title, 'full_name' AS match_method, CASE WHEN a.wiki_id IS NOT NULL THEN 0.75::double ELSE 0.0::double END AS confidence
FROM ca LEFT JOIN extract_wiki_articles a ON nullif(category_normalized, '') = a.title_normalized),
u AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, match_method, wiki_id NULLS LAST) AS n FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2))
SELECT category, category_normalized, category_main, wiki_id, wiki_title, match_method, confidence FROM u WHERE n = 1"""
)
def category_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookups.category_lookup(entities.categories(table(spark, d, "unit_tests")), table(spark, d, "extract_wiki_articles")).drop("wiki_description", "categories")


_ENRICH = (
    _ENT + _LOOK
    + """, ex AS (SELECT product_id, unnest(ingredients) AS ingredient FROM unit_tests),
pe AS (SELECT product_id, count(*) AS n_facts, count(*) FILTER (is_sweetener) AS sweetener_count, count(*) FILTER (is_allergen) AS allergen_count, count(*) FILTER (is_carcinogenic) AS carcinogen_count FROM ex JOIN il USING (ingredient) GROUP BY product_id),
en AS (SELECT u.product_id, u.name, bl.wiki_id AS brand_wiki_id, bl.wiki_id IS NOT NULL AS has_brand_wiki, cast(coalesce(n_facts, 0) AS integer) AS ingredients_wiki_count, coalesce(sweetener_count, 0) AS sweetener_count,
coalesce(allergen_count, 0) AS allergen_count, coalesce(carcinogen_count, 0) AS carcinogen_count, cast(coalesce(n_facts, 0) + CASE WHEN bl.wiki_id IS NOT NULL THEN 1 ELSE 0 END AS integer) AS total_wiki_matches
FROM unit_tests u LEFT JOIN bl ON u.brand = bl.brand LEFT JOIN pe ON u.product_id = pe.product_id)
"""
)


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return enrich.enrich(table(spark, d, "unit_tests"), _brand_facts(spark, d), _ingredient_facts(spark, d))


@query(_ENRICH + "SELECT * EXCLUDE (name) FROM en")
def enriched_products(spark: SparkSession, d: str) -> DataFrame:
    return _enriched(spark, d).select("product_id", F.col("brand_wiki.wiki_id").alias("brand_wiki_id"), "wiki_enrichment.*")


# The default search: two misspelt words over eleven fields of the enriched products.
_FIELD_SQL = {
    "name": "u.name", "description": "u.description", "ingredients": "array_to_string(u.ingredients, ' ')", "highlights": "u.highlights", "brand": "u.brand", "category": "u.category", "brand_description": "bl.wiki_description",
    "ingredient_wiki_names": "g.names", "ingredient_descriptions": "g.descriptions", "brand_introduced": "bl.introduced", "brand_origin": "bl.origin",
}
_DEFAULT = (
    _ENT + _LOOK
    + """, g AS (SELECT product_id, string_agg(il.ingredient, ' ') FILTER (il.ingredient <> '') AS names, string_agg(il.wiki_description, ' ') FILTER (il.wiki_description <> '') AS descriptions
FROM (SELECT product_id, unnest(ingredients) AS ingredient FROM unit_tests) x JOIN il USING (ingredient) GROUP BY product_id),
src AS (SELECT u.product_id AS doc_id, unnest([""" + ", ".join(q(f) for f in _FIELD_SQL) + "]) AS field, unnest([" + ", ".join(_FIELD_SQL.values())
    + """]) AS txt FROM unit_tests u LEFT JOIN bl ON u.brand = bl.brand LEFT JOIN g ON u.product_id = g.product_id),
tk AS (SELECT doc_id, field, CASE WHEN field IN ('brand', 'category', 'brand_introduced', 'brand_origin') THEN CASE WHEN txt <> '' THEN [lower(txt)] ELSE [] END
  ELSE regexp_extract_all(lower(txt), '[\\p{L}\\p{N}]+(?:[''’.][\\p{L}\\p{N}]+)*') END AS toks FROM src WHERE txt IS NOT NULL),
pst AS (SELECT field, term, doc_id, count(*) AS tf FROM (SELECT doc_id, field, unnest(toks) AS term FROM tk) GROUP BY ALL),
ln_ AS (SELECT field, doc_id, len(toks) AS dl FROM tk WHERE len(toks) > 0),
fs AS (SELECT field, count(*) AS doc_count, sum(dl) AS sum_tf FROM ln_ GROUP BY field),
dt AS (SELECT DISTINCT field, term FROM pst), asked AS (SELECT * FROM (VALUES (0, 'strawbery'), (1, 'yoghrut')) AS v(clause, word)),
nr AS (SELECT clause, field, term, 1.0::double - lv::double / least(length(term), length(word)) AS boost FROM (SELECT *, row_number() OVER (PARTITION BY clause, field ORDER BY lv, term) AS n
  FROM (SELECT clause, word, field, term, damerau_levenshtein(term, word) AS lv FROM dt, asked WHERE abs(length(term) - length(word)) <= 2) WHERE lv <= 2) WHERE n <= 50)"""
)


@query(
    _DEFAULT + _hits_sql("SELECT * FROM nr")
    + """, top AS (SELECT doc_id, round(sum(score), 6) AS score FROM h GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10)
SELECT doc_id, score, name, brand, category, nullif(try_cast(price AS double), 0) AS price_num FROM top JOIN unit_tests ON doc_id = product_id"""
)
def search_products(spark: SparkSession, d: str) -> DataFrame:
    return search.search_products(_fielded(spark, d), "strawbery yoghrut", catalog.SEARCH_FIELDS)


@query(_ENRICH + "SELECT product_id AS doc_id, cast(has_brand_wiki AS integer) AS has_brand_wiki, ingredients_wiki_count, cast(allergen_count AS integer) AS allergen_count, cast(sweetener_count AS integer) AS sweetener_count, "
       "cast(carcinogen_count AS integer) AS carcinogen_count, total_wiki_matches, ingredients_wiki_count > 0 AS has_json FROM en")
def catalog_points(spark: SparkSession, d: str) -> DataFrame:
    """Count points of the fielded index, and whether facts are stored as JSON."""
    c = _fielded(spark, d).catalog
    return c.select("doc_id", "has_brand_wiki", "ingredients_wiki_count", "allergen_count", "sweetener_count", "carcinogen_count", "total_wiki_matches", F.col("ingredients_wiki_json").isNotNull().alias("has_json"))


@query(
    _ENRICH
    + """SELECT count(*) AS products, count(*) FILTER (has_brand_wiki) AS with_brand, count(*) FILTER (ingredients_wiki_count > 0) AS with_ingredients, round(avg(ingredients_wiki_count), 6) AS avg_ingredients,
round(avg(sweetener_count), 6) AS avg_sweeteners, round(avg(allergen_count), 6) AS avg_allergens, round(avg(carcinogen_count), 6) AS avg_carcinogens FROM en"""
)
def enrichment_summary(spark: SparkSession, d: str) -> DataFrame:
    return enrich.summary(_enriched(spark, d))


@query(_ENRICH + "SELECT product_id, name, allergen_count FROM en ORDER BY allergen_count DESC, product_id LIMIT 5")
def most_allergens(spark: SparkSession, d: str) -> DataFrame:
    return enrich.most_allergens(_enriched(spark, d))


@query("SELECT infobox_type, count(*) AS n FROM extract_wiki_articles WHERE infobox_type <> '' GROUP BY 1 ORDER BY n DESC, infobox_type LIMIT 20")
def infobox_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extract_wiki_articles").where("infobox_type <> ''").groupBy("infobox_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "infobox_type").limit(20)


@query("SELECT category, count(*) AS n FROM unit_tests GROUP BY category")
def category_distribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "unit_tests").groupBy("category").agg(F.count("*").alias("n"))


# Statistics.

_BLOCK = "(" + " OR ".join(f"contains(lower(substring(html, 1, 200000)), {q(s)})" for s in BLOCKED) + ")"


@query(f"SELECT source_file, coalesce({_BLOCK}, false) AS blocked FROM html_to_products")
def blocked_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "html_to_products").select("source_file", stats.is_blocked(F.col("html")).alias("blocked"))


@query(
    f"""WITH m AS (SELECT content_path, min(url) AS url FROM crawl_meta WHERE content_path IS NOT NULL GROUP BY 1), j AS (SELECT coalesce(contains(url, '/products/'), false) AS product, coalesce({_BLOCK}, false) AS blocked, strlen(html) AS bytes FROM html_to_products JOIN m ON source_file = content_path)
SELECT count(*) AS files, cast(sum(bytes) AS bigint) AS bytes, round(sum(bytes) / 1048576.0::double, 4) AS mib, count(*) FILTER (product) AS product_pages, count(*) FILTER (NOT product) AS other_pages, count(*) FILTER (blocked) AS blocked_pages,
count(*) FILTER (NOT blocked) AS good_pages, round(count(*) FILTER (product) * 100.0::double / count(*), 4) AS product_share, round(count(*) FILTER (blocked) * 100.0::double / count(*), 4) AS blocked_share,
cast(coalesce(sum(bytes) FILTER (product), 0) AS bigint) AS product_bytes FROM j"""
)
def storage_statistics(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "crawl_meta").where("content_path is not null").groupBy("content_path").agg(F.min("url").alias("url"))
    return stats.storage(table(spark, d, "html_to_products").join(meta, F.col("source_file") == F.col("content_path")))


_TOK = "coalesce(len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]')), 0)"


@query(
    "SELECT count(*) AS records, cast(sum("
    + " + ".join(_TOK.format(c) for c in ("name", "brand", "category", "description", "highlights", "array_to_string(ingredients, ' ')", "concat_ws(' ', nutrition_table.energy, nutrition_table.fat, nutrition_table.protein, nutrition_table.salt, nutrition_table.carbs, nutrition_table.fibre)"))
    + ") AS bigint) AS tokens FROM unit_tests"
)
def record_tokens(spark: SparkSession, d: str) -> DataFrame:
    return stats.token_count(table(spark, d, "unit_tests").select("name", "brand", "category", "description", "highlights", "ingredients", "nutrition_table"))


_CMP = lambda c: _WS.format(_strip_sql(c))
_ACC = ("name", "brand", "category", "price", "highlights")


@query(
    "WITH x AS (SELECT product_id, " + ", ".join(f"any_value({c} ORDER BY {c}) AS {c}" for c in _ACC) + " FROM (SELECT product_id, " + ", ".join(f"min({c}) AS {c}" for c in _ACC) + " FROM postprocessing_extracted GROUP BY product_id) GROUP BY product_id), "
    "j AS (SELECT e.product_id, x.product_id IS NOT NULL AS found, " + ", ".join(f"(({_CMP('e.' + c)}) IS NOT DISTINCT FROM ({_CMP('x.' + c)})) AS {c}" for c in _ACC) + " FROM unit_tests e LEFT JOIN x USING (product_id)) "
    + " UNION ALL ".join(f"SELECT {q(c)} AS field, count(*) FILTER (found AND {c}) AS passed, count(*) AS total FROM j" for c in _ACC)
)
def extraction_accuracy(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "postprocessing_extracted").groupBy("product_id").agg(*(F.min(c).alias(c) for c in _ACC))
    return stats.accuracy(table(spark, d, "unit_tests"), got, "product_id", list(_ACC))


@query("SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    parsed = table(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT").alias("j"))
    again = parsed.select("event_id", F.from_json(F.to_json("j"), "k BIGINT").alias("j"))
    return again.select("event_id", "j.k")
