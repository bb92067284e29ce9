import math

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import index
from shelfmark.plans import ast, parser
from shelfmark.plans import compile as search

DOCS = [
    (1, "Dark chocolate bar", "rich dark chocolate with milk", "Snacks", 2.0),
    (2, "Milk chocolate", "chocolate dark and free of gluten", "snacks", 3.5),
    (3, "Oat drink", "gluten free drink with oats", "Drinks", None),
    (4, "Choclate spread", "milk milk milk", "Bakery", 0.0),
    (5, "", None, None, 9.0),
    (6, "Oat drink", "gluten free drink with oats", "Drinks", 4.0),
]
FIELDS = ("name", "text")


@pytest.fixture(scope="module")
def fielded(spark):
    df = spark.createDataFrame(DOCS, "id long, name string, text string, category string, price double")
    return search.build(df, "id", {"name": F.col("name"), "text": F.col("text")}, {"name": F.col("name"), "brand": F.lit("x"), "category": F.col("category"), "price_num": F.expr("nullif(price, 0)")})


def ids(index_, text, **kw):
    return sorted(r["doc_id"] for r in search.search(index_, parser.parse(text, FIELDS, ("category",)), FIELDS, None, **kw).collect())


@pytest.mark.parametrize(
    "text,want",
    [
        ("chocolate", [1, 2]), ("name:milk", [2]), ("chocolate oat", [1, 2, 3, 6]), ("chocolate AND milk", [1, 2]), ("+chocolate -rich", [2]), ("NOT rich chocolate", [2]), ("(chocolate OR oat) AND gluten", [2, 3, 6]),
        ('"dark chocolate"', [1]), ('"chocolate dark"', [2]), ('"dark chocolate"~2', [1, 2]), ('"gluten free"', [3, 6]), ('"free gluten"~2', [2, 3, 6]), ('"milk milk"', [4]), ('text:"milk milk milk"', [4]),
        ("chocolate~", [1, 2, 4]), ("choclate~1", [1, 2, 4]), ("price_num:[2 TO 4]", [1, 2, 6]), ("price_num:[* TO 3]", [1]), ("milk AND price_num:[0 TO 10]", [1, 2]), ("category:SNACKS", [1, 2]), ("chocolate AND NOT category:snacks", []),
        ("unheardof", []), ("oat AND NOT price_num:[1 TO 5]", [3]),
    ],
)
def test_match_sets(fielded, text, want):
    assert ids(fielded, text) == want


def test_scores_are_bm25(fielded):
    got = {r["doc_id"]: r["score"] for r in search.search(fielded, ast.Term("milk", ("text",)), FIELDS).collect()}
    lengths = {1: 5, 2: 6, 3: 5, 4: 3, 6: 5}
    avg = sum(lengths.values()) / 5
    idf = math.log(1 + (5 - 2 + 0.5) / (2 + 0.5))
    for d, tf in ((1, 1), (4, 3)):
        assert got[d] == pytest.approx(idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * lengths[d] / avg)), abs=1e-6)


def test_range_adds_one_and_ties_are_ordered(fielded):
    hits = search.search(fielded, ast.Bool(must=(ast.Range("price_num", 0, 100),)), FIELDS).collect()
    assert [(r["doc_id"], r["score"]) for r in hits] == [(1, 1.0), (2, 1.0), (5, 1.0), (6, 1.0)]
    assert [r["doc_id"] for r in search.search(fielded, ast.Term("oat", ("name",)), FIELDS, 1).collect()] == [3]


def test_products_and_empty_queries(fielded):
    got = search.search_products(fielded, "choclate: (bar", FIELDS, 2).collect()
    assert len(got) == 2 and set(got[0].asDict()) == {"doc_id", "score", "name", "brand", "category", "price_num"}
    assert search.search_products(fielded, " .. ", FIELDS).count() == 0
    assert parser.parse("  ", FIELDS) is None


@pytest.mark.parametrize("text", ["(a", "a)", "a AND", "AND"])
def test_bad_syntax(text):
    with pytest.raises(ValueError):
        parser.parse(text, FIELDS)


def test_clause_limit(fielded):
    with pytest.raises(ValueError):
        search.search(fielded, ast.Bool(should=tuple(ast.Term(f"w{i}", ("name",)) for i in range(5000))), FIELDS)


def test_empty_index(spark):
    df = spark.createDataFrame([], "id long, name string")
    empty = search.build(df, "id", {"name": F.col("name")}, {"name": F.col("name")})
    assert search.search(empty, ast.Term("x", ("name",)), ("name",)).count() == 0
    built = index.build(df, "id", F.col("name"))
    assert index.search(built, "x y").count() == 0


def brute_tfidf(docs, query, mode):
    import re

    toks = {i: [t.lower() for t in re.findall("[a-zA-Z0-9]+", x or "")] for i, x in docs}
    n = len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for i, t in toks.items():
        s = sum(t.count(w) * math.log(n / df[w]) for w in query if w in df)
        l2 = math.sqrt(sum((t.count(w) * math.log(n / df[w])) ** 2 for w in set(t)))
        if any(w in t for w in query):
            out[i] = round(s if mode == "idf" else (s / l2 * 100 if l2 else 0.0), 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("mode", ["idf", "idf_l2"])
def test_tfidf_against_brute_force(spark, mode):
    docs = [(1, "the cat sat the"), (2, "the dog"), (3, None), (4, ""), (5, "the cat sat the"), (6, "cat cat cat the"), (7, "the")]
    df = spark.createDataFrame(docs, "id long, text string")
    built = index.build(df, "id", F.col("text"))
    got = [(r["doc_id"], r["score"]) for r in index.search(built, "Cat the the nothing", mode, 10).collect()]
    assert got == [(i, pytest.approx(s, abs=1e-6)) for i, s in brute_tfidf(docs, ["cat", "the", "the", "nothing"], mode)]
    assert index.search(built, "", mode).count() == 0
    with pytest.raises(ValueError):
        index.search(built, "x", "other")
    meta = spark.createDataFrame([(1, "m")], "id long, label string")
    assert [(r["doc_id"], r["rank"]) for r in index.with_metadata(index.search(built, "cat"), meta, "id").collect()] == [(1, 1)]


def test_edits_against_brute_force(spark):
    import itertools

    def distance(a, b):
        """Fewest single steps (drop, add, change, swap neighbours), by breadth-first search."""
        level = {a}
        for n in range(3):
            if b in level:
                return n
            level |= {w for x in level for i in range(len(x) + 1) for w in (x[:i] + x[i + 1 :], *(x[:i] + c + x[i:] for c in "abc"), *(x[:i] + c + x[i + 1 :] for c in "abc"), x[:i] + x[i + 1 : i + 2] + x[i : i + 1] + x[i + 2 :])}
        return 3

    words = ["".join(w) for n in range(1, 5) for w in itertools.product("abc", repeat=n)]
    df = spark.createDataFrame([(w,) for w in words], "term string")
    for word in ("abca", "ab", "aabb", "cba"):
        for most in (0, 1, 2):
            got = {r["term"]: r["d"] for r in df.select("term", F.expr(search.edits("term", word, most)).alias("d")).collect()}
            assert got == {w: (d if (d := distance(w, word)) <= most else None) for w in words}
