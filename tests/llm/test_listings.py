import itertools
import random

from shelfmark.llm import listings

BRANDS = [(1, "Acme"), (2, "Bell & Sons"), (3, "Crème Co")]
ROWS = [
    # id, name, brand, category, description, highlights, source
    (1, "Acme Gluten Free Blueberry Bagels 2 x 75g", "Acme", "Bakery", None, None, "s1"),
    (2, "BAGEL RINGS - Blueberries - No Gluten - 2 Pack 2.6 oz - Superb", "acne", "Bakery", None, None, "s2"),
    (3, "Blueberry Bagels (Pack of 2)", "", "Bakery & Blueberry", "Acme brings you bagels made with blueberry and a good deal of care. Variety: GF. Contents: 75g (Pack of 2)", None, "s3"),
    (4, "Acme Gluten Free Blueberry Bagels 75g", "Acme", "Bakery", None, None, "s4"),
    (5, "Acme Vegan Blueberry Bagels 2 x 75g", "Acme", "Bakery", None, None, "s5"),
    (6, "Bell and Sons Gluten Free Blueberry Bagels 2x75g", None, "Bakery", None, None, "s6"),
    (7, "Acme Gluten Free Cherry Bagels 2 x 75g", "Acme", "Bakery", None, None, "s7"),
    (8, "Acme Gluten Free Blueberry Bagels 2 x 75g", "Acme", "Bakery", None, None, "S1"),
    (9, None, None, None, None, None, None),
    (10, "", "", "", "", "", ""),
    (11, "Paper Napkins x50 Unlisted Lilac", None, None, None, None, "s8"),
    (12, "Lilac Napkins of Paper, 50 pcs, Unlistd", None, None, None, None, "s9"),
    (13, "Unlisted Lilac Paper Napkins Set of, 40", None, None, "x" * 50_000, None, "s10"),
    (14, "Acme Orange Squash 1 Litre", "Acme", None, None, None, "s11"),
    (15, "Orange Squash Concentrate - 35.2 fl oz - Acme", "Acme", None, None, None, "s12"),
]
SCHEMA = "product_id long, name string, brand string, category string, description string, highlights string, source_file string"


def reader():
    return listings.Reader([i for i, _ in BRANDS], [b for _, b in BRANDS])


def test_reading():
    r = reader()
    assert r.read(*ROWS[0][1:6]) == ("#1", "bagels", "blueberry", "gluten free", "g", 75.0, 2)
    assert r.read(*ROWS[2][1:6])[:6] == ("#1", "bagels", "blueberry", "gluten free", "g", 75.0)
    assert r.read(*ROWS[14][1:6])[1] == "squash" and r.read(*ROWS[12][1:6])[6] == 40
    assert r.read(None, None, None, None, None) == (None, None, None, None, None, None, None)
    assert listings.measure("8 Pack 150g") == ("g", 150.0, 8) and listings.measure("250g - 4 pk") == ("g", 250.0, 4) and listings.measure("6x0.5 kg") == ("g", 500.0, 6) and listings.measure("x60") == (None, None, 60)


def brute(rows):
    r = reader()
    read = {row[0]: r.read(*row[1:6]) for row in rows}

    def same(a, b):
        if None in (a[0], a[1], a[2], a[6], b[0], b[1], b[2], b[6]):
            return False
        size = a[5] == b[5] or (a[5] and b[5] and abs(a[5] / b[5] - 1) < listings.SIZE_TOLERANCE)
        brand = a[0] == b[0] or (a[0][0] == b[0][0] == "~" and abs(len(a[0]) - len(b[0])) <= 2 and a[0][:5] == b[0][:5])
        return brand and a[1:5] == b[1:5] and a[6] == b[6] and bool(size)

    return {(x, y) for x, y in itertools.combinations(sorted(read), 2) if same(read[x], read[y])}


def test_pairs_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS node", "2 AS kind", "3 AS size")
    brands = spark.createDataFrame(BRANDS, "brand_id long, brand string")
    got = {tuple(r) for r in listings.listing_pairs(df, brands).collect()}
    want = brute(ROWS) - {(1, 8)}
    assert got == want and (1, 2) in got and (1, 3) in got and (11, 12) in got and (14, 15) in got and not any(9 in p or 10 in p or 13 in p for p in got)


def test_groups(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    brands = spark.createDataFrame(BRANDS, "brand_id long, brand string")
    got = {r["product_id"]: (r["group_id"], r["links"]) for r in listings.listing_groups(df, brands).collect()}
    assert got[1] == got[2] == got[3] == got[8] == (1, 3) and got[9] == (9, 0) and got[4] == (4, 0) and got[12] == (11, 1)
    assert listings.listing_pairs(df.limit(0), brands).count() == 0


def test_components_of_chains(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4), (9, 8)], "node long, first long")
    assert {tuple(r) for r in listings.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}


def test_size_neighbours_behind_another_size(spark):
    names = ["Acme Cherry Bagels 480g", "Acme Cherry Bagels 500g", "Acme Cherry Bagels 17.6 oz"]
    df = spark.createDataFrame([(i, n, "Acme", None, None, None, f"s{i}") for i, n in enumerate(names, 1)], SCHEMA)
    brands = spark.createDataFrame(BRANDS, "brand_id long, brand string")
    assert {tuple(r) for r in listings.listing_pairs(df, brands).collect()} == {(2, 3)}


def test_typed_forms_without_common_ends(spark):
    typed = ["Quavruppdole", "Quarvuppdale", "Tolmerrind"]
    rows = [(i, "Cherry Bagels 75g", b, None, None, None, f"s{i}") for i, b in enumerate(typed, 1)]
    rows += [(4, "Cherry Bagels 2.6 oz", "Quavruppdole", None, None, None, "s4")]
    df = spark.createDataFrame(rows, SCHEMA)
    brands = spark.createDataFrame(BRANDS, "brand_id long, brand string")
    assert {tuple(r) for r in listings.listing_pairs(df, brands).collect()} == {(1, 2), (1, 4), (2, 4)}


def test_typed_pairs_against_brute_force(spark):
    r = random.Random(6)
    forms = set()
    for _ in range(80):
        word = "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 22)))
        for _ in range(5):
            w = list(word)
            for _ in range(r.randint(0, 5)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randint(0, 1)] = r.choice(["", "x", "a"])
            forms.add((r.randint(1, 2), "~" + "".join(w)))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(k, a, b) for k, a in forms for q, b in forms if k == q and a < b and max(len(a), len(b)) > 6 and distance(a, b) <= (4 if min(len(a), len(b)) > 9 else 2)}
    got = {tuple(x) for x in listings.typed_pairs(spark.createDataFrame(list(forms), "key long, brand string")).collect()}
    assert got == want and len(want) > 100


UNKNOWN = [
    (1, "Acme Tofu Blueberry 2 x 75g", "Acme", None, None, None, "s1"),
    (2, "BLUEBERRIES - Tofu - 2 Pack 2.6 oz - Acme", "Acme", None, "A good deal of care", None, "s2"),
    (3, "Acme Seitan Blueberry 2 x 75g", "Acme", None, None, None, "s3"),
    (4, "Bell & Sons Seitan Yuzu 75g", None, None, None, None, "s4"),
    (5, "Yuzu Seitan 2.6 oz Bell and Sons", None, None, None, None, "s5"),
    (6, "Quavruppdole Tofu Blueberry 40g", "Quavruppdole", None, None, None, "s6"),
    (7, "Tofu Blueberry Quavruppdole 40 g", None, None, None, None, "s7"),
    (8, "Acme Keto Blueberry Bagels 75g", "Acme", None, None, None, "s8"),
    (9, "Acme Blueberry Bagels 75g", "Acme", None, None, None, "s9"),
    (10, "Acme Blueberry Bagels 75 g", None, None, "Variety: Keto", None, "s10"),
    (11, "Keto Cherry Bagels 75g Acme", None, None, None, None, "s11"),
    (12, "Acme 75g", "Acme", None, None, None, "s12"),
    (13, "Acme Cherry Squash | x 75ml", "Acme", None, None, None, "s13"),
    (14, "Acme x Squash Cherry 75 ml", "Acme", None, None, None, "s14"),
    (15, "Acme Cherry Squash 7.5cl", "Acme", None, None, None, "s15"),
]


def test_words_on_no_list(spark):
    df = spark.createDataFrame(UNKNOWN, SCHEMA)
    brands = spark.createDataFrame(BRANDS, "brand_id long, brand string")
    assert {tuple(r) for r in listings.listing_pairs(df, brands).collect()} == {(1, 2), (4, 5), (6, 7), (8, 10), (13, 14), (13, 15), (14, 15)}
    assert [tuple(r) for r in listings.unread(df, brands).collect()] == [(15, 1)]


def test_lists_are_arguments(spark):
    df = spark.createDataFrame(UNKNOWN[:3] + UNKNOWN[11:12], SCHEMA)
    brands = spark.createDataFrame(BRANDS, "brand_id long, brand string")
    lists = listings.Lists(kinds="bean curd = tofu, seitan")
    assert {tuple(r) for r in listings.listing_pairs(df, brands, lists=lists).collect()} == {(1, 2), (1, 3), (2, 3)}
