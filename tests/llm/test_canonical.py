import random

from shelfmark.llm import canonical

ENTRIES = [(1, "Wrenfield"), (2, "Bell & Daughters"), (3, "Bakehouse Row"), (4, "sunflower oil"), (5, "salt"), (6, "guar gum"), (7, "sugar"), (8, "coconut cream"), (9, "double cream"), (10, "Mill's")]


def index():
    return canonical.Index([i for i, _ in ENTRIES], [e for _, e in ENTRIES])


def match(value):
    m = index().match(value, canonical.THRESHOLD, canonical.MARGIN)
    return m[0] if m else -1


def test_typed_forms():
    for value, want in {
        "wrenfield ": 1, "Wrenfield Ltd": 1, "by WRENFIELD®": 1, "Wrnefield": 1, "Wrenf1e1d": 1, "Wren.field": 1, "Bell and Daughters": 2, "oil, sunflower": 4, "5unf10wer 011": 4, "sunfloweroil": 4, "sunflower-oil 12%": 4,
        "organic sugar": 7, "suagr": 7, "suar": 7, "dried coconut creams": 8, "cream, double": 9, "mills": 10, "unheard of": -1, "tbc": -1, "n/a": -1, "-": -1, "glimmer syrup": -1, "cream": -1, "slat": 5, "sunfl. oil": 4,
    }.items():
        assert match(value) == want, value


def test_distance_against_brute_force():
    def brute(a, b):
        """Fewest single steps (drop, add, change, swap neighbours) by breadth-first search, up to 3."""
        found, level = {a}, {a}
        for n in range(4):
            if b in level:
                return n
            new = set()
            for w in level:
                for i in range(len(w) + 1):
                    new |= {w[:i] + c + w[i:] for c in "abc"}
                    if i < len(w):
                        new |= {w[:i] + w[i + 1 :], *(w[:i] + c + w[i + 1 :] for c in "abc")}
                    if i + 1 < len(w):
                        new.add(w[:i] + w[i + 1] + w[i] + w[i + 2 :])
            level = {w for w in new - found if len(w) <= 8}
            found |= level
        return 4

    r = random.Random(1)
    for _ in range(60):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 5))) for _ in "ab")
        assert canonical.distance(a, b, 3) == min(brute(a, b), 4)


def test_table(spark):
    rows = [(1, "Wrenfield"), (2, "wrenfield"), (2, "wrenfield"), (3, None), (4, "  "), (5, " "), (6, "nothing like it"), (7, "Wrnefield " + "x" * 30_000)]
    df = spark.createDataFrame(rows, "id long, v string").selectExpr("*", "'a' AS value", "9 AS ref_id", "'b' AS _m")
    ref = spark.createDataFrame([*ENTRIES, (11, None), (12, " ")], "k long, e string")
    got = sorted((r["id"], r["ref_id"]) for r in canonical.map_values(df, "v", "id", ref, "k", "e").collect())
    assert got == [(2, 1), (2, 1), (6, -1), (7, 1)]
    assert canonical.map_values(df.limit(0), "v", "id", ref, "k", "e").count() == 0
    assert {r["ref_id"] for r in canonical.map_values(df, "v", "id", ref.limit(0), "k", "e").collect()} == {-1}


def test_blocks_of_a_long_list_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["wrnefield", "oil sunflower", "suagr", "none of it"])], "id long, v string")
    ref = spark.createDataFrame(ENTRIES, "k long, e string")
    whole = sorted(map(tuple, canonical.map_values(df, "v", "id", ref, "k", "e").collect()))
    monkeypatch.setattr(canonical, "BLOCK", 3)
    assert sorted(map(tuple, canonical.map_values(df, "v", "id", ref, "k", "e").collect())) == whole


def test_recall_on_made_up_typos():
    r = random.Random(5)
    ix = index()
    hit = total = 0
    for i, e in ENTRIES:
        for _ in range(40):
            if len(e) < 6:
                continue
            k = r.randrange(1, len(e) - 1)
            typo = r.choice([e[:k] + e[k + 1 :], e[:k] + r.choice("aeiou") + e[k:], e[: k - 1] + e[k] + e[k - 1] + e[k + 1 :]])
            m = ix.match(typo, canonical.THRESHOLD, canonical.MARGIN)
            total += 1
            hit += m is not None and m[0] == i
    assert hit / total > 0.95
