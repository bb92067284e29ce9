import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.operators import packed


def model():
    return packed.Model(np.zeros(packed._CELLS), packed._FIRST_SPLIT)


def test_atoms_respect_brackets_quotes_and_numbers():
    text = packed.plain('Ingredients: "Flour, Wheat", Salt 4,9%, Oil (Palm, Rape [a; b]), \'Cream, Double\'.')
    atoms, between = packed.lattice(text)
    assert [packed.value_text(text[a:b]) for a, b in atoms] == ["Flour, Wheat", "Salt 4,9%", "Oil (Palm, Rape [a; b])", "Cream, Double"]
    assert between == [4, 4, 4]


def test_markup_labels_and_quotes():
    assert packed.plain("<p><b>Ingredients:</b> Salt &amp; Oil.</p>") == "Salt & Oil"
    assert packed.value_text('"Salt ""Fine"""') == 'Salt "Fine"'
    assert packed.value_text("'Baker's Yeast'") == "Baker's Yeast"
    assert model().viterbi(packed.plain("<ul><li>Salt</li><li>Colour: Carmine</li></ul>")) == ["Salt", "Colour: Carmine"]
    assert model().viterbi(packed.plain(", Salt,, Oil,")) == ["Salt", "Oil"]
    assert model().viterbi(packed.plain("INGREDIENTS - Salt")) == ["Salt"]


def test_unclosed_bracket_does_not_hide_delimiters():
    assert model().viterbi("Salt (fine, Oil, Yeast") == ["Salt (fine", "Oil", "Yeast"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ,;()[]\"'|/\n-4%", max_size=60))
def test_values_come_from_the_text(text):
    values = model().viterbi(packed.plain(text))
    assert all(v == " ".join(v.split()) and v for v in values)
    joined = "".join(c for c in text if c.isalnum())
    assert "".join(c for v in values for c in v if c.isalnum()) == joined


def brute_best(m, text):
    """Likelihood of the best segmentation by trying all."""
    atoms, between = packed.lattice(text)
    arcs = m.arcs(text, atoms, between)
    best = {0: 0.0}
    for j, row in enumerate(arcs, 1):
        best[j] = max(best[i] + s for i, _, s in row)
    return best[len(atoms)]


def test_learning_keeps_alternatives_whole(spark):
    r = random.Random(3)
    words = ["salt", "oil", "yeast", "sugar", "flour", "milk", "butter", "honey", "cocoa", "rice"]
    rows = []
    for i in range(300):
        some = r.sample(words, r.randint(1, 5))
        if i % 5 == 0:
            some[0] += " and/or substitute"
        rows.append((i, r.choice([", ", ",", " | ", "; ", " / "]).join(some)))
    df = spark.createDataFrame([*rows, (900, None), (901, "  "), (902, "salt"), (902, "salt")], "id long, ingredients string").selectExpr("*", "'x' AS pos", "'y' AS value")
    got = packed.split_values(df, "ingredients", "id").collect()
    by = {}
    for x in got:
        by.setdefault(x["id"], []).append((x["pos"], x["value"]))
    for i, text in rows:
        whole = [v.strip() for v in text.replace("and/or", "and@or").replace("|", ",").replace(";", ",").replace("/", ",").split(",")]
        assert sorted(by[i]) == list(enumerate((v.replace("@", "/") for v in whole), 1)), text
    assert 900 not in by and 901 not in by and sorted(by[902]) == [(1, "salt"), (1, "salt")]
    assert packed.split_values(df.limit(0), "ingredients", "id").count() == 0


def test_expectations_sum_to_one_segmentation():
    m = model()
    counts, splits = {}, np.zeros((2, len(packed.CLASSES)))
    m.expect("a, b / c, d", counts, splits)
    assert splits[1].sum() == 3 and 0 < splits[0].sum() < 3
    row = sum(v for k, v in counts.items() if k < packed.BUCKETS)
    assert abs(row - (1 + splits[0].sum())) < 1e-3
    assert brute_best(m, "a, b / c, d") <= 0


def test_long_text():
    text = ", ".join(f"item {chr(97 + i % 26)}" for i in range(20_000))
    assert len(model().viterbi(text)) == 20_000


def test_any_number_of_atoms_may_join():
    assert model().viterbi("E471/E472/E473/E475/E476, salt") == ["E471/E472/E473/E475/E476", "salt"]
    assert model().viterbi("a/b/c/d, e") == ["a/b/c/d", "e"]


def test_unmatched_brackets():
    assert model().viterbi("a (b, c, d (e), f, g") == ["a (b", "c", "d (e)", "f", "g"]
    assert len(model().viterbi("(" * 3000 + "a, b")) == 2 and model().viterbi("a), b") == ["a)", "b"]
    assert model().viterbi("a (b [c, d), e") == ["a (b [c", "d)", "e"]
