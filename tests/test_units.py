from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from shelfmark.operators import units


@pytest.mark.parametrize(
    "energy,description,kj",
    [
        ("1 800 kJ/430 kcal", None, 1800), ("1,238 kJ/296 kcal", None, 1238), ("297kcal/1244kJ", None, 1244), ("2290KJ(547KCAL)", None, 2290), ("Energy 2155 kJ (515 kcal)", None, 2155),
        ("163,1 kcal", None, 682), ("456 cals", None, 1908), ("191 Cal", None, 799), ("2.18MJ", None, 2180), ("per 25 g: 493 kJ", None, 1972), ("95 kcal / 20g portion", None, 1987), ("833kJ per 45g serving", None, 1851),
        ("1 182 kJ/283 kcal", None, 1182), ("85", "Typical values per 100g (energy: kcal)", 356), ("85", "Energy is stated in kilojoules", 85), ("85", "nothing said", None), ("85", None, None),
        ("", None, None), ("trace", "energy in kJ", None), (None, "energy in kJ", None), ("0.5 kJ", None, 1), ("1.5kJ", None, 2),
    ],
)
def test_energy(energy, description, kj):
    assert units.energy_per_100(energy, description) == kj


@pytest.mark.parametrize(
    "price,unit,texts,expected",
    [
        ("£1.73 / 100g", None, (), ("p_per_kg", 1730)), ("12.18/10", "", (), ("p_each", 122)), ("15p", "kg", (), ("p_per_kg", 15)), ("996 pence", "75cl", (), ("p_per_l", 1328)), ("GBP 0.22", "per item", (), ("p_each", 22)),
        ("10,06", "fl oz", (), ("p_per_l", 35406)), ("2.30", "lb", (), ("p_per_kg", 507)), ("1.2", "dozen", (), ("p_each", 10)), ("2", "per 10", (), ("p_each", 20)), ("5", "pint", (), ("p_per_l", 880)),
        ("3.50", "unit?", ("Price shown per kg",), ("p_per_kg", 350)), ("3.50", None, ("Pack of 6", "(price per 100 each)"), ("p_each", 4)), ("3.50", None, ("250g pack",), None), ("POA", "kg", (), None), (None, "kg", (), None), ("", "kg", (), None),
        ("1.00", "0g", (), None), ("0.005", "kg", (), ("p_per_kg", 1)),
    ],
)
def test_unit_price(price, unit, texts, expected):
    assert units.unit_price(price, unit, *texts) == expected


def test_offset_units():
    c, f = units.UNITS["°c"], units.UNITS["°f"]
    assert 100 * c.scale + c.offset == 212 * f.scale + f.offset


@given(st.fractions(min_value=0, max_value=10**6))
def test_halves_round_up(x):
    r = units.round_half_up(x)
    assert r - x <= 0.5 and x - r < 0.5


@given(st.text(max_size=60), st.text(max_size=40))
def test_never_raises(a, b):
    units.energy_per_100(a, b)
    units.unit_price(a, b, a, b)


def test_table(spark):
    rows = [
        (1, "100 kJ", "1.00", "kg", None, None, None, "x"), (1, "100 kJ", "1.00", "kg", None, None, None, "x"), (2, None, None, None, None, None, None, None), (3, "", " ", "", "", "", "", ""),
        (4, "50 kcal " + "x" * 100_000, "2", None, None, "Price shown per litre", None, "y"),
    ]
    df = spark.createDataFrame(rows, "product_id long, energy string, price string, unit string, description string, highlights string, name string, field string")
    got = units.common_quantities(df, "product_id", "energy", "price", "unit")
    assert sorted(map(tuple, got.collect())) == [(1, "energy", "kj_per_100", 100)] * 2 + [(1, "unit_price", "p_per_kg", 100)] * 2 + [(4, "energy", "kj_per_100", 209), (4, "unit_price", "p_per_l", 200)]
    assert units.common_quantities(df.limit(0), "product_id", "energy", "price", "unit").count() == 0


def test_offsets_and_dimensions():
    assert units.convert("Bake at 350 °F", "°c") == Fraction(1590, 9) and units.convert("0 °C", "°f") == 32 and units.convert("1.5 l", "ml") == 1500 and units.convert("5 g", "ml") is None
    kj, g, c = units.UNITS["kj"], units.UNITS["g"], units.UNITS["°c"]
    assert units.common(Fraction(4), kj, Fraction(2), g) == ("kj_per_100", 200) and units.common(Fraction(4), g, Fraction(2), kj) is None
    assert units.quotient(Fraction(1), c, Fraction(1), g) is None and units.quotient(Fraction(1), kj, Fraction(0), g) is None
