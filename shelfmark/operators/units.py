"""Quantities in mixed units: a small grammar, dimension vectors, and canonical values.

A unit is a vector of exponents over the base dimensions, a scale and an offset:
``canonical = value * scale + offset``. An expression such as ``£1.73 / 100g`` or
``per 25 g: 493 kJ`` parses into a numerator and a denominator whose vectors subtract,
so every price per amount or energy per amount ends as one number in a known dimension.
All arithmetic is exact (fractions); rounding happens once, halves up, at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Base dimensions, in the order of every exponent vector.
DIMENSIONS = ("energy", "mass", "volume", "count", "money", "temperature")


class Unit(NamedTuple):
    """``canonical = value * scale + offset`` in the dimension ``exponents``."""

    exponents: tuple[int, ...]
    scale: Fraction
    offset: Fraction = Fraction(0)


def _dim(**exponents: int) -> tuple[int, ...]:
    return tuple(exponents.get(d, 0) for d in DIMENSIONS)


ENERGY, MASS, VOLUME, COUNT, MONEY = (_dim(**{d: 1}) for d in DIMENSIONS[:5])
_LB, _PINT, _FL_OZ = Fraction("453.59237"), Fraction("568.26125"), Fraction("28.4130625")

# Spellings of units; canonical kJ, g, ml, item, penny, kelvin.
_SPELLINGS = {
    Unit(ENERGY, Fraction(1)): "kj kilojoule kilojoules",
    Unit(ENERGY, Fraction(1000)): "mj megajoule megajoules",
    Unit(ENERGY, Fraction("4.184")): "kcal kcals cal cals calorie calories kilocalorie kilocalories",
    Unit(MASS, Fraction(1)): "g gr gram grams gramme grammes",
    Unit(MASS, Fraction(1000)): "kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes",
    Unit(MASS, Fraction(1, 1000)): "mg milligram milligrams",
    Unit(MASS, _LB): "lb lbs pound pounds",
    Unit(MASS, _LB / 16): "oz ounce ounces",
    Unit(VOLUME, Fraction(1)): "ml millilitre millilitres milliliter milliliters",
    Unit(VOLUME, Fraction(10)): "cl centilitre centilitres",
    Unit(VOLUME, Fraction(1000)): "l lt ltr ltrs litre litres liter liters",
    Unit(VOLUME, _PINT): "pint pints pt pts",
    Unit(VOLUME, _FL_OZ): "floz",
    Unit(COUNT, Fraction(1)): "each ea item items piece pieces pc pcs unit units ct",
    Unit(COUNT, Fraction(12)): "dozen doz",
    Unit(MONEY, Fraction(100)): "£ gbp",
    Unit(MONEY, Fraction(1)): "p pence penny",
    Unit(_dim(temperature=1), Fraction(1), Fraction("273.15")): "°c celsius",
    Unit(_dim(temperature=1), Fraction(5, 9), Fraction("459.67") * Fraction(5, 9)): "°f fahrenheit",
}
UNITS = {word: unit for unit, words in _SPELLINGS.items() for word in words.split()}

_GAP = "[     ]"
NUMBER = rf"\d{{1,3}}(?:{_GAP}\d{{3}})+(?!\d)(?:\.\d+)?|\d+(?:,\d{{3}})+(?!\d)(?:\.\d+)?|\d+(?:[.,]\d+)?|\.\d+"
_TOKEN = re.compile(rf"(?P<num>{NUMBER})|(?P<word>fl\.?\s*oz\.?|[£°]?[^\W\d_]+|£)|(?P<per>/)|(?P<sign>[()<>~:;,-])", re.I)
_PRICED = re.compile(r"\bpriced?\b[^.;()]{0,25}?\b(?:per|/)\s*(?P<unit>[^.;()]{1,20})", re.I)
_NAMED = re.compile(r"\benerg\w*\b[^.;]{0,40}?\b(?P<unit>kj|kcal|kilojoules?|kilocalories|kilocalorie|calories|cals?|mj)\b", re.I)
_ANY_ENERGY = re.compile(r"\b(?P<unit>kj|kcal|kilojoules?|kilocalories?|calories)\b", re.I)


def number(text: str) -> Fraction:
    """A comma or space before exactly three digits groups thousands; any other comma is a decimal mark."""
    text = re.sub(_GAP, "", text)
    if re.fullmatch(r"\d+(?:,\d{3})+(?:\.\d+)?", text):
        text = text.replace(",", "")
    return Fraction(text.replace(",", "."))


class Term(NamedTuple):
    """A parsed factor: a value (None where only a unit is written), its unit, and whether it divides."""

    value: Fraction | None
    unit: Unit | None
    divides: bool


def terms(text: str) -> Iterator[Term]:
    """Grammar: ``{[per | '/'] [currency] [number] [unit]}``, anything else separates terms."""
    value: Fraction | None = None
    money: Unit | None = None
    divides = False
    for m in _TOKEN.finditer(text):
        if m["num"]:
            if value is not None:
                yield Term(value, money, divides)
                divides, money = False, None
            value = number(m["num"])
            continue
        word = re.sub(r"[\s.]", "", (m["word"] or "")).lower()
        if m["per"] or word == "per":
            if value is not None:
                yield Term(value, money, divides)
            value, money, divides = None, None, True
            continue
        unit = UNITS.get(word)
        if unit is None:
            if value is not None:
                yield Term(value, money, divides)
                value, money, divides = None, None, False
            continue
        if word in ("£", "gbp"):
            money = unit
            continue
        if value is None and not divides:
            yield Term(None, unit, False)
            continue
        yield Term(value, unit, divides)
        value, money, divides = None, None, False
    if value is not None:
        yield Term(value, money, divides)


def canonical(value: Fraction, unit: Unit) -> Fraction:
    """A value in the canonical unit of its dimension."""
    return value * unit.scale + unit.offset


def quotient(value: Fraction, unit: Unit, per: Fraction, by: Unit) -> tuple[tuple[int, ...], Fraction] | None:
    """(exponents, canonical value) of one quantity by another: vectors subtract; None by nothing, or where a unit has a zero of its own."""
    below = per * by.scale
    if below <= 0 or unit.offset or by.offset:
        return None
    return tuple(a - b for a, b in zip(unit.exponents, by.exponents)), value * unit.scale / below


def convert(text: str, to: str) -> Fraction | None:
    """The first quantity of a text in another unit of its dimension (``350 °F`` to ``°c``); None if there is none."""
    target = UNITS[to.lower()]
    for t in terms(text):
        if t.value is not None and t.unit is not None and not t.divides and t.unit.exponents == target.exponents:
            return (canonical(t.value, t.unit) - target.offset) / target.scale
    return None


def _by(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(x - y for x, y in zip(a, b))


#: Common units by dimension: name, and how many of them one canonical unit is.
COMMON = {
    _by(ENERGY, MASS): ("kj_per_100", Fraction(100)), _by(ENERGY, VOLUME): ("kj_per_100", Fraction(100)),
    _by(MONEY, MASS): ("p_per_kg", Fraction(1000)), _by(MONEY, VOLUME): ("p_per_l", Fraction(1000)), _by(MONEY, COUNT): ("p_each", Fraction(1)),
}


def common(value: Fraction, unit: Unit, per: Fraction, by: Unit) -> tuple[str, int] | None:
    """A quotient in the common unit of its dimension, halves rounded up; None if its dimension has none."""
    got = quotient(value, unit, per, by)
    if got is None or got[0] not in COMMON:
        return None
    name, factor = COMMON[got[0]]
    return name, round_half_up(got[1] * factor)


def round_half_up(x: Fraction) -> int:
    return (2 * x.numerator + x.denominator) // (2 * x.denominator)


def energy_per_100(energy: str | None, description: str | None) -> int | None:
    """kJ per 100 g or ml; kJ wins over kcal; a bare number needs the unit named in the description."""
    if not energy:
        return None
    joule = calorie = bare = None
    portion, by = Fraction(100), UNITS["g"]
    for t in terms(energy):
        if t.unit is not None and t.unit.exponents == ENERGY and t.value is not None:
            if t.unit.scale == Fraction("4.184"):
                calorie = t if calorie is None else calorie
            else:
                joule = t if joule is None else joule
        elif t.unit is not None and t.unit.exponents in (MASS, VOLUME) and t.divides:
            portion, by = t.value if t.value is not None else Fraction(1), t.unit
        elif t.unit is None and t.value is not None and not t.divides:
            bare = t if bare is None else bare
    found = joule or calorie
    if found is not None:
        value, unit = found.value, found.unit
    elif bare is not None and description:
        named = _NAMED.search(description) or _ANY_ENERGY.search(description)
        if named is None:
            return None
        value, unit = bare.value, UNITS[named["unit"].lower()]
        for t in terms(description[named.start() : named.end() + 16]):
            if t.divides and t.unit is not None and t.unit.exponents in (MASS, VOLUME):
                portion, by = t.value if t.value is not None else Fraction(1), t.unit
    else:
        return None
    got = common(value, unit, portion, by)
    return got[1] if got else None


def _amount(text: str | None) -> tuple[Fraction, Unit] | None:
    """A price's denominator; a bare count means items; a unit in doubt (``unit?``) is none."""
    if not text or "?" in text:
        return None
    for t in terms(text):
        if t.unit is None and t.value is not None:
            return (t.value, UNITS["each"]) if t.value > 0 else None
        if t.unit is None:
            continue
        value = t.value if t.value is not None else Fraction(1)
        if value <= 0:
            return None
        if _by(MONEY, t.unit.exponents) in COMMON:
            return value, t.unit
    return None


def unit_price(price: str | None, unit: str | None, *texts: str | None) -> tuple[str, int] | None:
    """Pence per kg, litre or item; the unit is looked for beside the price, then in the other texts."""
    if not price:
        return None
    head, sep, tail = re.sub(r"\bper\b", "/", price, flags=re.I).partition("/")
    money = None
    for t in terms(head):
        if t.value is not None and (t.unit is None or t.unit.exponents == MONEY):
            money = t.value, t.unit or UNITS["£"]
            break
    if money is None:
        return None
    amount = _amount(unit) or (_amount(tail) if sep else None)
    for text in texts if amount is None else ():
        for m in _PRICED.finditer(text or ""):
            amount = amount or _amount(m["unit"])
    return common(*money, *amount) if amount else None


_ROW = "array<struct<field:string,common_unit:string,common_value:bigint>>"


def _quantities(energy: pd.Series, price: pd.Series, unit: pd.Series, description: pd.Series, highlights: pd.Series, name: pd.Series) -> pd.Series:
    out = []
    for e, p, u, d, h, n in zip(energy, price, unit, description, highlights, name):
        row = []
        if (kj := energy_per_100(e, d)) is not None and kj < 2**63:
            row.append({"field": "energy", "common_unit": "kj_per_100", "common_value": kj})
        if (x := unit_price(p, u, d, h, n)) is not None and x[1] < 2**63:
            row.append({"field": "unit_price", "common_unit": x[0], "common_value": x[1]})
        out.append(row)
    return pd.Series(out)


def common_quantities(
    df: DataFrame, id_col: str = "product_id", energy: str = "nutrition_table.energy", price: str = "unit_bundle.price", unit: str = "unit_bundle.unit",
    description: str = "description", highlights: str = "highlights", name: str = "name",
) -> DataFrame:
    """Rows ``(id, field, common_unit, common_value)``, one for every quantity that can be read.

    Narrow: one Arrow pass, no shuffle. Null or blank fields and unreadable notations give no
    row; repeated input rows give repeated rows; an empty table gives an empty result; other
    columns are ignored, so clashing names do no harm.
    """
    ship(df.sparkSession)
    q = F.pandas_udf(_quantities, _ROW)(*(F.col(c) for c in (energy, price, unit, description, highlights, name)))
    return df.select(F.col(id_col).alias(id_col), F.explode(q).alias("_q")).select(id_col, "_q.field", "_q.common_unit", "_q.common_value")
