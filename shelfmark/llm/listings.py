"""Product listings that describe the same item, by token-blocking metablocking.

Every listing is read into tokens (brand, kind, flavour, type, number of units, size cells, words
on no list) from all its fields. Listings with equal tokens are one node. Each node enters the
block of its rarest token, or of its rarest two, three, ... where fewer are shared by too many
nodes. Nodes of a block are the edges of a graph, weighted by the rarity of all tokens that both
ends share. Each node keeps the edges that weigh as much as what it must share with its like;
attribute rules verify the survivors, and connected components are the groups.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, ship
from . import canonical, copies

#: Sizes within this ratio are one size written in different units.
SIZE_TOLERANCE = 0.025
#: Nodes of a block that are compared with each other; larger blocks are cut by their nodes' next rarest token.
BLOCK_NODES = 48
#: A word on so many times more descriptions than names belongs to a stock phrase.
STOCK_RATIO = 4

# Kinds of product, each with its other names after "=".
KINDS = """
baked beans = beans baked; bagels = bagel rings; bin liners = refuse sacks; biscuits = bikkies; brioche rolls = brioche buns; butter = butter block; cake cases = cupcake cases;
cereal bars = bars of cereal; cheese spread = spreadable cheese; chocolate bar = bar of chocolate, choc bar; cleaning wipes = surface wipes; clothes pegs = laundry pegs; cooking sauce = cook in sauce;
cordial = cordial syrup; couscous = cous cous; crackers = cracker thins; crumpets = griddle crumpets; custard = custard sauce; dishwasher tablets = dishwasher tabs; fabric softener = fabric conditioner;
fish fillets = fillets of fish; flapjacks = flapjack squares; freezer bags = bags for freezer; fruit loaf = fruited loaf; ground coffee = coffee ground; hand soap = soap for hands; iced tea = ice tea;
jelly sweets = jellies; juice drink = fruit juice beverage; kefir = cultured kefir; marshmallows = mallows; milk drink = dairy drink; mixed vegetables = mixed veg, vegetable medley; muffins = muffin cakes;
noodles = noodle nests; nuggets = nugget bites; oat drink = oat beverage, drink made from oats; olive oil = oil of olives; paper napkins = napkins of paper; pasta sauce = sauce for pasta; pizza = stonebaked pizza;
popcorn = popped corn; porridge oats = oats for porridge; potato wedges = wedges potato; rice cakes = puffed rice cakes; rice pudding = pudding rice pot; scones = tea scones; sliced bread = bread loaf sliced;
smoothie = blended smoothie; soup = soup tin; sparkling water = fizzy water, carbonated water; squash = squash concentrate; storage tubs = tubs for storage; stuffing mix = mix for stuffing; tea lights = tealight candles;
trail mix = trail nut mix; vegetable burgers = veggie burgers, veg burgers; vinegar = table vinegar; wafers = wafer fingers; washing up liquid = dish liquid; whipping cream = cream for whipping; yogurt = yoghurt, yog
"""
# Flavours, scents and colours; plurals and accents fold by rule.
FLAVOURS = """
almond; amber; apple; apricot; artichoke; aubergine = eggplant; banana; basil; beetroot; bergamot; black pepper; blackcurrant; bluebell; blueberry; butternut; caramel; carrot; cedar; celery; charcoal; cherry; chickpea; chilli = chili;
cinnamon; clover; coconut; copper; coral; coriander = cilantro; cotton blossom; courgette = zucchini; cranberry; creme brulee; cumin; date; dill; elderflower; eucalyptus; fennel; fern; fig; freesia; fudge; garlic; ginger; gooseberry;
grapefruit; harissa; hazelnut; heather; honey; honeysuckle; horseradish; indigo; ivory; jalapeno; jasmine; kale; lavender; leek; lemon; lemon zest; lemongrass; lentil; lilac; lime; linen; magnolia; mango; maple; melon; mint; moss;
mushroom; mustard; navy; olive; onion; orange; orchid; paprika; parsley; passion fruit = passionfruit; peach; pear; peony; pesto; pine; pineapple; pistachio; plum; praline; raspberry; red pepper; rhubarb; rose; rosemary; ruby; sage;
sandalwood; sapphire; scarlet; sea breeze; sea salt; sesame; silver; spinach; strawberry; sweet potato; tarragon; teal; thyme; toffee; tomato; turmeric; turquoise; vanilla; violet; water lily; white
"""
# Types.
TYPES = """
unsweetened = no sweetening; wholegrain = whole grain; crunchy = extra crunch; vegan = 100 plant based; extra thick; fortified = with added vitamins; mini = bitesize; organic = organically produced; gluten free = gf, no gluten;
reduced salt = less salt, lower salt; low fat = lower fat; high protein = protein rich; reduced sugar = less sugar, lower in sugar; refill = re fill; biodegradable = fully degradable; concentrated = concentrate; scented = fragranced;
recycled = made from recycled material; compact = space saving; antibacterial = anti bacterial; jumbo = extra large; reusable = re usable; sensitive = for sensitive skin; long lasting = longer lasting; quick dry = fast drying; heavy duty
"""
# Words of advertising that name nothing.
PRAISE = "superb; bargain; limited offer; free delivery; everyday; best seller; must try; irresistible; top rated; special price; great value; family favourite; hot deal; perfect gift; our finest choice; tasty; premium quality; new; delicious; award winning; genuine"
_SMALL = set("a an and the of with in for from by to on made our".split())
_NO_BRAND = {"unbranded", "various", "na", "n", "tbc", "none", "unknown", "own", "generic", ""}

_G = {"g": 1.0, "gram": 1.0, "grams": 1.0, "kg": 1000.0, "kilo": 1000.0, "kilos": 1000.0, "kilogram": 1000.0, "lb": 453.59237, "lbs": 453.59237, "oz": 28.349523, "ounce": 28.349523, "ounces": 28.349523}
_ML = {"ml": 1.0, "cl": 10.0, "l": 1000.0, "ltr": 1000.0, "litre": 1000.0, "litres": 1000.0, "floz": 28.4130625, "pint": 568.26125, "pints": 568.26125}
#: What stays of a size that is written unusually.
_LEAVINGS = {*_G, *_ML, "fl", "pack", "packs", "pk", "pc", "pcs", "piece", "pieces", "ct", "count", "set", "box", "case"}
_NUM = r"\d+(?:[.,]\d+)?"
_UNIT = r"fl[\s.:;,|/-]*oz|" + "|".join(sorted([*_G, *[u for u in _ML if u != "floz"]], key=len, reverse=True))
_SIZE = re.compile(rf"(?<![\w.])(?:(?P<n1>\d+)\s*[x×]\s*)?(?P<v>{_NUM})\s*(?P<u>{_UNIT})\b\.?", re.I)
_COUNTS = [
    re.compile(r"\b(?:pack|set|box|case)[\s,;:|/-]+of[\s,;:|/-]+(\d+)\b", re.I),
    re.compile(r"(?<![\w.])(\d+)\s*(?:-\s*)?(?:pack|pk|pcs?|pieces?|ct|count)\b", re.I),
    re.compile(r"(?:(?<=\s)|(?<=^)|(?<=[(|,/\"'*;:-]))[x×]\s*(\d+)\b", re.I),
    re.compile(r"(?<![\w.])(\d+)\s*[x×](?![\w])", re.I),
]


_WORD, _QUOTE = re.compile(r"[^\W_]+"), re.compile(r"['’‘`´]")


def fold(text: str) -> list[str]:
    """Folded words; apostrophes and invisible characters vanish."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return _WORD.findall(_QUOTE.sub("", text.lower()))


@functools.lru_cache(maxsize=100_000)
def singular(word: str) -> str:
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith("oes"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 3 else word


def singular_of(column: str) -> Column:
    """``singular`` as an expression."""
    w = F.col(column)
    n = F.length(w)
    plain = F.when(w.endswith("s") & ~w.endswith("ss") & (n > 3), F.substring(w, F.lit(1), n - 1)).otherwise(w)
    return F.when(w.endswith("ies") & (n > 4), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y"))).when(w.endswith("oes"), F.substring(w, F.lit(1), n - 2)).otherwise(plain)


def _phrases(table: str, attribute: str, out: dict[tuple[str, ...], tuple[str, str]], bend: bool) -> None:
    for entry in re.split(r"[;\n]+", table):
        name, _, others = entry.partition("=")
        if not name.strip():
            continue
        for phrase in [name, *others.split(",")]:
            words = fold(phrase)
            if words:
                out[tuple(singular(w) for w in words) if bend else tuple(words)] = (attribute, " ".join(fold(name)))


class Lists(NamedTuple):
    """Known phrases, in the notation of the fixed values above; any may be empty."""

    kinds: str = KINDS
    flavours: str = FLAVOURS
    types: str = TYPES
    praise: str = PRAISE


class Reading(NamedTuple):
    """What one listing tells. ``brand`` is None or an own form (``~``) where the name may still name one beside ``rest``."""

    brand: str | None
    kind: str | None
    flavour: str | None
    type: str | None
    dim: str | None
    size: float | None
    count: int | None
    named: bool  # the name holds a listed brand
    rest: list[str]  # words of the name that are on no list
    said: list[str]  # distinct words, in the singular, of the description that are on no list


class Reader:
    """Reads a listing into attributes, given the canonical brands and lists of phrases."""

    def __init__(self, brand_ids: list[int], brands: list[str], lists: Lists = Lists()):
        self.exact: dict[tuple[str, ...], tuple[str, str]] = {}
        self.bent: dict[tuple[str, ...], tuple[str, str]] = {}
        _phrases(lists.kinds, "kind", self.exact, False)
        _phrases(lists.types, "type", self.exact, False)
        _phrases(lists.praise, "praise", self.exact, False)
        _phrases(lists.flavours, "flavour", self.bent, True)
        for i, b in zip(brand_ids, brands):
            if words := fold(b):
                for key in (tuple(words), tuple(w for w in words if w != "and") or tuple(words)):
                    self.exact[key] = ("brand", f"#{i}")
        # Lengths of the phrases that start with a word, longest first.
        self.starts: dict[str, list[int]] = {}
        self.bent_starts: dict[str, list[int]] = {}
        for table, starts in ((self.exact, self.starts), (self.bent, self.bent_starts)):
            for words in table:
                starts.setdefault(words[0], []).append(len(words))
        for starts in (self.starts, self.bent_starts):
            for w, n in starts.items():
                starts[w] = sorted(set(n), reverse=True)
        self.index = canonical.Index(brand_ids, brands)
        self.typed: dict[str, str | None] = {}

    def _at(self, words: list[str], i: int) -> tuple[tuple[str, str], int] | None:
        """The longest phrase that starts at a word, and its length."""
        hit, n = None, 0
        for k in self.starts.get(words[i], ()):
            if found := self.exact.get(tuple(words[i : i + k])):
                hit, n = found, k
                break
        for k in self.bent_starts.get(singular(words[i]), ()):
            if k > n and (found := self.bent.get(tuple(map(singular, words[i : i + k])))):
                return found, k
        return (hit, n) if hit else None

    def phrases(self, text: str) -> tuple[dict[str, str], list[str]]:
        """First phrase of each attribute, longest match first from left to right, and the words left over."""
        words = fold(text)
        got: dict[str, str] = {}
        rest: list[str] = []
        i = 0
        while i < len(words):
            if hit := self._at(words, i):
                got.setdefault(*hit[0])
                i += hit[1]
            else:
                rest.append(words[i])
                i += 1
        return got, rest

    def typed_brand(self, brand: str | None) -> str | None:
        """Canonical id of a typed brand, its own words if it is none of the list, or None."""
        if not brand or "".join(fold(brand)) in _NO_BRAND:
            return None
        if brand not in self.typed:
            if len(self.typed) > 200_000:
                self.typed.clear()
            m = self.index.match(brand, canonical.THRESHOLD, canonical.MARGIN)
            self.typed[brand] = f"#{m[0]}" if m else _mine([w for w in fold(re.sub(r"\([^()]*\)", " ", brand)) if w not in _BRAND_NOISE])
        return self.typed[brand]

    def brand_of(self, brand: str | None, rest: list[str]) -> str | None:
        """The brand, given what the fields tell and the words of the name that nothing else explains."""
        if brand and brand[0] == "#":
            return brand
        left = [w for w in rest if w not in _SMALL and not w.isdigit()]
        if not left:
            return brand
        mine = self.typed_brand(" ".join(left))
        return mine if mine and mine[0] == "#" else _mine(left)

    def read(self, name: str | None, brand: str | None, category: str | None, description: str | None, highlights: str | None) -> tuple:
        """(brand, kind, flavour, type, dimension, size, count), no word of the data being known."""
        r = self.read_all(name, brand, category, description, highlights)
        return (self.brand_of(r.brand, r.rest), *r[1:7])

    def read_all(self, name: str | None, brand: str | None, category: str | None, description: str | None, highlights: str | None) -> Reading:
        name, description = _plain(name or ""), _plain(description or "")
        got, rest = self.phrases(_strip_sizes(name))
        more, other = self.phrases(re.sub(r"\bSold by\b.*", "", description))
        last, _ = self.phrases(category or "")
        for k in ("kind", "flavour", "type"):
            if k not in got and k in more:
                got[k] = more[k]
        for k in ("flavour", "kind"):
            if k not in got and k in last:
                got[k] = last[k]
        who = got.get("brand")
        if who is None:
            typed = self.typed_brand(brand)
            said = re.match(r"(.+?) brings you ", description)
            told = self.typed_brand(said.group(1)) if said else None
            who = typed if typed and typed[0] == "#" else told or typed
        dim, size, count = measure(name)
        if size is None or count is None:
            m = re.search(r"(?:Supplied as|Net weight|Contents:|Pack size:)\s*(.+)", description)
            d2, s2, c2 = measure(m.group(1)) if m else (None, None, None)
            if size is None and count is None:
                dim, size, count = d2, s2, c2
            elif size is None and s2 is not None and (c2 or 1) == count:
                dim, size = d2, s2
        if size is not None and count is None:
            count = 1
        return Reading(who, got.get("kind"), got.get("flavour"), got.get("type"), dim, size, count, "brand" in got, rest, sorted({singular(w) for w in other}))


# Words added to brands that name nothing.
_BRAND_NOISE = set("ltd co inc plc llc foods food finest brand the by from free official store uk eu tm organic premium select range classic".split())


_APART = re.compile(rf"(?<=\d)\s*[|:;,/–-]\s*(?=(?:{_UNIT}|packs?|pk|pcs?|pieces?|ct)\b)", re.I)


def _plain(text: str) -> str:
    """Invisible characters dropped, white space collapsed, stray marks between a number and its unit removed."""
    if not text.isascii():
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return _APART.sub(" ", " ".join(text.split()))


def _mine(words: list[str]) -> str:
    """Key of a brand that is not on the list."""
    return "~" + "".join(words).translate(canonical._LOOKALIKES)


def _strip_sizes(text: str) -> str:
    text = _SIZE.sub(" ", text)
    for p in _COUNTS:
        text = p.sub(" ", text)
    return text


def measure(text: str) -> tuple[str | None, float | None, int | None]:
    """(dimension, size of one unit in g or ml, number of units) that a text states."""
    dim = size = count = None
    rest = text
    if m := _SIZE.search(text):
        u = re.sub("[^a-z]", "", m["u"].lower())
        v = float(m["v"].replace(",", "."))
        dim, size = ("g", v * _G[u]) if u in _G else ("ml", v * _ML[u])
        if m["n1"]:
            count = int(m["n1"])
        rest = text[: m.start()] + " " + text[m.end() :]
    if count is None:
        for p in _COUNTS:
            if m := p.search(rest):
                count = int(m.group(1))
                break
    return dim, size or None, count


_READ = "brand string, kind string, flavour string, type string, dim string, size double, count int, in_name boolean, rest array<string>, said array<string>"


def attributes(df: DataFrame, brands: DataFrame, id_col: str, fields: tuple[str, str, str, str, str], lists: Lists = Lists()) -> DataFrame:
    """Rows ``(_id, brand, kind, flavour, type, dim, size, count, in_name, rest, said, raw)`` as of Reader.read_all, ``raw`` a hash of the listing's words.

    The list of brands is broadcast after a size check; a longer one is mapped beforehand.
    """
    listed = _listed(brands)
    shared = df.sparkSession.sparkContext.broadcast((*listed, lists))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*shared.value)
        for b in batches:
            rows = [(i, *reader.read_all(*f)) for i, f in zip(b["_id"], b[["f0", "f1", "f2", "f3", "f4"]].itertuples(index=False))]
            out = pd.DataFrame(rows, columns=["_id", *(x.split()[0] for x in _READ.split(", "))])
            out["count"] = out["count"].astype("Int32")
            out["raw"] = [_words_hash(f) for f in b[["f0", "f1", "f3"]].itertuples(index=False)]
            yield out

    kind = df.select(id_col).schema[0].dataType
    rows = df.select(F.col(id_col).cast("string").alias("_id"), *(F.col(c).alias(f"f{k}") for k, c in enumerate(fields)))
    return rows.mapInPandas(read, f"_id string, {_READ}, raw string").withColumn("_id", F.col("_id").cast(kind))


def _listed(brands: DataFrame) -> tuple[list[int], list[str]]:
    ship(brands.sparkSession)
    listed = brands.where("brand is not null").select(F.col("brand_id").cast("bigint"), "brand").orderBy("brand_id").limit(canonical.BLOCK + 1).collect()
    if len(listed) > canonical.BLOCK:
        raise ValueError(f"more than {canonical.BLOCK} brands; map brands with map_values first")
    return [r[0] for r in listed], [r[1] for r in listed]


def _words_hash(texts: tuple) -> str | None:
    """A hash of the words of a listing in any order, None if it has no word."""
    words = sorted(w for t in texts for w in fold(t or ""))
    return hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest() if words else None


FIELDS = ("name", "brand", "category", "description", "highlights")


def readings(df: DataFrame, brands: DataFrame, id_col: str = "product_id", fields: tuple[str, str, str, str, str] = FIELDS, lists: Lists = Lists()) -> DataFrame:
    """Rows ``(_id, brand, kind, flavour, type, dim, size, count, other, told, raw)``, ``told`` if the listing can be compared.

    ``other`` holds the words of the name that are on no list but in several names of listed
    brands, or else those of the description. A word that descriptions have much oftener than
    names is a stock phrase's and not read there. Words are counted and looked up by joins, so
    that their number is not bounded; the joins are left out where the data have no such word.
    """
    read = checkpointed(attributes(df, brands, id_col, fields, lists))
    told = F.filter("rest", lambda w: ~w.isin(*sorted(_SMALL | _LEAVINGS)) & (F.length(w) > 1) & ~w.rlike(r"^\d"))
    counted = read.where("in_name").select(F.explode(told).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    known = checkpointed(counted.select(singular_of("w").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("named")).where("named > 1"))
    if known.isEmpty():
        words = read.withColumns({"named": F.array().cast("array<string>"), "said": F.array().cast("array<string>"), "left": F.col("rest")})
    else:
        said = read.select(F.explode("said").alias("word")).groupBy("word").agg(F.count("*").alias("said"))
        marks = checkpointed(known.join(said, "word", "left").select("word", (F.coalesce("said", F.lit(0)) > STOCK_RATIO * F.col("named")).alias("stock")))
        in_name = read.select("_id", F.posexplode("rest").alias("at", "w")).withColumn("word", singular_of("w")).join(marks, "word", "left")
        in_name = in_name.groupBy("_id").agg(
            F.array_sort(F.collect_set(F.when(F.col("stock").isNotNull(), F.col("word")))).alias("named"),
            F.array_sort(F.collect_list(F.when(F.col("stock").isNull(), F.struct("at", "w")))).alias("left"),
        )
        in_text = read.select("_id", F.explode("said").alias("word")).join(marks.where("not stock"), "word").groupBy("_id").agg(F.array_sort(F.collect_set("word")).alias("found"))
        words = read.drop("said").join(in_name, "_id", "left").join(in_text, "_id", "left")
        words = words.withColumns({"left": F.coalesce(F.col("left.w"), F.array()), "said": F.coalesce("found", F.array()), "named": F.coalesce("named", F.array())})
    chosen = F.when(F.size("named") > 0, F.col("named")).otherwise(F.col("said"))
    words = words.withColumn("other", F.when(F.size(chosen) > 0, F.concat_ws(" ", chosen)))
    shared = df.sparkSession.sparkContext.broadcast((*_listed(brands), lists))

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*shared.value)
        for b in batches:
            b["brand"] = [reader.brand_of(x, list(w)) for x, w in zip(b["brand"], b["left"])]
            b["count"] = b["count"].astype("Int32")
            yield b.drop(columns="left")

    kind = df.select(id_col).schema[0].dataType
    columns = ["brand", "kind", "flavour", "type", "dim", "size", "count", "other", "raw"]
    open_ = words.where("brand is null or brand not like '#%'").select(F.col("_id").cast("string").alias("_id"), *columns, "left")
    schema = "_id string, brand string, kind string, flavour string, type string, dim string, size double, count int, other string, raw string"
    open_ = open_.mapInPandas(named, schema).withColumn("_id", F.col("_id").cast(kind))
    words = words.where("brand like '#%'").select("_id", *columns).unionByName(open_)
    what = (F.col("kind").isNotNull() & F.col("flavour").isNotNull()) | F.col("other").isNotNull()
    return words.withColumn("told", F.col("brand").isNotNull() & F.col("count").isNotNull() & what)


def unread(df: DataFrame, brands: DataFrame, id_col: str = "product_id", fields: tuple[str, str, str, str, str] = FIELDS, lists: Lists = Lists()) -> DataFrame:
    """One row: how many listings there are, and how many can only be grouped with listings of the same words since they do not tell enough."""
    return readings(df, brands, id_col, fields, lists).agg(F.count("*").alias("listings"), F.count(F.when(~F.col("told"), 1)).alias("unread"))


#: What two listings of one product must share, beside a size within the tolerance; ``maker`` stands for the brand or two typed forms of one.
_MUST = ("maker", "kind", "flavour", "type", "other", "dim", "count")


def _tokens(rows: DataFrame) -> DataFrame:
    """``rows`` with ``must`` and ``cells``: hashes of the tokens that its like must share, and of the size cells, one of which its like shares."""
    token = lambda c: F.xxhash64(F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))
    width = 4 * math.log1p(SIZE_TOLERANCE)
    cell = lambda shift: F.xxhash64(F.lit(f"size{shift}"), F.coalesce("dim", F.lit("")), F.coalesce(F.floor(F.log("size") / width + shift), F.lit(-(1 << 40))))
    return rows.withColumns({"must": F.array(*map(token, _MUST)), "cells": F.array(cell(0.0), cell(0.5))})


def blocks(rows: DataFrame, most: int = BLOCK_NODES) -> DataFrame:
    """``rows`` (of nodes) with ``block``, ``last``, ``must`` and ``cells``, the latter two as (token, rarity).

    A node's block is that of its rarest token; where that token is on more than ``most`` nodes, of its two
    rarest, and so on. The sizes of all these blocks are counted. Like nodes have equal
    tokens but for the size, so they always choose the same block. ``last``: all tokens are in the block's key.
    """
    rows = checkpointed(_tokens(rows))
    n = rows.count()
    df = rows.select(F.explode(F.array_union("must", "cells")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    rarity = F.log(1 + F.lit(float(n)) / F.col("df"))
    each = rows.select("row", F.explode(F.concat(F.transform("must", lambda t: F.struct(t.alias("token"), F.lit(True).alias("is_must"))), F.transform("cells", lambda t: F.struct(t.alias("token"), F.lit(False).alias("is_must"))))).alias("t"))
    each = each.select("row", "t.token", "t.is_must").join(df, "token").select("row", "is_must", F.struct(rarity.alias("rarity"), "token").alias("t"))
    weighed = each.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_must"), F.col("t"))), asc=False).alias("must"), F.collect_list(F.when(~F.col("is_must"), F.col("t"))).alias("cells")
    )
    # Keys of the rarest token, the rarest two, ...: one path for all nodes with the same tokens.
    keys = F.transform(F.sequence(F.lit(1), F.size("must")), lambda k: F.struct(k.alias("level"), F.xxhash64(F.slice(F.col("must.token"), 1, k)).alias("key")))
    weighed = checkpointed(weighed.withColumn("keys", keys))
    sizes = weighed.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count("*").alias("nodes"))
    fits = weighed.select("row", F.explode("keys").alias("k")).join(sizes, "k").where((F.col("nodes") <= most) | (F.col("k.level") == len(_MUST)))
    chosen = fits.groupBy("row").agg(F.min("k").alias("k"))
    out = rows.drop("must", "cells").join(weighed.drop("keys"), "row").join(chosen, "row")
    return out.withColumn("block", F.col("k.key")).withColumn("last", F.col("k.level") == len(_MUST)).drop("k")


def _near(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b)) | (F.abs(F.log(F.col(a)) - F.log(F.col(b))) <= math.log1p(SIZE_TOLERANCE))


def graph_links(rows: DataFrame, most: int = BLOCK_NODES) -> DataFrame:
    """Rows ``(node, first)``: verified edges of the pruned graph over ``rows (row, node, maker, ..., size)``.

    In blocks of at most ``most`` nodes every two are an edge. In a larger block all tokens but the size
    are the same, and edges go to the nearest smaller size (within cells of the size, on two grids,
    so that no block is one task): neighbours make the same groups as all pairs.
    """
    b = checkpointed(blocks(rows, most))
    sizes = b.groupBy("block", "last").agg(F.count("*").alias("nodes"))
    large = sizes.where(F.col("last") & (F.col("nodes") > most)).select("block", "last")
    small = b.join(large, ["block", "last"], "left_anti")
    side = ["row", "node", "size", "must", "cells", *_MUST]
    a, c = (small.select("block", "last", *(F.col(x).alias(f"{x}_{s}") for x in side)) for s in "ab")
    edges = a.join(c, ["block", "last"]).where("row_a < row_b and node_a != node_b")
    weight = lambda x: F.aggregate(x, F.lit(0.0), lambda s, t: s + t["rarity"])
    shared = F.array_intersect(F.concat("must_a", "cells_a"), F.concat("must_b", "cells_b"))
    # Each end keeps an edge that weighs at least what the end shares with its like: all it must, and a size cell.
    need = lambda s: weight(F.col(f"must_{s}")) + F.array_min(F.col(f"cells_{s}.rarity")) - 1e-9
    kept = edges.withColumn("weight", weight(shared)).where((F.col("weight") >= need("a")) & (F.col("weight") >= need("b")))
    alike = _near("size_a", "size_b")
    for c in _MUST:
        alike = alike & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    links = kept.where(alike).select(F.greatest("node_a", "node_b").alias("node"), F.least("node_a", "node_b").alias("first"))

    chained = b.join(large, ["block", "last"], "left_semi").select("block", "node", "size", F.explode("cells.token").alias("cell"))
    order = Window.partitionBy("block", "cell").orderBy("size", "node")
    chained = chained.select("node", "size", F.lag("node").over(order).alias("first"), F.lag("size").over(order).alias("before"))
    chained = chained.where("first is not null and first != node").where(_near("size", "before"))
    return links.unionByName(chained.select(F.greatest("node", "first").alias("node"), F.least("node", "first").alias("first"))).distinct()


def listing_groups(df: DataFrame, brands: DataFrame, id_col: str = "product_id", fields: tuple[str, str, str, str, str] = FIELDS, lists: Lists = Lists()) -> DataFrame:
    """Rows ``(id, group_id, links)``: the group of each listing (its smallest id) and to how many other listings it is linked.

    A listing whose fields do not tell brand, kind and flavour (or words of the data in their
    place), and size or number is grouped with the listings of the same words in name, brand and
    description, and alone if it has no word. Equal listings are one node however many there are
    (map-side combined). Typed brands meet under a maker of each two forms that agree.
    """
    read = readings(df, brands, id_col, fields, lists)
    node = ["brand", "kind", "flavour", "type", "other", "dim", "size", "count"]
    read = checkpointed(read.withColumn("raw", F.when(~F.col("told"), F.coalesce("raw", F.concat(F.lit("id "), F.col("_id").cast("string"))))))
    read = read.withColumns({c: F.when(F.col("told"), F.col(c)) for c in node})
    same = [*node, "raw"]
    nodes = checkpointed(read.groupBy(*same).agg(F.min("_id").alias("node"), F.count("*").alias("n")))
    told = nodes.where("raw is null").drop("raw", "n")

    own = told.select("node", *node, F.col("brand").alias("maker"))
    key = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in node if c not in ("brand", "size")))
    typed = told.where("brand not like '#%'").withColumn("key", key)
    forms = checkpointed(typed_pairs(typed.select("key", "brand").distinct()))
    maker = F.concat_ws("|", "brand", "other").alias("maker")
    ends = forms.select("key", "brand", maker).unionByName(forms.select("key", F.col("other").alias("brand"), maker))
    both = typed.join(ends, ["key", "brand"]).select("node", *node, "maker")
    rows = own.unionByName(both).withColumn("row", F.concat_ws(" ", F.col("node").cast("string"), "maker"))
    groups = components(checkpointed(graph_links(rows)))

    mine = nodes.select(*(F.col(c).alias(f"n_{c}") for c in (*same, "node")))
    member = read.join(mine, [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in same]).select("_id", F.col("n_node").alias("node"))
    member = member.join(groups, "node", "left").select("_id", F.coalesce("group", "node").alias("group"))
    size = member.groupBy("group").agg(F.count("*").alias("n"), F.min("_id").alias("group_id"))
    return member.join(size, "group").select(F.col("_id").alias(id_col), "group_id", (F.col("n") - 1).cast("bigint").alias("links"))


def typed_pairs(forms: DataFrame) -> DataFrame:
    """Rows ``(key, brand, other)``, ``brand < other``: typed forms of one brand that share a key, given distinct ``(key, brand)``.

    Two forms agree within 4 edits if both are longer than 9 characters, else within 2. One
    cut into more pieces than there may be edits keeps a piece whole in the other, moved by
    no more places than that: forms meet by such pieces, and no pair is missed.
    """
    edits = lambda n: F.when(n > 9, 4).otherwise(2)
    n = F.length("brand")
    count = edits(n) + 1
    cut = lambda k: F.floor(k * F.col("n") / F.col("count")).cast("int")
    pieces = forms.withColumns({"n": n, "count": count}).where("n >= count").select("key", "brand", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("k"), "n", "count")
    pieces = pieces.select("key", "brand", cut(F.col("k")).alias("at"), F.substring(F.col("brand"), cut(F.col("k")) + 1, cut(F.col("k") + 1) - cut(F.col("k"))).alias("piece"))
    # Lengths of the pieces of a form up to 4 shorter or longer.
    longest = F.greatest(F.lit(1), F.ceil((n + 4) / 5), F.when(n <= 13, 3).otherwise(1)).cast("int")
    shortest = F.greatest(F.lit(1), F.floor(F.least((n - 4) / 3, (n - 4) / 5))).cast("int")
    parts = forms.select("key", F.col("brand").alias("other"), n.alias("n"), F.explode(F.sequence(shortest, longest)).alias("size")).where("size <= n")
    parts = parts.select("key", "other", "size", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))).alias("there"))
    parts = parts.select("key", "other", "there", F.substring(F.col("other"), F.col("there") + 1, F.col("size")).alias("piece"))
    met = pieces.join(parts, ["key", "piece"]).where("brand != other").where(F.abs(F.col("at") - F.col("there")) <= 4)
    met = met.select("key", F.least("brand", "other").alias("brand"), F.greatest("brand", "other").alias("other")).distinct()
    return met.where((F.greatest(n, F.length("other")) > 6) & (F.levenshtein("brand", "other") <= edits(F.least(n, F.length("other")))))


def components(links: DataFrame) -> DataFrame:
    """Rows ``(node, group)``: connected components by min-label steps with pointer jumping, checkpointed each round."""
    both = links.select("node", F.col("first").alias("other")).unionByName(links.select(F.col("first").alias("node"), F.col("node").alias("other"))).distinct()
    labels = checkpointed(both.select("node").distinct().withColumn("group", F.col("node")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other"}), "other").groupBy("node").agg(F.min("group").alias("near"))
        step = labels.join(near, "node").select("node", F.col("group").alias("old"), F.least("group", "near").alias("via"))
        jumped = step.join(labels.select(F.col("node").alias("via"), F.col("group").alias("far")), "via", "left")
        new = checkpointed(jumped.select("node", "old", F.least("via", F.coalesce("far", "via")).alias("group")))
        if new.where("group != old").isEmpty():
            return new.select("node", "group")
        labels = new.select("node", "group")


def listing_pairs(df: DataFrame, brands: DataFrame, id_col: str = "product_id", fields: tuple[str, str, str, str, str] = FIELDS, lists: Lists = Lists()) -> DataFrame:
    """Rows ``(id_a, id_b)``, ``id_a < id_b``: pairs of one group that are not formatting copies of each other; large groups are cut into blocks of rows."""
    g = listing_groups(df, brands, id_col, fields, lists).where("links > 0").select(id_col, F.col("group_id").alias("_group"))
    c = copies.copy_classes(df, id_col).select(id_col, F.col("class_id").alias("_class"))
    return copies.pairs_within(g.join(c, id_col).distinct(), id_col, "_group", "_class")
