from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.functions import urls, wiki
from shelfmark.operators import ingredients


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_tokenize(spark):
    assert one(spark, tx.tokenize("t"), t="Fab 6 X 58Ml Nestlé") == ["fab", "6", "x", "58ml", "nestl"]
    assert one(spark, tx.tokenize("t"), t=None) == []


def test_analyze(spark):
    assert one(spark, tx.analyze("t"), t="McVitie's 3.5 Crème-Brûlée!") == ["mcvitie's", "3.5", "crème", "brûlée"]


def test_normalizers(spark):
    assert one(spark, tx.normalize_alnum("t"), t="McVitie's ") == "mcvitie s"
    assert one(spark, tx.normalize_ws("t"), t="  McVitie's\t X ") == "mcvitie's x"
    assert one(spark, tx.main_keyword("t"), t="jelly & chewy sweets") == "jelly"
    assert one(spark, tx.main_keyword("t"), t="dairy-free") == ""
    assert one(spark, tx.dedupe_key("t"), t=" A &amp;  b ") == "a & b"
    assert one(spark, tx.dedupe_key("t"), t="  ") is None
    assert one(spark, tx.doc_text("a", "b", "c"), a="x", b="", c=None) == "x"


def test_strip_html(spark):
    page = "<p>Ingredients: A&amp;B<br>C</p><script>x<1</script><!-- y --><b>D</b> ."
    assert one(spark, tx.strip_html("t"), t=page) == "A&B C D"
    assert one(spark, tx.strip_html("t"), t=None) is None
    assert one(spark, tx.unescape("t"), t="&frac12; &eacute; &amp;lt;") == "½ é &lt;"


def test_unit_pair(spark):
    assert tuple(one(spark, tx.unit_pair("t"), t="0.36/100g")) == ("0.36", "100g")
    assert tuple(one(spark, tx.unit_pair("t"), t="no price")) == ("", "")
    assert one(spark, tx.unit_pair("t"), t=None) is None


def test_flags():
    assert tx.flags(["I", "S", "M"]) == "(?ims)"
    assert tx.flags("IGNORECASE|DOTALL") == "(?is)"
    assert tx.flags([]) == ""


def test_ids_and_names(spark):
    assert one(spark, tx.stable_id("t"), t="a") >= 0
    name = one(spark, tx.page_file_name(F.lit(7), "u", "h"), u="http://x", h="<p>")
    assert name.startswith("7_") and name.endswith(".html") and len(name.split("_")[1]) == 12


def test_wiki_facts(spark):
    text = "{{Infobox brand\n| founded = 1931\n| origin = [[York]]\n| website = www.x.example\n}}\n'''X''' is [[a|good]] [[thing]].\n\nMore. [[Category:Snack brands|M]]"
    f = wiki.facts(F.col("t"))
    assert one(spark, f["introduced"], t=text) == "1931"
    assert one(spark, f["origin"], t=text) == "[York"
    assert one(spark, f["website"], t=text) == "www.x.example"
    assert one(spark, f["wiki_description"], t=text) == "'''X''' is good thing."
    assert one(spark, f["introduced"], t="nothing") == ""
    feats = wiki.features(F.lit("A b"), F.col("t"))
    assert one(spark, feats["infobox_type"], t=text) == "brand\n"
    assert one(spark, feats["categories"], t=text) == ["Snack brands|M"]
    assert one(spark, feats["wiki_url"], t=text).endswith("/A_b")
    flags = wiki.health_flags(F.col("t"))
    assert one(spark, flags["is_allergen"], t="an Allergen here") and not one(spark, flags["is_sweetener"], t="an Allergen here")


def test_urls(spark):
    assert one(spark, urls.normalize(F.col("u")), u="HTTP://Shop.Example#x") == "http://shop.example/"
    assert one(spark, urls.normalize(F.col("u")), u="http://A.b/C?d=E#f") == "http://a.b/C?d=E"
    assert one(spark, urls.normalize(F.col("u")), u="/rel") is None
    base = "http://h.example/a/b?x=1"
    for link, want in {"/c": "http://h.example/c", "d": "http://h.example/a/d", "//o.example/e": "http://o.example/e", "?y=2": "http://h.example/a/b?y=2", "#f": "http://h.example/a/b?x=1", "mailto:x": None}.items():
        assert one(spark, urls.resolve(F.col("b"), F.col("l")), b=base, l=link) == want
    assert one(spark, urls.resolve(F.col("b"), F.col("l")), b=base, l="../z") == "http://h.example/z"
    assert one(spark, urls.links(F.col("h")), h="<a href='/a'></a><A HREF=\"b\">") == ["/a", "b"]
    assert one(spark, urls.in_scope(F.col("u"), "https?://h[.]example/"), u="HTTP://H.example/x")


def test_ingredient_tokens():
    assert ingredients.tokens("Citric Acid, Humectant: (Vegetable Glycerol), Oil 5%, Mix (Salt, Sugar (fine)), ") == ["Citric", "Acid", "Humectant:", "Vegetable Glycerol", "Oil", "Mix", "Salt", "Sugar (fine"]
    assert ingredients.tokens(None) == [] and ingredients.tokens("") == []
    assert ingredients.tokens("a) b") == ["a", "b"]
