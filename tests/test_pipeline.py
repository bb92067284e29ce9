import json

import pytest
from pyspark.sql import functions as F

from shelfmark import cli, schemas
from shelfmark.functions import urls
from shelfmark.operators import articles, crawl, enrich, entities, extract, lookups, stats
from shelfmark.sources import readers, sinks

PAGE = """<html><head><title>x</title></head><body class="p"><h1 class="t">{name}</h1>
<p class="a">£{price}</p>
<p>£{unit}</p>
<h3>Highlights</h3><ul><li>Good</li><li>Small &amp; neat</li></ul>
<h3>Description</h3><div><span>First</span><br><span>Second</span></div>
<h3>Ingredients</h3><div>{ingredients}</div>
<h3>Nutrition</h3><table><tr><th>Energy</th><td>100kJ</td></tr><tr><th>Fat</th><td>&lt;0.5g</td></tr></table>
<a href="/c">View all Snacks</a> <a href="/b">View all {brand}</a></body></html>"""

PAGES = [
    ("p1.html", PAGE.format(name="Bar &amp; Co", price="2.50", unit="0.36/100g", ingredients="Ingredients: Salt, Oil (Palm, Rape) 5%,\nMilk", brand="Acme")),
    ("p2.html", PAGE.format(name="bar &amp; co", price="3.00", unit="8.00/kg", ingredients="", brand="B&amp;C")),
    ("p3.html", "<h1>No body</h1><p>£1.2.3</p>"),
    ("p4.html", "<body><h1> </h1></body>"),
    ("p5.html", None),
    ("p6.html", ""),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, schemas.HTML_PAGES)


def test_raw_and_clean(pages):
    raw = {r["source_file"]: r for r in extract.raw_products(pages).collect()}
    a = raw["p1.html"]
    assert (a["name"], a["brand"], a["category"], a["price"], a["unitpair"]) == ("Bar & Co", "Acme", "Snacks", "2.50", "0.36/100g")
    assert a["nutrition_table"]["fat"] == "<0.5g" and a["nutrition_table"]["salt"] is None
    assert raw["p2.html"]["brand"] == "B&C" and raw["p3.html"]["price"] == "1.2.3" and raw["p4.html"]["name"] is None and raw["p5.html"]["name"] is None
    clean = {r["source_file"]: r for r in extract.clean_products(extract.raw_products(pages)).collect()}
    assert clean["p1.html"]["ingredients"] == ["Salt", "Oil", "Palm", "Rape", "Milk"]
    assert clean["p1.html"]["highlights"] == "Good Small & neat" and clean["p1.html"]["unit_bundle"]["unit"] == "100g" and clean["p1.html"]["price_num"] == 2.5
    assert clean["p3.html"]["price_num"] is None and clean["p3.html"]["unit_bundle"] is None and clean["p2.html"]["ingredients"] == []
    lines = extract.clean_products(extract.raw_products(pages), "lines").where("source_file = 'p1.html'").first()
    assert lines["description"] == "First Second"


def test_gate_dedupe_serial(pages):
    raw = extract.raw_products(pages)
    assert {r["source_file"] for r in extract.complete(raw).collect()} == {"p1.html", "p2.html", "p3.html"}
    assert {r["source_file"] for r in extract.first_by_name(raw).collect()} == {"p1.html", "p3.html"}
    serial = extract.with_serial(pages, ["source_file"]).collect()
    assert sorted((r["source_file"], r["serial"]) for r in serial) == [(f"p{i}.html", i) for i in range(1, 7)]


def test_entities_to_enrichment(spark):
    products = spark.createDataFrame(
        [(1, "A", "Acme", "jelly & sweets", ["Sugar", "Salt", "Gum"]), (2, "B", "acme ", None, []), (3, "C", None, " ", None), (4, "D", "Other", "dairy-free", ["Gum", "Sugar", "Sugar"])],
        "product_id long, name string, brand string, category string, ingredients array<string>",
    )
    b, c, i = entities.brands(products), entities.categories(products), entities.ingredients(products)
    assert {tuple(r) for r in c.collect()} == {("jelly & sweets", "jelly & sweets", "jelly"), ("dairy-free", "dairy-free", "")}
    assert {r["ingredient"] for r in i.where("is_generic").collect()} == {"Salt"}
    terms = entities.terms(b, c, i)
    assert {r["term"] for r in terms.collect()} == {"acme", "other", "jelly sweets", "jelly", "dairy free", "sugar", "gum"}
    dump = spark.createDataFrame(
        [(1, "Acme", 0, "'''Acme''' founded in 1900."), (2, "ACME", 0, "Second."), (3, "Sugar", 0, "a sweetener"), (4, "Gum", 0, "an allergen"), (5, "Gum", 1, "x"), (6, "Jelly", 0, "#REDIRECT [[x]]"), (7, "日本", 0, "t"), (8, "Jelly", 0, None), (9, "Jelly", 0, "soft")],
        "id long, title string, ns int, text string",
    )
    found = articles.featured(articles.matching(articles.content_pages(dump), terms))
    assert {r["wiki_id"] for r in found.collect()} == {1, 2, 3, 4, 9}
    bl, il = lookups.brand_lookup(b, found), lookups.ingredient_lookup(i, found)
    assert sorted((r["brand"], r["wiki_id"], r["introduced"]) for r in bl.collect()) == [("Acme", 1, "1900"), ("acme ", 1, "1900")]
    assert lookups.brand_lookup(b, found, fanout=True).count() == 4
    cl = {r["category"]: r for r in lookups.category_lookup(c, found).collect()}
    assert cl["jelly & sweets"]["wiki_id"] == 9 and cl["jelly & sweets"]["confidence"] == 0.8 and cl["dairy-free"]["confidence"] == 0.0
    rich = {r["product_id"]: r for r in enrich.enrich(products, bl, il).collect()}
    assert rich[1]["wiki_enrichment"]["total_wiki_matches"] == 3 and rich[1]["sweetener_count"] == 1 and rich[1]["allergen_count"] == 1
    assert rich[3]["ingredients_wiki"] == [] and rich[3]["brand_wiki"] is None and rich[4]["sweetener_count"] == 2
    assert enrich.summary(enrich.enrich(products, bl, il)).first()["products"] == 4
    assert [r["product_id"] for r in enrich.most_allergens(enrich.enrich(products, bl, il), 2).collect()] == [1, 4]


def test_crawl(spark):
    root = "http://s.example/"
    stored = spark.createDataFrame(
        [(root, "<a href='/a'></a><a href='/b#x'></a><a href='http://off.example/'></a>"), ("http://s.example/a", "<a href='/b'></a><a href='/c'></a>"), ("http://s.example/b", " ")], "url string, html string"
    )
    got = {r["url"]: (r["depth"], r["status"], r["referrer"]) for r in crawl.crawl(root, stored, r"http://s\.example/").collect()}
    assert got == {root: (0, "ok", None), "http://s.example/a": (1, "ok", root), "http://s.example/b": (1, "empty", root), "http://s.example/c": (2, "error", "http://s.example/a")}
    assert crawl.crawl(root, stored, r"http://s\.example/", max_pages=2).count() == 2
    logs = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    assert [r["url"] for r in crawl.resume(root, logs("a"), logs("a", "b", "b")).collect()] == ["b"]
    assert [r["url"] for r in crawl.resume(root, logs("a"), logs("a")).collect()] == [root]
    rules = spark.createDataFrame([("s.example", "/b", False), ("s.example", "/", True)], "host string, path string, allow boolean")
    assert sorted(r["url"] for r in crawl.allowed(logs("http://s.example/a", "http://s.example/b1", "http://o.example/b"), rules).collect()) == ["http://o.example/b", "http://s.example/a"]


def test_statistics(spark):
    files = spark.createDataFrame([("http://s/products/1", "ok"), ("http://s/x", "ACCESS to this page has been DENIED"), (None, None)], "url string, html string")
    r = stats.storage(files).first()
    assert (r["files"], r["product_pages"], r["blocked_pages"], r["good_pages"], r["bytes"]) == (3, 1, 1, 2, 37)
    assert stats.storage(files.limit(0)).first()["product_share"] == 0.0
    nested = spark.createDataFrame([("a b", ["c"], {"k": "d e"}, ("f.", None))], "x string, y array<string>, m map<string,string>, s struct<p:string,q:string>")
    assert tuple(stats.token_count(nested).first()) == (1, 7)
    schema = "source_file string, name string, ingredients array<string>, nutrition_table map<string,string>, unit_bundle struct<price:string,unit:string>"
    e = spark.createDataFrame([("p", "A &amp; b", ["X", "y"], {"fat": "1g"}, ("1", "kg")), ("q", None, None, None, None), ("r", "z", [], {}, None)], schema)
    x = spark.createDataFrame([("p", " a & B", ["x", "Y"], {"fat": "1g", "salt": None}, ("1", "kg")), ("q", "n", None, {"fat": "2"}, None)], schema)
    got = {r["field"]: (r["passed"], r["total"]) for r in stats.accuracy(e, x, "source_file", ["name", "ingredients", "nutrition_table", "unit_bundle"]).collect()}
    assert got == {"name": (1, 3), "ingredients": (2, 3), "nutrition_table": (1, 3), "unit_bundle": (1, 3)} or got["unit_bundle"] in ((1, 3), (2, 3))


def test_files_and_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "pages"
    folder.mkdir()
    for name, page in PAGES:
        if page:
            (folder / name).write_text(page, encoding="utf-8")
    read = readers.html_pages(spark, str(folder / "*.html"))
    assert read.count() == 4
    assert readers.file_sizes(spark, str(folder)).agg(F.sum("length")).first()[0] == sum(len(p.encode()) for _, p in PAGES if p)
    out = str(tmp_path / "products")
    assert cli.main(["extract", "--pages", str(folder / "*.html"), "--out", out], spark) == 0
    p = readers.products(spark, out)
    assert {r["name"] for r in p.collect()} == {"Bar & Co", "No body"}
    e, a, lk, en, ix, fx = (str(tmp_path / n) for n in ("entities", "articles", "lookups", "enriched", "index", "fielded"))
    cli.main(["entities", "--products", out, "--out", e], spark)
    dump = tmp_path / "dump.xml"
    dump.write_text("<mediawiki><page><title>Acme</title><ns>0</ns><id>7</id><revision><text>Acme, founded 1950.</text></revision></page><page><title>Milk</title><ns>0</ns><id>8</id><revision><text bytes='3'>an allergen</text></revision></page></mediawiki>")
    cli.main(["articles", "--dump", str(dump), "--entities", e, "--out", a], spark)
    assert {r["wiki_id"] for r in spark.read.parquet(a).collect()} == {7, 8}
    cli.main(["lookups", "--entities", e, "--articles", a, "--out", lk], spark)
    cli.main(["enrich", "--products", out, "--lookups", lk, "--out", en], spark)
    assert spark.read.json(en).where("allergen_count = 1").count() == 1
    cli.main(["build-index", "--products", out, "--out", ix], spark)
    cli.main(["query", "--index", ix, "--products", out, "--mode", "idf", "bar"], spark)
    cli.main(["build-fielded-index", "--products", en, "--out", fx], spark)
    cli.main(["search", "--index", fx, "mlk"], spark)
    golden = tmp_path / "golden.json"
    golden.write_text(json.dumps({"name": "x", "source_file": "y"}))
    cli.main(["test", "--golden", str(golden), "--pages", str(folder / "*.html")], spark)
    read.selectExpr("source_file AS url", "html").write.parquet(str(tmp_path / "tab"))
    cli.main(["stats", "--pages", str(tmp_path / "tab")], spark)
    assert "Bar & Co" in capsys.readouterr().out


def test_push_log_keeps_its_order(spark, tmp_path):
    (tmp_path / "log1.txt").write_text("http://b/\nhttp://a/\n\nhttp://b/\n")
    (tmp_path / "log2.txt").write_text("http://c/\nhttp://a/\n")
    assert [r["url"] for r in readers.push_log(spark, str(tmp_path)).orderBy("at").collect()] == ["http://b/", "http://a/", "http://c/"]


def test_dots_in_addresses(spark):
    from urllib.parse import urljoin

    links = ["../x", "./y", "../../../z?q=../a", "a/../b", "..", ".", "/p/./q/../r", "//h/a/../b", "x/.hidden/..name", "?a=1"]
    df = spark.createDataFrame([("http://s/a/b/c", x) for x in links], "base string, link string")
    got = {r["link"]: r["u"] for r in df.select("link", urls.resolve(F.col("base"), F.col("link")).alias("u")).collect()}
    assert got == {x: urljoin("http://s/a/b/c", x) for x in links}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    sinks.write_records(df, str(tmp_path / "r"))
    assert sorted("".join(p.read_text() for p in (tmp_path / "r").glob("*.json")).split()) == ['{"a":1}', '{"a":2,"b":"b"}']
    sinks.write_single(df, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("*.json"))) == 1
    sinks.append_log(df.select("b").where("b is not null"), str(tmp_path / "l"))
    sinks.append_log(df.select("b").where("b is not null"), str(tmp_path / "l"))
    assert readers.line_log(spark, str(tmp_path / "l")).count() == 1
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text("x\n\n \ny\n")
    sinks.merge_parts(spark, str(tmp_path / "m"), str(tmp_path / "n"))
    assert "".join(p.read_text() for p in (tmp_path / "n").glob("*.txt")) == "x\ny\n"
    assert sinks.output_megabytes(spark, str(tmp_path / "r")) >= 0
    (tmp_path / "bad.json").write_text('{"a": 1}\nnot json\n\n{"a": 3}\n')
    assert readers.records(spark, str(tmp_path / "bad.json"), "a int", "drop").count() == 2
    (tmp_path / "c.json").write_text('{"x": 1, "y": 2}')
    (tmp_path / "d.json").write_text('{"y": 3}')
    assert readers.config(str(tmp_path / "c.json"), str(tmp_path / "d.json")) == {"x": 1, "y": 3}


def test_small_scans_are_spread(spark, tmp_path):
    from shelfmark.session import spread

    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("16m", "134217728b", "1g"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert spread(spark.read.parquet(str(tmp_path / "t"))).count() == 10
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
