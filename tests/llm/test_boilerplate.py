import random

import numpy as np

from shelfmark.llm import boilerplate

MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>Help</a></li><li><a href='/c'>Basket</a></li></ul></nav>"
FOOT = "<footer><p>Prices may change without any notice to you.</p><p>All rights are kept by us.</p></footer></body></html>"
AD = "<div class='ad'><p>Save a third on selected treats this week.</p></div>"


def product(i, title="", ad=""):
    return f"""<html><head><title>T{i} | shop.example</title></head><body>{MENU}<div class="trail"><a href="/">Home</a> &gt; <a href="/x">X{i}</a></div><main><h1 class="t">Item&nbsp; {title or i}</h1>
<p class="p">£{i}.50</p>\n<p>£{i}/kg</p><h3>Highlights</h3><ul><li>Good &amp; <b>neat</b></li><li>Small</li></ul>{ad}<h3>Ingredients</h3><div>Salt, x{i}</div>
<h3>Nutrition</h3><table><tr><th>Fat</th><td>{i}g</td></tr></table><a href="/v">View all things</a><p>Write a review</p></main>{FOOT}"""


def guide(i):
    return f"<html><head><title>G{i} | shop.example</title></head><body>{MENU}<main><h1>How to {i}</h1><p>Unique words number{i} alpha{i * 7} here.</p>{AD}<h2>Tips {i}</h2><p>More unique words beta{i * 13}.</p><p>Write a review</p></main>{FOOT}"


def pages():
    out = [(f"p{i}", product(i, ad=AD if i % 2 else "")) for i in range(30)] + [(f"g{i}", guide(i)) for i in range(12)]
    return [*out, out[0], ("copy", out[1][1]), ("denied", "<body><p>Access denied</p></body>"), ("none", None), ("blank", " ")]


def test_main_lines(spark):
    df = spark.createDataFrame(pages(), "source_file string, html string").selectExpr("*", "1 AS line", "2 AS _page", "3 AS line_no")
    got = {}
    for r in boilerplate.main_body(df).orderBy("line_no").collect():
        got.setdefault(r["source_file"], []).append(r["line"])
    assert got["p3"] == ["Item 3", "£3.50", "£3/kg", "Highlights", "Good & neat", "Small", "Ingredients", "Salt, x3", "Nutrition", "Fat", "3g"]
    assert got["g4"] == ["How to 4", "Unique words number4 alpha28 here.", "Tips 4", "More unique words beta52."]
    assert got["copy"] == got["p1"] and "denied" not in got and "none" not in got and len(got["p0"]) == 11
    assert boilerplate.main_body(df.limit(0)).count() == 0


def test_missing_end_tags():
    page = product(5).replace("</li>", "").replace("</table>", "").replace("</div>\n", "\n")
    lines = boilerplate.lines_of(page)
    body = [lines[i].text for i in boilerplate.main_lines(lines, np.zeros(len(lines), bool))]
    assert body[:6] == ["Item 5", "£5.50", "£5/kg", "Highlights", "Good & neat", "Small"] and "Nutrition" in body and "Write a review" not in body


def brute_cover(shard, long_words, share):
    least = 2 if len(shard) < 30 else 3
    tokens = [[t.lower() for t, _ in p] for p in shard]
    cover = [np.zeros(len(p), bool) for p in tokens]
    longest = max(map(len, tokens))
    n = 1
    while n <= longest:
        seen = {}
        for k, p in enumerate(tokens):
            for i in range(len(p) - n + 1):
                seen.setdefault(tuple(p[i : i + n]), set()).add(k)
        for k, p in enumerate(tokens):
            for i in range(len(p) - n + 1):
                s = len(seen[tuple(p[i : i + n])])
                words = sum(len(t.split()) for t in p[i : i + n])
                if s >= least and words >= long_words or s >= max(least, share * len(shard)):
                    cover[k][i : i + n] = True
        n *= 2
    return cover


def test_cover_against_brute_force():
    r = random.Random(4)
    vocabulary = [f"{w} {v}" for w in ("red", "blue", "old") for v in ("cat", "dog", "hen x", "fox y z")]
    for _ in range(20):
        shard = [[(r.choice(vocabulary), False) for _ in range(r.randint(0, 12))] for _ in range(r.randint(1, 9))]
        got = boilerplate.covered_by_repeats(shard)
        for a, b in zip(got, brute_cover(shard, boilerplate.LONG_WORDS, boilerplate.COMMON_SHARE)):
            assert (a == b).all()
    assert boilerplate.covered_by_repeats([[]])[0].tolist() == []


def test_long_page():
    lines = boilerplate.lines_of("<body><h1>T</h1>" + "<p>word</p>" * 50_000)
    assert len(lines) == 50_001


def bodies(page, others):
    parsed = [boilerplate.lines_of(p) for p in [page, *others]]
    masks = boilerplate.covered_by_repeats([[(ln.text, ln.tag in boilerplate._HEADINGS) for ln in p] for p in parsed])
    return [parsed[0][i].text for i in boilerplate.main_lines(parsed[0], masks[0], boilerplate.title_of(page), True)]


def test_uncovered_runs_decide_on_product_pages():
    others = [product(i, ad=AD) for i in range(40)]
    stock = "<p>Keep in a cool dry place and use soon after opening.</p>"
    others = [p.replace("<h3>Nutrition", f"<div>{stock}</div><h3>Nutrition") for p in others]
    page = product(77, ad=AD).replace("<h3>Nutrition", f"<h3>Zutaten</h3><div><p>Roggen and malt nobody else has.</p>{stock}</div><p>A lone line of the seventy seventh page.</p><h3>Nutrition")
    got = bodies(page, others)
    assert got[8:12] == ["Zutaten", "Roggen and malt nobody else has.", "Keep in a cool dry place and use soon after opening.", "A lone line of the seventy seventh page."]
    assert not {"Write a review", "View all things", "Save a third on selected treats this week."} & set(got)


def test_section_titles_that_are_no_headings_and_pages_without_h1():
    others = [product(i) for i in range(40)]
    page = product(78).replace("<h3>Ingredients</h3>", "<p>Ingredients</p>")
    assert bodies(page, others)[6:8] == ["Ingredients", "Salt, x78"]
    page = product(79).replace("T79 |", "Item 79 |").replace("<h1", "<p").replace("</h1>", "</p>")
    got = bodies(page, others)
    assert got[:3] == ["Item 79", "£79.50", "£79/kg"] and got[-1] == "79g" and "Write a review" not in got
    assert bodies(page.replace("Item&nbsp; 79", "Access denied"), others) == []


def test_guide_with_a_section_title():
    page = guide(99).replace("Tips 99", "Description")
    assert bodies(page, [guide(i) for i in range(40)]) == ["How to 99", "Unique words number99 alpha693 here.", "Description", "More unique words beta1287."]


def summed(shards, n_pages):
    """covered_by_counts over shards, their counts summed."""
    total = {}
    for shard in shards:
        for run, n in zip(*boilerplate.run_counts(shard)):
            total[run] = total.get(run, 0) + n
    runs, counts = np.array(list(total), np.int64), np.array(list(total.values()), np.int64)
    return [mask.tolist() for shard in shards for mask in boilerplate.covered_by_counts(shard, runs, counts, n_pages)]


def test_shards_do_not_change_what_is_covered():
    r = random.Random(5)
    vocabulary = [(f"{w} {v}", w == "old") for w in ("red", "blue", "old", "pale") for v in ("cat", "dog", "hen x", "fox y z", "£1", "eel a b c d e")]
    for _ in range(30):
        pages = [[r.choice(vocabulary) for _ in range(r.randint(0, 14))] for _ in range(r.randint(30, 60))]
        whole = summed([pages], len(pages))
        assert whole == summed([pages[k : k + 7] for k in range(0, len(pages), 7)], len(pages)) == [m.tolist() for m in boilerplate.covered_by_repeats(pages)]


def test_a_notice_rarer_than_shards_is_covered(spark, monkeypatch):
    notice = "<p>Our shop in the old mill is closed for works this week.</p>"
    rows = [(f"g{i}", guide(i).replace("<p>Write", (notice if i % 20 == 0 else "") + "<p>Write")) for i in range(120)]
    df = spark.createDataFrame(rows, "source_file string, html string")
    monkeypatch.setattr(boilerplate, "SHARD_PAGES", 4)
    got = {}
    for r in boilerplate.main_body(df).orderBy("line_no").collect():
        got.setdefault(r["source_file"], []).append(r["line"])
    assert len(got) == 120 and all(got[f"g{i}"] == [f"How to {i}", f"Unique words number{i} alpha{i * 7} here.", f"Tips {i}", f"More unique words beta{i * 13}."] for i in range(120))


def test_a_section_of_its_own_stays_on_hosts_of_any_size(spark):
    section = "<h3>Zutaten</h3><div><p>Roggen and malt nobody else has.</p></div><p>A lone line of the first page.</p><h3>Nutrition"
    sizes = (2, 5, 29, 30, 40)
    rows = [(f"{n}/{i}", product(i, ad=AD).replace("shop.example", f"shop{n}.example").replace("<h3>Nutrition", section if i == 0 else "<h3>Nutrition")) for n in sizes for i in range(n)]
    got = {}
    for r in boilerplate.main_body(spark.createDataFrame(rows, "source_file string, html string")).orderBy("line_no").collect():
        got.setdefault(r["source_file"], []).append(r["line"])
    first = ["Item 0", "£0.50", "£0/kg", "Highlights", "Good & neat", "Small", "Ingredients", "Salt, x0", "Zutaten", "Roggen and malt nobody else has.", "A lone line of the first page.", "Nutrition", "Fat", "0g"]
    assert [got[f"{n}/0"] for n in sizes] == [first] * len(sizes)
    assert all(len(got[f"{n}/{i}"]) == 11 for n in sizes for i in range(1, n))
