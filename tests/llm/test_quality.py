import math
import random
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import quality

COMMON = [("en", w) for w in "the of and to in a is that it for on with as was are this by not".split()] + [("de", w) for w in "der die das und in zu den mit ist".split()]
PROSE = ["The kitchen is warm and the bread of the baker is on the table with a bit of salt.", "It was not the colour that mattered to the cook, for this is a test of taste and of patience."]
LIST = "Shopping list\n- 200 g sugar\n- olive oil\n- Lemon Biscuits\n- 3 kg flour\n- cocoa butter\n- red lentils\n- honey"
TABLE = "| product | weight | price |\n| sugar | 5.2 | 1.20 |\n| salt | 3.1 | 0.40 |\n| flour | 9.9 | 2.10 |\n| oil | 1.0 | 7.45 |"
JUNK = ["click CLICK click!!! click click CLICK click click!!! click click CLICK", "@||*&]{^& [/ #*%_=/ @_~ \\+]%*\\^><~>{ =||| ^<}^>{<>", "T h e b r e a d o f t h e b a k e r i s o n t h e t a b l e", "65018 63292 821793716 2746 407674 84818 2856792 1737 401073", "let px61 = {a:1};\n# slot71[i++]&&t();\nvar cart86[i++]&&t();", "wmxvtirlba fbptnh gvjvvgtg rw nhlhvflvj cbrdv qbzyhgftly bytww pj gzc gltzvfn"]


def test_divergence_bounds():
    p = np.array([1.0, 0, 0])
    got = quality.divergences(np.stack([p, p, p]), np.array([p, [0, 1.0, 0], np.zeros(3)]))
    assert got.tolist() == pytest.approx([0, 1, 1])
    a, b = np.array([3.0, 1]), np.array([1.0, 1])
    pa, pb = a / 4, b / 2
    m = (pa + pb) / 2
    want = 0.5 * sum(x * math.log2(x / y) for x, y in zip(pa, m)) + 0.5 * sum(x * math.log2(x / y) for x, y in zip(pb, m))
    assert quality.divergences(a[None], b)[0] == pytest.approx(want)


def test_kinds_and_counts(spark):
    r = random.Random(1)
    sentence = lambda: " ".join(r.choices(["the", "of", "and", "is", "a", "in", "bread", "table", "warm", "cook", "salt", "baker", "colour", "kitchen", "taste"], [5, 4, 4, 3, 3, 3, 2, 2, 2, 2, 2, 2, 2, 2, 2], k=14)).capitalize() + "."
    prose = [*PROSE, *(" ".join(sentence() for _ in range(4)) for _ in range(60))]
    variants = [PROSE[0].upper(), PROSE[1].lower().rstrip("."), "\n".join(prose[5].split(". ")), prose[6] + "\n- salt\n- oil\n", prose[7].replace(" ", "\n", 20)]
    docs = [(i, t) for i, t in enumerate([*prose, *variants])] + [(900, LIST), (901, TABLE)] + [(910 + i, t) for i, t in enumerate(JUNK)] + [(990, None), (991, " \n"), (992, prose[9] * 300), (0, prose[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS kind", "2 AS n_words", "3 AS id")
    common = spark.createDataFrame(COMMON, "lang string, word string")
    got = {x["doc_id"]: x for x in quality.document_statistics(df, common).collect()}
    assert [i for i in range(len(prose) + len(variants)) if got[i]["kind"] != "prose"] == []
    assert got[900]["kind"] == "list" and got[901]["kind"] == "table" and [got[910 + i]["kind"] for i in range(len(JUNK))] == ["junk"] * len(JUNK)
    assert got[990]["kind"] is None and got[991]["n_words"] == 0 and got[992]["kind"] == "prose"
    words = PROSE[0].rstrip(".").split()
    assert got[0]["n_words"] == len(words) and got[0]["mean_word_length"] == pytest.approx(sum(map(len, words)) / len(words)) and got[0]["line_end_share"] == 1.0
    assert got[0]["common_share"] == pytest.approx(sum(w.lower() in {x for lang, x in COMMON if lang == "en"} for w in words) / len(words))
    assert quality.document_statistics(df.limit(0), common).count() == 0
    assert quality.document_statistics(df, common.limit(0)).count() == len(docs)


def test_best_language():
    w = quality.Words(COMMON)
    k, v, hits = w.counts(Counter("der hund und die katze in".split()))
    assert w.langs[k] == "de" and hits == 4 and v.sum() == 6


def test_rows_behind_many_lines_of_text():
    lines = ["Some text stands here"] * 60 + [f"{i} | {i * 3} | {i * 7}" for i in range(200)]
    share, width, numeric = quality._fields(lines)
    assert share == 200 / 260 and width == 3 and numeric == 1.0


# Prose in languages that have no list of common words, and lists and junk beside it.
OTHERS = [
    "El pan de la casa se hace con harina y agua, y se deja en la mesa hasta que la masa sube un poco más. Después se pone en el horno y se sirve con queso.",
    "Domowy chleb piecze się z mąki i wody, a ciasto zostawia się na stole aż urośnie. Potem wkłada się je do pieca i podaje z serem, a na koniec smaruje masłem.",
    "Домашний хлеб пекут из муки и воды, а тесто оставляют на столе, пока оно не поднимется. Потом его ставят в печь и подают с сыром, маслом и солью.",
    "这种面包是用面粉和水做成的，面团要在桌子上放到发起来为止。然后把它放进烤箱里烤好，最后和奶酪一起端上来给大家吃。",
    "Το ψωμί του σπιτιού γίνεται με αλεύρι και νερό, και η ζύμη μένει στο τραπέζι μέχρι να φουσκώσει. Μετά μπαίνει στον φούρνο και σερβίρεται με τυρί.",
    "Il pane della casa si fa con farina e acqua, e si lascia sulla tavola finché la pasta non cresce un poco. Poi si mette nel forno e si serve con il formaggio.",
]
OTHER_LISTS = ["сахар\nмука\nсоль\nоливковое масло\nмёд\nрис\nчёрный перец\nмолоко", "糖\n面粉\n盐\n橄榄油\n蜂蜜\n大米\n黑胡椒\n牛奶"]


def test_languages_without_a_profile(spark):
    docs = list(enumerate([*PROSE, *OTHERS, *OTHER_LISTS, *JUNK, "соль " * 40]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [r["kind"] for r in sorted(quality.document_statistics(df, spark.createDataFrame(COMMON, "lang string, word string")).collect())]
    n = len(PROSE) + len(OTHERS)
    assert got[:n] == ["prose"] * n and got[n : n + 2] == ["list"] * 2 and got[n + 2 :] == ["junk"] * (len(JUNK) + 1)
