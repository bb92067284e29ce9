"""Containers and mixtures, both measured in tokens."""

import itertools
import os
import random

import numpy as np
import pytest

from shelfmark.llm import containers, mixing, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


def least_bins(items, capacity):
    """Fewest containers, by trying all."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def first_fit_decreasing(histogram, capacity):
    space = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        k = next((k for k, s in enumerate(space) if s >= n), None)
        if k is None:
            space.append(capacity - n)
        else:
            space[k] -= n
    return len(space)


def check_plan(histogram, capacity):
    plan = containers.plan(histogram, capacity)
    used = {}
    for lengths, counts, times in plan:
        assert int((lengths * counts).sum()) <= capacity and times > 0
        for n, c in zip(lengths.tolist(), counts.tolist()):
            used[n] = used.get(n, 0) + c * times
    assert used == histogram
    return sum(t for *_, t in plan)


def test_plans_against_brute_force():
    r = random.Random(2)
    over = 0
    for _ in range(30):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 8))), reverse=True)
        histogram = {n: len(list(g)) for n, g in itertools.groupby(items)}
        got, best = check_plan(histogram, 20), least_bins(items, 20)
        assert got <= best + 1
        over += got - best
    assert over <= 4


def test_large_plans_waste_little():
    r = random.Random(3)
    for low, high in ((1, 300), (300, 900), (200, 2000)):
        histogram = {}
        for _ in range(4000):
            n = r.randint(low, high)
            histogram[n] = histogram.get(n, 0) + 1
        got = check_plan(histogram, 2048)
        assert got <= first_fit_decreasing(histogram, 2048) * 1.02
        if high < 1000:
            assert sum(n * c for n, c in histogram.items()) / (got * 2048) > 0.97
    assert containers.plan({}, 10) == [] and check_plan({10: 5}, 10) == 5


def test_the_program_places_most_items(monkeypatch):
    r = random.Random(4)
    histogram = {}
    for _ in range(4000):
        n = int(r.lognormvariate(5, 0.8)) + 1
        histogram[n] = histogram.get(n, 0) + 1
    rest = []
    monkeypatch.setattr(containers, "_greedy_plan", lambda lengths, left, capacity: rest.append(int(left.sum())) or [])
    containers.plan(histogram, 4096)
    assert rest[0] < 0.05 * 4000


def test_price_is_the_best_knapsack():
    r = random.Random(1)
    for _ in range(20):
        lengths = np.array(sorted(r.sample(range(1, 12), 4)))
        worth = np.array([r.random() for _ in range(4)])
        counts, value = containers.price(lengths, worth, np.full(4, 99), 15)
        assert float((counts * worth).sum()) == pytest.approx(value)
        best = max(float((np.array(c) * worth).sum()) for c in itertools.product(range(16), repeat=4) if (np.array(c) * lengths).sum() <= 15)
        assert (counts * lengths).sum() <= 15 and float((counts * worth).sum()) == pytest.approx(best)


@needs_vocabulary
def test_pack(spark):
    rows = [(i, "word " * (i % 9 + 1)) for i in range(60)] + [(100, None), (101, ""), (102, "long text here " * 40), (103, "same"), (103, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS piece", "3 AS rank", "4 AS n_tokens")
    sizes = {r["doc_id"]: r["n"] for r in tokens.sized(spark.createDataFrame(rows, "doc_id long, text string"), to="n").collect()}
    got = containers.pack(df, 32).collect()
    by_doc, by_container = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        if r["container_id"] is not None:
            by_container[r["container_id"]] = by_container.get(r["container_id"], 0) + r["n_tokens"]
    assert max(by_container.values()) <= 32 and sorted(by_container) == list(range(len(by_container)))
    assert {d: sum(r["n_tokens"] for r in v) // (2 if d == 103 else 1) for d, v in by_doc.items()} == sizes
    assert {r["doc_id"] for r in containers.split_texts(containers.pack(df, 32)).collect()} == {d for d, n in sizes.items() if n > 32} == {102}
    assert by_doc[100][0]["container_id"] is None and len(by_doc[103]) == 2
    report = containers.fill_report(containers.pack(df, 32), 32).first()
    assert report["containers"] == len(by_container) and report["fill"] > 0.9
    assert containers.pack(df.limit(0), 32).count() == 0
    with pytest.raises(ValueError):
        containers.pack(df, 0)


@needs_vocabulary
def test_offsets_do_not_depend_on_salts(spark, monkeypatch):
    df = spark.createDataFrame([("a" if i % 3 else "b", i, i % 7 + 1) for i in range(200)], "k string, i long, n long")
    for group in (100_000, 10):
        monkeypatch.setattr(tokens, "GROUP", group)
        rows = tokens.offset_within(df, "k", ["i"], "n", 200, "at").collect()
        for k in "ab":
            spans = sorted((r["at"], r["n"]) for r in rows if r["k"] == k)
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_permutations_are_bijections():
    for size in (1, 2, 3, 10, 1000, 1025):
        for turn in range(3):
            assert sorted(mixing.permuted(np.arange(size), size, 7, 2, turn).tolist()) == list(range(size))
    assert (mixing.permuted(np.arange(1000), 1000, 7, 2, 0) != mixing.permuted(np.arange(1000), 1000, 7, 2, 1)).any()


@needs_vocabulary
def test_mix(spark):
    rows = [(i, "word " * 30, "big") for i in range(400)] + [(1000 + i, "other " * 30, "small") for i in range(20)] + [(2000, "x " * 99, None), (2001, "x", "elsewhere"), (2002, None, "big"), (2003, "", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS block", "2 AS id", "3 AS slot")
    targets = spark.createDataFrame([("big", 0.6, 3), ("small", 0.3, 3), ("absent", 0.1, 4)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, targets, block_tokens=16)
    report = {r["source"]: r for r in m.report().collect()}
    assert report["small"]["short"] and report["absent"]["short"] and not report["big"]["short"]
    assert report["small"]["rounds"] == 3 and report["small"]["used_tokens"] == 3 * report["small"]["tokens"]
    assert abs(report["big"]["used_tokens"] / sum(r["tokens"] for r in report.values()) - 0.6) < 0.06
    assert report["small"]["missing_tokens"] > 0 and report["absent"]["missing_tokens"] > 0 and report["big"]["missing_tokens"] == 0
    assert [r["source"] for r in m.short_sources().orderBy("source").collect()] == ["absent", "small"]
    assert report["absent"]["actual_share"] == 0.0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-3
    slots = m.slots.where("filled").collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots) and len({(r["source"], r["turn"], r["block"]) for r in slots}) == len(slots)
    pieces = {}
    for r in m.pieces.collect():
        pieces.setdefault((r["source"], r["block"]), []).append(r["n_tokens"])
    assert all(sum(v) <= 16 for v in pieces.values())
    assert sum(map(sum, pieces.values())) == sum(r["tokens"] for r in report.values())
    assert m.rows().agg({"n_tokens": "sum"}).first()[0] == sum(r["used_tokens"] for r in report.values())
    assert mixing.mix(df.limit(0), targets).report().where("used_tokens > 0").count() == 0
    assert mixing.mix(df, targets.limit(0)).rows().count() == 0


def test_mix_of_less_than_one_block(spark):
    df = spark.createDataFrame([(1, "a few words", "s")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert [r["id"] for r in mixing.mix(df, targets).rows().collect()] == [1]
