import random

import numpy as np
import pytest

from shelfmark.llm import markup, markup_train


@pytest.fixture(scope="module")
def model():
    return markup.Labeller(markup.Labeller.load())


def kinds(model, text):
    seq = markup.leaves(text)
    labels = [markup.checked(leaf, k) for leaf, k in zip(seq, model.label([seq])[0])]
    return ({"markup"} if any(labels) else set()) | {markup.LABELS[k] for k in labels if k > 1}


@pytest.mark.parametrize(
    "text,want",
    [
        ("<h2>Soup</h2><p>Warm it.</p><ul><li>one<li>two</ul>", {"markup", "heading", "list"}), ("# Soup #\n**Soup** with _salt_.\n\n* warm\n* stir", {"markup", "heading", "list"}), ("Soup\n======\n\n**Soup** here", {"markup", "heading"}),
        ("== Soup ==\n'''Soup''' is [[food]].\n# [[salt]]\n* [[oil]]", {"markup", "heading", "list"}), ("'''Soup''' is [[food]].\n# serve warm\n# stir well", {"markup", "list"}),
        ("\\section{Soup}\n\\textbf{Soup} is warm.\n\\[a = b\\]\n\\begin{verbatim}\nx = 1\n\\end{verbatim}", {"markup", "heading", "formula", "code"}), ("<p>See <code>f(x)</code></p>", {"markup", "code"}),
        ("'''Soup''' where $x^2 + 1$ holds", {"markup", "formula"}), ("**Soup** is warm\n\n```\nset timer\n```", {"markup", "code"}), ("&lt;p&gt;Soup&lt;/p&gt;", {"markup"}), ("Salt &amp; oil", {"markup"}), ("Soup is warm<br", {"markup"}),
        ("Costs $5 less than before, or $6 with the tray", set()), ("Use when temperature > 5 and < 20 degrees", set()), ("Rated #1 by our panel", set()), ("See note *", set()), ("Ratio 1:2 - stir well", set()), ("Mix 2 * 3 cups with snake_case_words", set()),
        ("Plain words.\n\nTwo paragraphs.", set()), ("", set()), ("Less than <0.5g salt", set()),
    ],
)
def test_kinds(model, text, want):
    assert kinds(model, text) == want


def test_held_out_documents(model):
    r = random.Random(99)
    docs = [d for d in (markup_train.document(r) for _ in range(400)) if d[0]]
    got = model.label([s for s, _ in docs])
    right = sum(a == b for g, (_, labels) in zip(got, docs) for a, b in zip(g, labels))
    assert right / sum(len(s) for s, _ in docs) > 0.99


def test_rendering_keeps_structure(model):
    text = "<h2>Soup &amp; bread</h2><p>Warm <b>it</b>.</p><ul><li>one</li><li>two</li></ul><pre><code>a = 1\nb = 2</code></pre>"
    seq = markup.leaves(text)
    labels = [markup.checked(leaf, k) for leaf, k in zip(seq, model.label([seq])[0])]
    clean = markup.rendered(text, seq, labels)
    assert clean.splitlines()[0] == "## Soup & bread" and "- one" in clean and "```\na = 1\nb = 2\n```" in clean and "<" not in clean


def test_batches_do_not_change_labels(model):
    r = random.Random(7)
    seqs = [markup_train.document(r)[0] for _ in range(50)]
    assert model.label(seqs, batch=7) == [model.label([s])[0] for s in seqs]


def test_gradients():
    """The backward pass agrees with finite differences of the forward pass."""
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in markup_train._start(rng, 3).items()}
    x = rng.normal(size=(4, 2, markup.PATH_BINS + markup.WORD_BINS + markup.SHAPES))
    mask = np.ones((4, 2, 1), bool)
    mask[3, 1] = False
    target = rng.normal(size=(4, 2, 3))
    loss = lambda: float((markup_train._forward(w, x, mask, "f", 3)[0] * target).sum())
    _, kept = markup_train._forward(w, x, mask, "f", 3)
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    markup_train._backward(w, grad, x, mask, "f", 3, kept, target)
    for k, at in (("fu", (1, 2)), ("fw", (3, 5)), ("fb", (7,))):
        w[k][at] += 1e-3
        up = loss()
        w[k][at] -= 2e-3
        down = loss()
        w[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - grad[k][at]) < 2e-2 * max(1, abs(grad[k][at]))


def test_table(spark):
    rows = [(1, "<p>a</p>", None), (1, "<p>a</p>", None), (2, None, "plain"), (3, "", "x " * 50_000 + "<b>y</b>"), (4, None, None)]
    df = spark.createDataFrame(rows, "id long, a string, b string").selectExpr("*", "1 AS field", "2 AS kinds", "3 AS text")
    got = sorted((r["id"], r["field"], r["kinds"], r["clean"][:9]) for r in markup.labelled(df, "id", ["a", "b"]).collect())
    assert got == [(1, "a", ["markup"], "a"), (1, "a", ["markup"], "a"), (2, "b", [], "plain"), (3, "a", [], ""), (3, "b", ["markup"], "x x x x x")]
    assert markup.labelled(df.limit(0), "id", ["a"]).count() == 0


def test_levels_numbers_and_rows_are_kept():
    text = "<h1>Bread</h1><p>Some text on bread and flour.</p><h3>Steps</h3><ol><li>Mix the flour<ul><li>white flour</li><li>rye flour</li></ul></li><li>Bake it</li></ol><table><tr><td>Flour</td><td>500 g</td></tr><tr><td>Salt</td><td>9 g</td></tr></table>"
    seq = markup.leaves(text)
    model = markup.Labeller(markup.Labeller.load())
    labels = [markup.checked(leaf, k) for leaf, k in zip(seq, model.label([seq])[0])]
    assert markup.rendered(text, seq, labels).split("\n") == ["# Bread", "Some text on bread and flour.", "### Steps", "1. Mix the flour", "  - white flour", "  - rye flour", "2. Bake it", "Flour | 500 g", "Salt | 9 g"]


def test_levels_of_line_marks():
    marks = [leaf.mark for leaf in markup.leaves("== A ==\n=== B ===\n## C\n\\subsection{D}\n* x\n** y\n## z ##\n 3. q\n  - r")]
    assert marks == ["## ", "### ", "## ", "## ", "- ", "  - ", "## ", "3. ", "  - "]


def test_all_words_of_a_leaf_are_read():
    a, b = (markup.features([markup.Leaf("word " * 40 + end, ())]) for end in ("alpha", "omega beta"))
    assert (a != b).any()
