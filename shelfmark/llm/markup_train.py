"""Trains the leaf labeller of ``markup`` on documents written here, and stores its weights.

``python -m shelfmark.llm.markup_train`` is deterministic and takes a few minutes. Every
document is built from blocks whose kind is known, rendered in one of four syntaxes (or
left plain, with signs that only look like markup). Private-use characters carry each block's
label through the rendering; they are taken out before the features are made.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from . import markup

_WORDS = "amber basket carton delta ember fennel garden harbour island jacket kettle ladder market needle orchard packet quarry ribbon saddle timber umbrella valley window yellow zephyr bright quick slow small large fresh good warm cold keep serve shake rinse store make bring hold show need suit lose cook bake mix stir pour cut with and of the for on in by as that when after before until while our your their".split()
_MARK = 0xE000
_CODE = ['{"level": 3, "on": true}', "for x in rows:\n    total += x.size", "make clean\nmake all", "if (a > b) { return a; }", "SELECT name FROM stock WHERE n > 3", "open door\nclose door", "tool --size 4 --dry", "let k = f(2);", "x = 1\nprint(x)", "start timer 30\nwait"]
_MATHS = ["a^2 + b^2 = c^2", "\\frac{a}{b} = q", "E = m c^2", "y = k x + d", "\\sum_{i=1}^{n} x_i", "p = \\frac{m}{v}", "x \\leq y + 1", "u+v=w", "\\alpha + \\beta", "n_i", "t = 2 \\pi r", "H_2O", "A_3B_{21}C_2", "Na_{2}SO_4", "x_{ij}", "N_2 + 3", "k_0", "Q_{12}R_3"]
_LOOKALIKE = [
    "Use between > 3 and < 9 steps", "Costs $4 more, or $7 with the lid", "Rated #2 by readers", "See footnote *", "Ratio 2:1 - mix well", "20% off = a low price", "Range 4-6 % ~ usual", "2 * 3 * 4 units", "file_name_here stays", "a < b and c > d", "Size 10 x 20 - 30",
    "5 & 6 apply", "R&D team", "* while stocks last", "price: $3.50 or $4.20 each", "note: 1) wash 2) dry", "~ about five", "100 + 20 = 120", "email me @ noon", "C# and F# notes", "it's 'fine' now", "value is 5_000", "no. 7 - lemon", "half [sic] done", "(see page 4)", "50 < 60", "tick # box", "3 > 2", "one | two", "Lot [B] sold apart", "a C++ reader", "Mix 3 * 2 cups", "under <5", "5-6 % ~ usual", "Less than <4", "Take 2 * 3 spoons", "a * b * c",
]


def _word(r: random.Random) -> str:
    """A common word, or an invented one, so that no label hangs on particular words."""
    return r.choice(_WORDS) if r.random() < 0.4 else "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s"]) for _ in range(r.randint(1, 4)))


def _say(r: random.Random, low: int, high: int) -> str:
    words = [_word(r) for _ in range(r.randint(low, high))]
    if r.random() < 0.3:
        words.insert(r.randrange(len(words) + 1), str(r.randint(1, 2000)))
    return " ".join(words)


def _tag(text: str, label: int) -> str:
    """Every word carries its block's label; so does every line of code."""
    return "".join(c + chr(_MARK + label) if c.isalnum() and (i + 1 == len(text) or not text[i + 1].isalnum()) else c for i, c in enumerate(text))


def _sentence(r: random.Random, label: int) -> str:
    return _tag(_say(r, 4, 16).capitalize() + r.choice([".", ".", "!", "?", "", ","]), label)


def _item(r: random.Random, low: int = 1, high: int = 6) -> str:
    """A list item, sometimes a sentence, sometimes with other marks at its end."""
    text = _tag(_say(r, low, high).capitalize() if r.random() < 0.5 else _say(r, low, high), 3)
    return text + r.choice([""] * 9 + [".", f" See [{_tag(_say(r, 1, 2), 3)}](/{r.choice(_WORDS)}).", " {{cite|title=" + _tag(_say(r, 1, 2), 3) + "}}", " <!-- note -->", " &amp; " + _tag(_say(r, 1, 2), 3)])


def _title(r: random.Random) -> str:
    return _tag(" ".join(w.capitalize() for w in _say(r, 1, 4).split()), 2)


def _html(r: random.Random) -> str:
    up = str.upper if r.random() < 0.2 else str.lower
    t = lambda name, body, attrs="": f"<{up(name)}{attrs}>{body}</{up(name)}>"
    out = []
    for _ in range(r.randint(1, 5)):
        kind = r.choice("hpppluucmbxe")
        attrs = r.choice(["", "", ' class="k"', ' id=m', ' style="a:b"'])
        if kind == "h":
            out.append(t(f"h{r.randint(1, 6)}", _title(r), attrs))
        elif kind in "lu":
            ends = [r.random() < 0.7 for _ in range(4)]
            items = "".join(f"<{up('li')}>{_item(r)}" + (f"</{up('li')}>" if ends[i] else "") for i in range(r.randint(1, 4)))
            out.append(t(r.choice(["ul", "ol"]), items, attrs))
        elif kind == "c":
            code = _tag(r.choice(_CODE), 4)
            out.append(r.choice([t("pre", t("code", code)), t("pre", code), t("p", _sentence(r, 1) + " " + t("code", code.split("\n")[0]))]))
        elif kind == "m":
            m = _tag(r.choice(_MATHS), 5)
            out.append(r.choice([t("math", t("mi", m)), t("p", _sentence(r, 1) + f" \\({m}\\)"), t("p", f"\\[{m}\\]"), t("p", f"{_sentence(r, 1)} ${m}$ {_sentence(r, 1)}")]))
        elif kind == "b":
            out.append(f"{_sentence(r, 0)}{t(r.choice(['b', 'i', 'em', 'strong', 'span']), _tag(_say(r, 1, 2), 1))} {_sentence(r, 1)}{r.choice(['<br>', '<br/>', '<br'])}")
        elif kind == "x":
            out.append(r.choice(["<!-- slot -->", "<script>go(2)</script>"]) + t("p", _sentence(r, 1)))
        elif kind == "e":
            out.append(t("div", _sentence(r, 1) + r.choice([" &amp; ", "&nbsp;", " &frac12; "]) + _sentence(r, 1)))
        else:
            out.append(t("p", _sentence(r, 1) + (" " + r.choice(_LOOKALIKE) if r.random() < 0.15 else ""), attrs))
    text = r.choice(["", "", "\n"]).join(out)
    if r.random() < 0.15:
        text += "\n\n" + "\n".join(f"{r.choice('-*')} {_item(r, 1, 5)}" for _ in range(r.randint(2, 4)))
    if r.random() < 0.15:
        text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text


def _markdown(r: random.Random) -> str:
    out = []
    if r.random() < 0.6:
        h = _title(r)
        out.append(r.choice([f"# {h}", f"## {h}", f"### {h} ###", f"# {h} #", f"{h}\n======", f"{h}\n------"]))
    bold = r.random() < 0.7
    if not out and r.random() < 0.3:  # nothing but a list
        marks = r.choice(["*", "-", "+", "*-+", "*+"])
        return "\n".join(f"{r.choice(marks)} {_item(r)}" for _ in range(r.randint(1, 5)))
    for _ in range(r.randint(1, 4)):
        kind = r.choice("pppllocm")
        if kind == "p":
            s = _sentence(r, 0 if not bold else 1)
            if bold:
                s = f"**{_tag(_say(r, 1, 2), 1)}** {r.choice(['', '_' + _tag(_say(r, 1, 2), 1) + '_ '])}{s}"
            if r.random() < 0.2:
                s += f" [{_tag(_say(r, 1, 2), 1)}](/{r.choice(_WORDS)})"
            out.append(s)
        elif kind in "lo":
            marks = r.choice([["*"], ["-"], ["+"], ["1."], ["1."], ["n."], ["n)"], ["*", "-", "+"]])
            out.append("\n".join(f"{r.choice(marks).replace('n', str(i + 1))} {_item(r)}" for i in range(r.randint(1, 4))))
        elif kind == "c":
            code = _tag(r.choice(_CODE), 4)
            out.append(r.choice([f"```\n{code}\n```", f"```sh\n{code}\n```", f"{_sentence(r, 1)} `{code.splitlines()[0]}` {_sentence(r, 1)}"]))
        else:
            m = _tag(r.choice(_MATHS), 5)
            out.append(r.choice([f"$${m}$$", f"{_sentence(r, 0)} ${m}$ {_sentence(r, 0)}"]))
    return r.choice(["\n\n", "\n\n", "\n"]).join(out)


def _wiki(r: random.Random) -> str:
    out = []
    if r.random() < 0.4:
        out.append("{{Infobox " + _tag(r.choice(_WORDS), 1) + f"\n| name = {_tag(_say(r, 1, 3), 1)}\n| made = {_tag(str(r.randint(1800, 2020)), 1)}\n" + "}}")
    link = lambda: f"[[{_tag(_say(r, 1, 2), 1)}]]"
    out.append(f"'''{_tag(_say(r, 1, 3), 1)}''' {_sentence(r, 1)} {link()}{r.choice(['', '<ref>' + _tag(_say(r, 1, 3), 1) + '</ref>'])}")
    for _ in range(r.randint(0, 5)):
        kind = r.choice("hhppplllcmx")
        if kind == "h":
            m = "=" * r.randint(2, 4)
            out.append(r.choice(["", "", "", "<!-- part -->"]) + f"{m} {_title(r)} {m}" if r.random() < 0.9 else f"<!-- part -->\n{m} {_title(r)} {m}")
        elif kind == "l":
            linked = r.random() < 0.6
            item = lambda: f"[[{_tag(_say(r, 1, 3), 3)}]]" if linked else _item(r, 1, 5)  # noqa: E731, B023
            marks = r.choice(["*", "#", "*#", "#*"])
            out.append("\n".join(f"{r.choice(marks)}{r.choice([' ', ' ', ' ', ''] if linked else [' '])}{item()}" for _ in range(r.randint(1, 4))))
        elif kind == "c":
            code = _tag(r.choice(_CODE), 4)
            out.append(r.choice([f"<syntaxhighlight>{code}</syntaxhighlight>", f"<code>{code.splitlines()[0]}</code>", f"<pre>{code}</pre>"]))
        elif kind == "m":
            m = _tag(r.choice(_MATHS), 5)
            out.append(r.choice([f"<math>{m}</math>", f"{_sentence(r, 0)} ${m}$ {_sentence(r, 0)}"]))
        elif kind == "x":
            out.append(r.choice(["<!-- check -->", f"[[Category:{_tag(_say(r, 1, 2), 1)}]]"]))
        else:
            out.append(" ".join(_sentence(r, 0) for _ in range(r.randint(1, 3))))
    return r.choice(["\n", "\n\n"]).join(out)


def _latex(r: random.Random) -> str:
    out = []
    if r.random() < 0.5:
        out.append(f"\\{r.choice(['section', 'subsection', 'section*'])}{{{_title(r)}}}")
    out.append(r.choice([f"\\textbf{{{_tag(_say(r, 1, 2), 1)}}} {_sentence(r, 1)}", f"{{\\bf {_tag(_say(r, 1, 2), 1)}}} {_sentence(r, 1)}", f"{_sentence(r, 1)} \\emph{{{_tag(_say(r, 1, 2), 1)}}}"]))
    for _ in range(r.randint(0, 3)):
        kind = r.choice("pllccmmm")
        if kind == "p":
            out.append(_sentence(r, 0))
        elif kind == "l":
            env = r.choice(["itemize", "enumerate"])
            out.append(f"\\begin{{{env}}}\n" + "\n".join(f"\\item {_item(r)}" for _ in range(r.randint(1, 4))) + f"\n\\end{{{env}}}")
        elif kind == "c":
            out.append(f"\\begin{{verbatim}}\n{_tag(r.choice(_CODE), 4)}\n\\end{{verbatim}}")
        else:
            m = _tag(r.choice(_MATHS), 5)
            out.append(r.choice([f"\\[{m}\\]", f"{_sentence(r, 0)} ${m}$ {_sentence(r, 0)}", f"\\begin{{equation}}{m}\\end{{equation}}", f"{_sentence(r, 0)} \\({m}\\)"]))
    return "\n".join(out)


def _plain(r: random.Random) -> str:
    parts = [_sentence(r, 0) for _ in range(r.randint(1, 4))]
    for _ in range(r.randint(1, 3)):
        parts.insert(r.randrange(len(parts) + 1), _tag(r.choice(_LOOKALIKE), 0))
    return r.choice([" ", " ", "\n", "\n\n"]).join(parts)


def document(r: random.Random) -> tuple[list[markup.Leaf], list[int]]:
    """Leaves of one document and their labels."""
    text = r.choice([_html, _html, _markdown, _markdown, _wiki, _wiki, _latex, _plain])(r)
    seq, labels = [], []
    for leaf in markup.leaves(text):
        own = [ord(c) - _MARK for c in leaf.text if _MARK <= ord(c) < _MARK + len(markup.LABELS)]
        clean = "".join(c for c in leaf.text if not _MARK <= ord(c) < _MARK + len(markup.LABELS))
        label = max(set(own), key=own.count) if own else 1
        if label < 2:
            label = int(bool(leaf.path))
        if any(p in ("line:=====", "line:-----") for p in leaf.path) and labels and labels[-1] == 2:
            label = 2
        if own and label == 1 and max(set(own), key=own.count) == 0 and set(leaf.path) <= {"line:*", "line:-", "line:1.", "line:#", "math:$"}:
            label = 0
        seq.append(markup.Leaf(clean, leaf.path))
        labels.append(label)
    return seq, labels


def _start(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
    n = markup.PATH_BINS + markup.WORD_BINS + markup.SHAPES
    w = {}
    for way in "fr":
        w[way + "w"] = rng.normal(0, 0.1, (n, 4 * hidden))
        w[way + "u"] = rng.normal(0, 0.1, (hidden, 4 * hidden))
        w[way + "b"] = np.zeros(4 * hidden)
    w["ow"], w["xw"], w["ob"] = rng.normal(0, 0.1, (2 * hidden, len(markup.LABELS))), rng.normal(0, 0.05, (n, len(markup.LABELS))), np.zeros(len(markup.LABELS))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _forward(w: dict, x: np.ndarray, mask: np.ndarray, way: str, hidden: int):
    h = np.zeros((x.shape[1], hidden), np.float32)
    c = np.zeros_like(h)
    pre = x @ w[way + "w"] + w[way + "b"]
    kept = []
    out = np.zeros((x.shape[0], x.shape[1], hidden), np.float32)
    for t in range(x.shape[0]) if way == "f" else range(x.shape[0] - 1, -1, -1):
        z = pre[t] + h @ w[way + "u"]
        g = 1 / (1 + np.exp(-z[:, : 3 * hidden]))
        a = np.tanh(z[:, 3 * hidden :])
        c2 = g[:, hidden : 2 * hidden] * c + g[:, :hidden] * a
        tc = np.tanh(c2)
        h2 = g[:, 2 * hidden :] * tc
        kept.append((t, h, c, g, a, tc))
        c, h = np.where(mask[t], c2, c), np.where(mask[t], h2, h)
        out[t] = h
    return out, kept


def _backward(w: dict, grad: dict, x: np.ndarray, mask: np.ndarray, way: str, hidden: int, kept: list, d_out: np.ndarray) -> None:
    dh = np.zeros((x.shape[1], hidden), np.float32)
    dc = np.zeros_like(dh)
    dz_all = np.zeros((x.shape[0], x.shape[1], 4 * hidden), np.float32)
    for t, h, c, g, a, tc in reversed(kept):
        dh = dh + d_out[t]
        on = mask[t]
        dh_on, dc_on = np.where(on, dh, 0), np.where(on, dc, 0)
        dc2 = dc_on + dh_on * g[:, 2 * hidden :] * (1 - tc * tc)
        dz = np.concatenate((dc2 * a, dc2 * c, dh_on * tc, dc2 * g[:, :hidden] * (1 - a * a)), axis=1)
        dz[:, : 3 * hidden] *= g * (1 - g)
        dz_all[t] = dz
        grad[way + "u"] += h.T @ dz
        dh = np.where(on, dz @ w[way + "u"].T, dh)
        dc = np.where(on, dc2 * g[:, hidden : 2 * hidden], dc)
    flat = dz_all.reshape(-1, 4 * hidden)
    grad[way + "w"] += x.reshape(-1, x.shape[2]).T @ flat
    grad[way + "b"] += flat.sum(axis=0)


def train(n_documents: int = 14000, epochs: int = 6, hidden: int = 24, seed: int = 11, batch: int = 48, rate: float = 0.01) -> tuple[dict[str, np.ndarray], float]:
    """Weights, and the share of leaves labelled rightly in held-out documents. The labelled sample is bounded by ``n_documents``."""
    r = random.Random(seed)
    rng = np.random.default_rng(seed)
    data = [d for d in (document(r) for _ in range(n_documents)) if d[0]]
    held, data = data[: len(data) // 10], data[len(data) // 10 :]
    data.sort(key=lambda d: len(d[0]))
    packs = []
    for k in range(0, len(data), batch):
        some = data[k : k + batch]
        longest = max(len(s) for s, _ in some)
        x = np.zeros((longest, len(some), markup.PATH_BINS + markup.WORD_BINS + markup.SHAPES), np.float32)
        y, mask = np.zeros((longest, len(some)), int), np.zeros((longest, len(some), 1), bool)
        for j, (s, labels) in enumerate(some):
            x[: len(s), j], y[: len(s), j], mask[: len(s), j] = markup.features(s), labels, True
        packs.append((x, y, mask))
    w = _start(rng, hidden)
    m1, m2 = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        for k in rng.permutation(len(packs)):
            x, y, mask = packs[k]
            f, kf = _forward(w, x, mask, "f", hidden)
            b, kb = _forward(w, x, mask, "r", hidden)
            both = np.concatenate((f, b), axis=2)
            z = both @ w["ow"] + x @ w["xw"] + w["ob"]
            z -= z.max(axis=2, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=2, keepdims=True)
            p[np.arange(y.shape[0])[:, None], np.arange(y.shape[1])[None], y] -= 1
            d = (p * mask / mask.sum()).astype(np.float32)
            grad = {k2: np.zeros_like(v) for k2, v in w.items()}
            flat = d.reshape(-1, d.shape[2])
            grad["ow"] = both.reshape(-1, both.shape[2]).T @ flat
            grad["xw"] = x.reshape(-1, x.shape[2]).T @ flat
            grad["ob"] = flat.sum(axis=0)
            d_both = d @ w["ow"].T
            _backward(w, grad, x, mask, "f", hidden, kf, d_both[:, :, :hidden])
            _backward(w, grad, x, mask, "r", hidden, kb, d_both[:, :, hidden:])
            step += 1
            now = rate * (0.4**epoch)
            for k2 in w:
                m1[k2] = 0.9 * m1[k2] + 0.1 * grad[k2]
                m2[k2] = 0.99 * m2[k2] + 0.01 * grad[k2] ** 2
                w[k2] = (w[k2] - now * (m1[k2] / (1 - 0.9**step)) / (np.sqrt(m2[k2] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    got = markup.Labeller(w).label([s for s, _ in held])
    right = sum(a == b for g, (_, labels) in zip(got, held) for a, b in zip(g, labels))
    return w, right / max(1, sum(len(s) for s, _ in held))


if __name__ == "__main__":
    weights, accuracy = train()
    np.savez_compressed(markup.MODEL, **{k: v.astype(np.float16) for k, v in weights.items()})
    sys.stdout.write(f"held-out accuracy {accuracy:.4f}, {markup.MODEL.stat().st_size} bytes\n")
