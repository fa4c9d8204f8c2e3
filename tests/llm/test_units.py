"""Operators' numpy parts against brute force, without Spark."""

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bitplane, decontaminate, htmltext, licenses, lm, mixing, neardup, quality, sentences, textcore, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text("aAbB é日#|.\n\t\x1c", max_size=40)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words(rows):
    w = textcore.Words(pa.array(rows, pa.string()))
    got = [[w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.first[d], w.first[d + 1])] for d in range(len(rows))]
    assert got == [WORD.findall(t or "") for t in rows]


@settings(max_examples=60, deadline=None)
@given(texts)
def test_quality_counts(rows):
    s = quality.text_statistics(pa.array(rows, pa.string()), window=3)
    for d, t in enumerate(x or "" for x in rows):
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        spans = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        hit = {k + j for k, x in enumerate(spans) if spans.count(x) > 1 for j in range(3)}
        assert s["n_words"][d] == len(words)
        assert s["word_chars"][d] == sum(map(len, words))
        assert s["n_symbols"][d] == len(re.findall(r"[#*$%&|<>]", t))
        assert s["n_dup_lines"][d] == len(lines) - len(set(lines))
        assert s["n_repeat_words"][d] == len(hit)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([1, 8]))
def test_planes(ids, bits):
    x = np.array(ids, "<u4")
    assert (bitplane.join_planes(bitplane.split_planes(x, bits), len(x), bits) == x).all()


@pytest.mark.parametrize("bits", [1, 8])
def test_shard(tmp_path, bits):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50000, n).astype(np.uint32) for n in (0, 5, 700, 1, 0, 1300)]
    with open(tmp_path / "x", "wb") as f:
        w = bitplane.ShardWriter(f, block=256, bits=bits)
        w.add(np.arange(6), np.array([True] + [False] * 5), np.array([len(d) for d in docs]), np.concatenate(docs))
        assert w.close() == (6, sum(map(len, docs)))
    with open(tmp_path / "x", "rb") as f:
        r = bitplane.ShardReader(f)
        got = list(r.documents())
        assert [g[0] for g in got] == [None, 1, 2, 3, 4, 5] and all((g[2] == d).all() for g, d in zip(got, docs, strict=True))
        flat = np.concatenate(docs)
        assert (r.ids(200, 900) == flat[200:900]).all() and len(r.ids(5, 5)) == 0


def test_encoder_matches_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    e = bitplane.WordEncoder(public.path("word_bpe_49k.json"))
    random.seed(3)
    signs = "aAzZ09'sStT!.,<|>endoftext éÉàß×÷ĀſİñŃ日本١²½\n\t\x1c\x7f\x00-_$%Σς́"
    rows = ["".join(random.choice(signs) for _ in range(random.randint(0, 40))) for _ in range(800)] + ["<|endoftext|> a", "it's I'LL", "", None]
    ids, n = e.encode(pa.array(rows), 2)
    off = np.concatenate([[0], np.cumsum(n)])
    for k, t in enumerate(rows):
        assert ids[off[k] : off[k + 1]].tolist() == [*e.tok.encode(t or "", add_special_tokens=False).ids, 2]


def test_targets():
    f = Fraction
    t = mixing.targets([100, 1000, 10], [3, 1, 2], f(3, 2), f(2))
    assert t[0] == 200 and t[2] == 20 and sum(t) == f(3, 2) * 1110
    assert mixing.targets([], [], f(3, 2), f(2)) == [] and mixing.targets([0], [3], f(3, 2), f(2)) == [0]


def test_first_words():
    assert mixing.first_words("  a b\n c", 2) == "  a b" and mixing.first_words(None, 1) is None and mixing.first_words("a", 0) == ""


def edit_distance_inside(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination_against_full_alignment():
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefg") for _ in range(random.randint(2, 6)))
    items = [" ".join(word() for _ in range(30)) for _ in range(8)] + ["short one", ""]
    rows = []
    for k in range(60):
        body = [word() for _ in range(random.randint(0, 60))]
        if k % 2:
            x = list(items[k % 8])
            for _ in range(random.choice([0, 1, 3, 6, 9, 14])):
                p = random.randrange(len(x))
                random.choice([lambda: x.pop(p), lambda: x.insert(p, "q"), lambda: x.__setitem__(p, "z")])()
            body.insert(random.randint(0, len(body)), "".join(x).upper() if k % 4 == 1 else "".join(x))
        rows.append("\n".join(body))
    rows += [None, "", "a SHORT\tone b", "shorty one"]
    found = {(d, i): e for d, i, _, _, e, _, _ in decontaminate.Items(list(range(len(items))), items, 0.05).matches(pa.array(rows))}
    for d, t in enumerate(rows):
        plain = " ".join((t or "").lower().split())
        for i, item in enumerate(x for x in items if x):
            q = decontaminate.Q
            k = 0 if len(item) < q + 8 else min(int(0.05 * len(item)), (len(item) - q) // q)
            if len(item) < q + 8:
                assert ((d, i) in found) == (f" {item} " in f" {plain} ")
                continue
            e = edit_distance_inside(item, plain)
            assert ((d, i) in found) == (e <= k) and found.get((d, i), e) == e


def test_decontamination_of_parts_substitutions_and_repetition(monkeypatch):
    monkeypatch.setattr(decontaminate, "HITS", 50)  # hits are counted in many parts
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefghijklm") for _ in range(random.randint(3, 7)))
    item = [word() for _ in range(120)]
    sub = [word() if k % 16 == 5 else w for k, w in enumerate(item)]  # one word in sixteen replaced
    rows = [" ".join(item[40:100]), "x y " + " ".join(item[:-15]) + " z", " ".join(sub), " ".join(word() for _ in range(300)), " ".join(item[60:80]), "ab " * 4000, "no aa bb no", "aa bb"]
    got = {(d, i): (size, e) for d, i, size, _, e, _, _ in decontaminate.Items([7, 8, 9], [" ".join(item), "ab " * 200, "AA  bb"], 0.08).matches(pa.array(rows))}
    assert set(got) == {(0, 0), (1, 0), (2, 0), (5, 1), (6, 2), (7, 2)} and got[0, 0] == (200, 0) and got[5, 1][1] == 0 and 0 < got[2, 0][1] <= 16


PAGE = """<html><head><title>T &amp; x</title><script>var a="</p><p>no";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, accept them all please and go on</div>
{open}<h1>Title  here</h1><p><b>First &amp;  para<br>goes on<p>Second&nbsp;one &eacute; is a good deal longer than that, with many words in it.</p><div class="ad">Buy things now</div>
<p>Be.</p><form><input value=x>Send</form>{close}
<section id="comments"><p>Great article, I read every word of it and liked it very much indeed.</p></section><aside>Side text</aside><footer>&copy; site</footer></body></html>"""
WANT = "Title here\n\nFirst & para goes on\n\nSecond one é is a good deal longer than that, with many words in it.\n\nBe."


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html(tag):
    assert htmltext.extract(PAGE.format(open=f"<{tag}>", close=f"</{tag}>")) == WANT


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("<p>", ""), ("plain &lt;b&gt;", "plain <b>"), ("<article><p>a longer text</article><p>tail", "a longer text"), ("<!-- x --><p>un<b>closed", "unclosed"), ("<![bad <p>x</p>", "")])
def test_html_edges(html, text):
    assert isinstance(htmltext.extract(html), str)
    if html != "<![bad <p>x</p>":
        assert htmltext.extract(html) == text


LONG = "word after word " * 12


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "comments-open", "related-posts-enabled", "search-results", "page-with-sidebar"])
def test_html_wrappers_that_name_a_state(name):
    got = htmltext.extract(f"<body><div class='{name}'><h2>Head</h2><p>{LONG}</p><div class='sidebar'><p>{LONG}</p></div></div></body>")
    assert got == f"Head\n\n{LONG.strip()}"


def test_html_marked_wrapper_with_the_heading_and_most_text():
    got = htmltext.extract(f"<body><div class='promo'><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><div class='promo'><p>{LONG}</p></div></body>")
    assert got == f"Head\n\n{LONG.strip()}\n\n{LONG.strip()}"


@pytest.mark.parametrize(
    "inner",
    [
        "<div class='entry-header'><h1>Head</h1></div><p>{0}</p>",
        "<h1>Head</h1><section id='related-work'><p>{0}</p></section>",
        "<h1>Head</h1><div id='copyright-law'><p>{0}</p></div>",
        "<h1 id='navigation-menus'>Head</h1><p>{0}</p>",
        "<h1>Head</h1><div class='alert alert-info'><p>{0}</p></div>",
        "<header><nav><h2>Sections</h2></nav><h1>Head</h1></header><p>{0}</p><ul class='related'><li><a href=a>Other</a></ul><div class='share-bar'>Tell friends</div>",
        "<h1>Head</h1><p>{0}</p><article class='comment'><p>{0}</p></article><div class='reader-comments'><p>{0}</p></div><div class='ad-slot'>{0}</div>",
    ],
)
def test_html_names_need_a_second_vote_inside_an_article(inner):
    for around in ("<article>{}</article>", "<main>{}</main>"):
        assert htmltext.extract("<body>" + around.format(inner.format(LONG)) + "</body>") == f"Head\n\n{LONG.strip()}"


def test_html_id_that_spells_its_heading():
    page = "<body><div><h1>Head</h1><p>{0}</p><section id='comments-on-law'><h2>Comments on law</h2><p>{0}</p></section><section id='comments'><h2>Comments</h2><p>{0}</p></section></div></body>"
    assert htmltext.extract(page.format(LONG)) == f"Head\n\n{LONG.strip()}\n\nComments on law\n\n{LONG.strip()}"


def test_html_short_article_before_an_unmarked_text_of_its_size():
    got = htmltext.extract(f"<body><div><h1>Head</h1><p>{LONG}</p></div><div><p>Reply {LONG}</p></div></body>")
    assert got.startswith(f"Head\n\n{LONG.strip()}")


def test_html_several_articles():
    page = f"<body><nav><a href=a>a</a></nav><article><h2>One</h2><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG}{LONG}</p></article><article><a href=b>Teaser</a></article></body>"
    assert htmltext.extract(page) == f"One\n\n{LONG.strip()}\n\nTwo\n\n{(LONG + LONG).strip()}"


def test_html_deep_pages_take_linear_time():
    import time

    began = time.process_time()
    n = 100_000
    assert htmltext.extract("<div>" * n + f"<p>{LONG}</p>" + "</div>" * n) == LONG.strip()
    assert htmltext.extract("<div>" * n + "</section>" * n + f"<p>{LONG}</p>") == LONG.strip()
    assert htmltext.extract("<article>" + "<section><h2>a</h2>" * (n // 10) + f"<p>{LONG}</p>").endswith(LONG.strip())
    assert time.process_time() - began < 15


@pytest.mark.parametrize("start", ["<head><title>x</title><body>", "<head><meta charset=a><title>x</title>", "<svg><path d=1>", "<noscript>", "<![if x]><![ endif]>", "<iframe src=a>", "<head><script>if (a < b) {}</script>"])
def test_html_unclosed_and_odd_starts(start):
    assert htmltext.extract(f"{start}<p>{LONG}</p><p>{LONG}</p>") == f"{LONG.strip()}\n\n{LONG.strip()}"


def test_sketch_estimates():
    h, rng = neardup.Hasher(), np.random.default_rng(0)
    for shared in (50, 80, 95):
        base = rng.integers(0, 2**63, 1000).astype(np.uint64)
        a = np.sort(base)
        b = np.sort(np.concatenate([base[: shared * 10], rng.integers(0, 2**63, 1000 - shared * 10).astype(np.uint64)]))
        j = shared * 10 / (2000 - shared * 10)
        x, y = (np.unpackbits(h.sketch(h.samples(s))) for s in (a, b))
        assert abs(neardup.similarity(np.array([(x != y).sum()]), h.k)[0] - j) < 0.13


def dice_by_hand(text, template, least):
    """The best coefficient over every run of words of the text."""
    trim = lambda t: [x for x in (w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in t.lower().split()) if x]
    a, b = trim(text), trim(template)
    want = set(zip(b, b[1:], strict=False))
    best = 0
    for i in range(len(a)):
        for j in range(i + 2, min(len(a), i + int(len(b) * 2 / least) + 2) + 1):
            have = set(zip(a[i : j - 1], a[i + 1 : j], strict=True))
            best = max(best, 2 * len(have & want) / (len(have) + len(want)))
    return best


def test_licenses_against_every_run():
    t = licenses.Templates(licenses.TEMPLATES, 0.85)
    rows = ["x y\nReleased under the MIT License.\nz", "RELEASED under the  mit license", "nothing here at all", None, "", "license"]
    assert [b[0] for b in licenses._scan_part(t, pa.array(rows))] == ["MIT notice", "MIT notice", None, None, None, None]
    mit = licenses.TEMPLATES["MIT"]
    cut = [mit.index("The above"), mit.index("THE SOFTWARE")]
    three = f"some words\n\n// {mit[: cut[0]]}\n \n{mit[cut[0] : cut[1]]}\r\n\r\n# {mit[cut[1] :]}\n" + "int main() { return 0; }\n" * 40
    assert licenses._scan_part(t, pa.array([three]))[0][:3] == ("MIT", 1.0, int(t.size[t.names.index("MIT")]))
    random.seed(8)
    short = {k: licenses.TEMPLATES[k] for k in ("MIT notice", "GPL-2.0 notice", "GPL-3.0 notice", "BSD-3-Clause notice")}
    s, rows = licenses.Templates(short, 0.6), []
    for _ in range(60):
        w = random.choice(list(short.values())).split() + random.choice(["", "The MIT License again"]).split()
        for _ in range(random.randrange(6)):
            w[random.randrange(len(w))] = random.choice(["of", "the", "word", "license"])
        rows.append(" ".join([random.choice(["a", "the", "is"]) for _ in range(random.randrange(8))] + w + ["code", "is"] * random.randrange(4)))
    for text, got in zip(rows, licenses._scan_part(s, pa.array(rows)), strict=True):
        each = {k: dice_by_hand(text, v, 0.6) for k, v in short.items()}
        assert (got[0] is None) == (max(each.values()) < 0.6)
        if got[0]:
            assert abs(each[got[0]] - got[1]) < 1e-9
    assert licenses._scan_part(licenses.Templates({}, 0.85), pa.array(["a b c"])) == [(None,) * 5]


def test_segments():
    w = textcore.Words(pa.array(['One two. "Three four!" five\nsix.', None, "a. b. c."]))
    starts, first = sentences.segment(w)
    assert np.diff(first).tolist() == [4, 0, 3] and starts.tolist() == [0, 2, 4, 5, 6, 7, 8, 9]


def test_gradient_is_the_loss_derivative():
    rng = np.random.default_rng(2)
    net = lm.Network(4 * 3 + lm.TAILS, 4, 3, 5)
    net.start(rng.normal(size=4 + lm.TAILS), rng.normal(size=(4, 3)))
    net.flat = net.flat.astype(np.float64)
    net.p = net._views(net.flat)
    idx = rng.integers(0, 4 * 3 + lm.TAILS, (6, 3))
    live, reset = rng.random((6, 3)) < 0.8, rng.random((6, 3)) < 0.2
    h = rng.normal(size=(3, 5))
    lm_f32, lm.F32 = lm.F32, np.float64
    try:
        g, _, _ = net.gradient(idx, live, reset, h)
        for k in rng.choice(len(net.flat), 40, replace=False):
            old = net.flat[k]
            net.flat[k] = old + 1e-5
            up = net.gradient(idx, live, reset, h)[2]
            net.flat[k] = old - 1e-5
            down = net.gradient(idx, live, reset, h)[2]
            net.flat[k] = old
            assert abs((up - down) / 2e-5 - g[k]) < 1e-5
    finally:
        lm.F32 = lm_f32


def test_state_runs_through_windows():
    rng = np.random.default_rng(3)
    net = lm.Network(4 * 3 + lm.TAILS, 4, 3, 5)
    net.start(rng.normal(size=4 + lm.TAILS), rng.normal(size=(4, 3)))
    n = np.array([70, 3, 150, 1])
    off = np.concatenate([[0], np.cumsum(n)])
    idx = rng.integers(0, 4 * 3 + lm.TAILS, off[-1])
    got = lm.document_scores(net, idx, off, lanes=2, steps=16)
    for d in range(4):
        x = idx[off[d] : off[d + 1]]
        states, _ = net.run(x[:, None], np.zeros((len(x), 1), bool), np.zeros((1, 5), np.float32))
        assert abs(net.log_probs(states[:, 0], x).sum() - got[d]) < 1e-3


def test_network_against_a_plain_loop():
    """The probabilities of a document's tokens, worked out one token and one unit at a time."""
    rng = np.random.default_rng(4)
    classes, members, d = 3, 4, 5
    net = lm.Network(classes * members + lm.TAILS, classes, members, d)
    net.start(rng.normal(size=classes + lm.TAILS), rng.normal(size=(classes, members)))
    idx = rng.integers(0, classes * members + lm.TAILS, 60)
    p, h, total = {k: v.astype(float) for k, v in net.p.items()}, np.zeros(d), 0.0
    for t in idx:
        cls = t // members if t < classes * members else classes + t - classes * members
        logits = [sum(h[i] * p["c"][i, k] for i in range(d)) + p["cb"][k] for k in range(classes + lm.TAILS)]
        total += logits[cls] - np.log(sum(np.exp(x) for x in logits))
        if cls < classes:
            logits = [sum(h[i] * p["m"][cls, i, k] for i in range(d)) + p["mb"][cls, k] for k in range(members)]
            total += logits[t % members] - np.log(sum(np.exp(x) for x in logits))
        a = [sum(h[i] * p["u"][i, k] for i in range(d)) + p["x"][t, k] + p["b"][k] for k in range(2 * d)]
        z, n = [1 / (1 + np.exp(-x)) for x in a[:d]], [np.tanh(x) for x in a[d:]]
        h = np.array([z[i] * h[i] + (1 - z[i]) * n[i] for i in range(d)])
    assert abs(lm.document_scores(net, idx, np.array([0, 60]))[0] - total) < 1e-3


def test_gradient_over_many_blocks():
    """Windows of several blocks of rows, classes of many and of no tokens, and scores far from 0, against plain formulas."""
    rng = np.random.default_rng(6)
    classes, members, d, tails = 3, 4, 5, lm.TAILS
    heads = classes * members
    idx = np.where(rng.random((40, 60)) < 0.6, rng.integers(0, 6, (40, 60)), rng.integers(heads, heads + tails, (40, 60)))  # class 2 has none
    for scale, live in ((1, np.ones(idx.shape, bool)), (200, rng.random(idx.shape) < 0.9)):
        net = lm.Network(heads + tails, classes, members, d)
        net.start(rng.normal(size=classes + tails), rng.normal(size=(classes, members)))
        net.p["c"] *= scale
        reset, h = rng.random(idx.shape) < 0.1, rng.normal(size=(60, d)).astype(np.float32)
        p = {k: v.astype(float) for k, v in net.p.items()}
        states, z, n = (np.zeros((40, 60, d)) for _ in range(3))
        s = h.astype(float)
        for t in range(40):
            s = np.where(reset[t][:, None], 0, s)
            states[t] = s
            a = s @ p["u"] + p["x"][idx[t]] + p["b"]
            z[t], n[t] = 1 / (1 + np.exp(-a[:, :d])), np.tanh(a[:, d:])
            s = n[t] + z[t] * (s - n[t])
        want = {k: np.zeros_like(v) for k, v in p.items()}
        dh_out, loss, count = np.zeros_like(states), 0.0, live.sum()
        for t, k in zip(*np.nonzero(live), strict=True):
            i, v = idx[t, k], states[t, k]
            c = i // members if i < heads else i - heads + classes
            for w, b, at, put in [(p["c"], p["cb"], c, (want["c"], want["cb"]))] + ([(p["m"][c], p["mb"][c], i % members, (want["m"][c], want["mb"][c]))] if i < heads else []):
                logits = v @ w + b
                e = np.exp(logits - logits.max())
                loss -= np.log(e[at] / e.sum())
                e /= e.sum()
                e[at] -= 1
                put[0][...] += np.outer(v, e) / count
                put[1][...] += e / count
                dh_out[t, k] += w @ e / count
        dh = np.zeros_like(s)
        for t in range(39, -1, -1):
            dx = np.concatenate([dh * (states[t] - n[t]) * z[t] * (1 - z[t]), dh * (1 - z[t]) * (1 - n[t] ** 2)], axis=1)
            want["u"] += states[t].T @ dx
            want["b"] += dx.sum(axis=0)
            np.add.at(want["x"], idx[t], dx)
            dh = np.where(reset[t][:, None], 0, dh * z[t] + dx @ p["u"].T + dh_out[t])
        flat, after, got = net.gradient(idx, live, reset, h.copy())
        assert abs(after - s).max() < 1e-5 and abs(got - loss / count) < 1e-4 * scale
        for k, v in net._views(flat).items():
            assert abs(v - want[k]).max() < 1e-4 * max(1e-3, abs(want[k]).max()), k
        every = idx[live]
        by = [net.log_probs(states[live].astype(np.float32), every, block=b) for b in (2048, 7)]
        assert abs(by[0] - by[1]).max() < 1e-4 * scale


def test_places_of_hashes_read_few_keys():
    rng, ends = np.random.default_rng(7), np.iinfo(np.int64)
    spread = np.unique(rng.integers(ends.min, ends.max, 50_000))
    for keys in (spread, spread[:1], np.zeros(0, np.int64), np.array([ends.min, -1, 0, ends.max]), np.arange(3000), np.append(np.arange(3000), spread[-5:])):
        h = np.concatenate([keys, keys[1:] - 1, rng.integers(ends.min, ends.max, 1000), [ends.min, ends.max, 0, 7, 5000]])
        at = np.searchsorted(keys, h)
        there = np.append(keys, 0)[at] == h
        there[at == len(keys)] = False
        assert np.array_equal(lm.Places(keys)(h), np.where(there, at, len(keys)))
    find, h = lm.Places(spread), rng.permutation(spread)
    first = find.first[(h >> find.shift) + find.half]
    assert (find(h) - first + 1).mean() < 2  # keys read for a hash; a binary search reads 16


def test_training_lowers_the_loss_and_repeats():
    rng = np.random.default_rng(5)
    idx = (np.arange(6000) % 7 + (rng.random(6000) < 0.05)).astype(np.int32)
    off = np.array([0, 10, 2500, 6000])
    made = []
    for _ in range(2):
        net = lm.Network(12 + lm.TAILS, 3, 4, 8)
        net.start(np.zeros(3 + lm.TAILS), np.zeros((3, 4)))
        before = lm.document_scores(net, idx, off).sum()
        lm.train_local(net, idx, off)
        made.append((before, lm.document_scores(net, idx, off).sum()))
    assert made[0] == made[1] and made[0][1] > 0.5 * made[0][0]


def mcd_by_hand(x, h, floor):
    """Concentration steps to the end from medians, from the nearest half of h rows too; the least determinant wins."""
    k, best = lambda share: max(1, int(np.ceil(share * len(x)))), None
    for share in (1.0, 0.5):
        m = np.sort(x, axis=0)[(len(x) + 1) // 2 - 1]
        dev = np.sort(np.abs(x - m), axis=0)[(len(x) + 1) // 2 - 1]
        q, last = np.diag(1 / ((1.4826 * dev) ** 2 + floor**2)), np.inf
        for step in range(100):
            d = np.einsum("ni,ij,nj->n", x - m, q, x - m)
            near = x[d <= np.sort(d)[k(h * (share if step == 0 else 1)) - 1]]
            m = near.mean(axis=0)
            cov = near.T @ near / len(near) - np.outer(m, m) + np.diag(floor**2)
            q, det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
            if step > 1 and last - det <= 1e-3:
                break
            last = det
        if best is None or det < best[0]:
            best = (det, m, q)
    return best


def test_nnpu_learns_from_positives_only():
    random.seed(1)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    clean = lambda: " ".join(word() for _ in range(40))
    bad = lambda: clean() + " " + random.choice(["zzyxx", "qqvww"]) + "ing"
    model = toxicity.fit([bad() for _ in range(150)], [clean() for _ in range(540)] + [bad() for _ in range(60)], 0.1)
    table = model.table()
    good, worse = (model.scores(pa.array([f() for _ in range(100)] + ["", None]), table)[:100] for f in (clean, bad))
    assert (worse > np.quantile(good, 0.95)).mean() > 0.95
    assert ((model.scores(pa.array(["", None]), table) >= 0) & (model.scores(pa.array(["", None]), table) <= 1)).all()
