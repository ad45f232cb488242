"""Kernels against brute force, without Spark."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from cardamom.llm import bpe, htmltext, language, mtree, neardup, privacy, substring, tokencount, toxicity, wordhash
from cardamom.llm.automaton import SuffixAutomaton
from cardamom.llm.decontaminate import Items
from cardamom.llm.queries import byte_vocabulary

SIGNS = "ab '’sStrevl  \n\n\t1２é漢字😀.!-_\x1c\x85　"


@pytest.fixture(scope="module")
def coder():
    data, pattern = byte_vocabulary()
    return bpe.ByteBPE(bpe.read_ranks(data), pattern)


def strings(n, most, seed, signs=SIGNS):
    rng = random.Random(seed)
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize(("leaf", "window"), [(7, 2), (1, 1), (30, 32)])
def test_bpe_is_tiktokens(coder, monkeypatch, leaf, window):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "WINDOW", window)
    for s in strings(1500, 80, 1) + strings(500, 60, 2, ["the", "ing", "qu", "er", "zz", "tion", "a"]):
        ids = coder.encode(s)
        assert ids == coder._core.encode_ordinary(s), s
        assert coder.decode(ids).decode() == s


@pytest.mark.parametrize("s", ["ab" * 30_000, "漢字" * 20_000, " " * 40_000, "!?" * 30_000 + "x"])
def test_bpe_long_word(coder, s):
    ids = coder.encode(s)
    assert ids == coder._core.encode_ordinary(s) and coder.decode(ids).decode() == s


def test_bpe_of_every_code_point(coder):
    """Texts over LEAF of all code points in pairs with a letter, a digit and one another, without a safe cut near."""
    points = [chr(c) for c in range(0x21, 0x110000) if not 0xD800 <= c < 0xE000 and not chr(c).isspace()]
    rng = random.Random(14)
    for pair in (lambda c: c + "鿿", lambda c: "a" + c, lambda c: c + "1", lambda c: c + rng.choice(points)):
        for at in range(0, len(points), 100_000):
            s = "".join(map(pair, points[at : at + 100_000]))
            assert len(s) > bpe.LEAF and coder.encode(s) == coder._core.encode_ordinary(s)


def test_token_tree_under_edits(coder, monkeypatch):
    monkeypatch.setattr(tokencount, "SEGMENT", 5)
    rng = random.Random(3)
    for s in strings(300, 60, 4):
        tree, now = tokencount.TokenTree(coder, s), s
        for new in strings(6, 7, rng.random()):
            a = rng.randint(0, len(now) + 2)
            b = a + rng.randint(0, 8)
            tree.edit(a, b, new)
            a, b = min(a, len(now)), min(b, len(now))
            now = now[:a] + new + now[b:]
            assert tree.text() == now
            assert tree.tokens == len(coder._core.encode_ordinary(now)), (s, now)


def test_edits_encode_little(coder):
    s = "some words of a text " * 2000
    tree = tokencount.TokenTree(coder, s)
    before = tree.encoded
    tree.edit(20_000, 20_005, "other")
    assert tree.encoded - before < 2000


def test_word_hashes_are_of_words_alone(monkeypatch):
    texts = [s.encode() for s in strings(200, 300, 5)] + [None, b"", b"x" * 5000]
    monkeypatch.setattr(wordhash, "SLICE", 64)
    h, s, e, first, joined = wordhash.many(texts)
    assert [joined[a:b] for a, b in zip(s, e, strict=True)] == [w for t in texts for w in (t or b"").split()]
    by_word = {}
    for x, a, b in zip(h.tolist(), s, e, strict=True):
        assert by_word.setdefault(joined[a:b], x) == x
    assert len(set(by_word.values())) == len(by_word)
    assert [int(b - a) for a, b in zip(first, first[1:], strict=False)] == [len((t or b"").split()) for t in texts]
    assert len(wordhash.windows(h, 5)) == len(h) - 4


def test_automaton_matches_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        owners = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(3)]
        sam = SuffixAutomaton()
        for k, s in enumerate(owners):
            sam.add(s, k)
        sam.finish()
        text, cap = [rng.choice("abc") for _ in range(20)], rng.randint(1, 6)
        subs = [{"".join(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)} for s in owners]
        for i, (v, n) in enumerate(sam.match(text, cap), 1):
            want = max((m for m in range(min(cap, i) + 1) if m == 0 or any("".join(text[i - m : i]) in x for x in subs)), default=0)
            assert n == want
            if n:
                assert sam.least[v] == min(k for k, x in enumerate(subs) if "".join(text[i - n : i]) in x)


def test_items_mark_windows_and_short_items():
    items = Items([("1", b"a b c d"), ("2", b"c d"), ("3", b""), (None, b"x y")], 3)
    code = [items.vocabulary.get(w, -1) for w in b"q a b c d x y".split()]
    spans, met = items.hits(code)
    assert sorted(met) == ["1", "2"]
    assert sum(b - a for a, b in spans) == 6  # a b c d, then x y


def test_sliding_minimum():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for n in range(1, 8):
        assert substring._sliding_min(x, n).tolist() == [min(x[i : i + n]) for i in range(len(x) - n + 1)]


def test_mtree_is_exact_and_prunes(monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 16)
    rng = np.random.default_rng(7)
    centers = rng.integers(-60, 60, (12, 8))
    x = (centers[rng.integers(0, 12, 1500)] + rng.integers(-2, 3, (1500, 8))).astype(float)
    x[100:160] = x[0]
    ids = rng.permutation(1500)
    tree = mtree.MTree(x, ids)
    q, own = x[:40], ids[:40]
    found = list(zip(*map(np.ndarray.tolist, tree.search(q, own, 10)), strict=True))
    for k in range(40):
        s = x @ q[k]
        want = sorted((-s[i], ids[i]) for i in range(1500) if ids[i] != own[k])[:10]
        assert sorted((-c, b) for a, b, c in found if a == k) == want
    assert tree.computed < 40 * 1500 / 2


def test_mtree_with_known_bounds():
    rng = np.random.default_rng(9)
    x, ids = rng.integers(-60, 60, (900, 5)).astype(float), np.arange(900)
    tree = mtree.MTree(x, ids)
    floors = np.array([-np.inf, *np.sort(x @ x[1])[-5:-4], *np.sort(x @ x[2])[-1:] + 1, 10.0])
    found = list(zip(*map(np.ndarray.tolist, tree.search(x[:4], ids[:4], 8, floors)), strict=True))
    for k in range(4):
        want = sorted((-s, i) for i, s in enumerate(x @ x[k]) if i != k and s >= floors[k])[:8]
        assert sorted((-c, b) for a, b, c in found if a == k) == want


def test_mtree_prunes_clusters():
    """The share of distances that a search computes, on clusters of 100 around random directions."""
    rng = np.random.default_rng(1)
    center = rng.normal(size=(100, 64))
    center /= np.linalg.norm(center, axis=1)[:, None]
    y = center[rng.integers(0, 100, 10_000)] + 0.05 * rng.normal(size=(10_000, 64))
    x = np.floor(64 * y / np.linalg.norm(y, axis=1)[:, None])
    tree = mtree.MTree(x, np.arange(10_000))
    tree.search(x[:500], np.arange(500), 20)
    assert tree.computed < 500 * 10_000 / 4


@pytest.mark.parametrize("spread,most", [(0.05, 1 / 3), (0.5, 1)])
def test_cells_out_of_reach_are_not_visited(spread, most):
    """No cell that holds one of a query's best is left out; of clustered vectors a query visits less than a third of the cells."""
    rng = np.random.default_rng(3)
    center = rng.normal(size=(100, 16))
    center /= np.linalg.norm(center, axis=1)[:, None]
    y = center[rng.integers(0, 100, 10_000)] + spread * rng.normal(size=(10_000, 16))
    x = np.floor(64 * y)
    cells = mtree.Cells({16: x[:4000]}, 100)
    cell, away = cells.place(x)
    assert cell.min() >= 1 and np.allclose(away, np.sqrt(((x - cells.means[16][1][cell - 1]) ** 2).sum(1)))
    cells.hold({c: ((cell == c).sum(), away[cell == c].max(), (x[cell == c] ** 2).sum(1).max()) for c in np.unique(cell).tolist()})
    scores = x[:200] @ x.T
    visited = [set() for _ in range(200)]
    entered = cells.visits(x[:200], np.full(200, -np.inf), False)
    for i, c in zip(*entered, strict=True):
        visited[i].add(c)
    floor = np.array([np.sort(scores[i][np.isin(cell, list(visited[i]))])[-20:][0] for i in range(200)])
    for i, c in zip(*cells.visits(x[:200], floor, True), strict=True):
        assert c not in visited[i]
        visited[i].add(c)
    for i in range(200):
        assert set(cell[scores[i] >= np.sort(scores[i])[-20]].tolist()) <= visited[i]
    assert sum(map(len, visited)) <= 200 * most * (cells.count > 0).sum()
    assert [len(a) for a in cells.visits(np.ones((2, 3)), np.zeros(2), False)] == [0, 0]


def test_mtree_empty_and_few():
    assert [len(a) for a in mtree.MTree(np.empty((0, 3)), np.empty(0, np.int64)).search(np.ones((2, 3)), np.array([1, 2]), 5)] == [0, 0, 0]
    assert len(mtree.MTree(np.ones((2, 3)), np.array([1, 2])).search(np.ones((1, 3)), np.array([1]), 5)[0]) == 1


def test_shingle_sets_and_signatures():
    one, short, none, empty = neardup.shingle_sets([b"A b c d e f a b c d e f", b"a b", None, b" \n"])
    assert len(one) == 6 and len(short) == 1 and len(none) == len(empty) == 0
    assert next(neardup.shingle_sets([b"a B c d e f a b c d e f"])).tolist() == one.tolist()
    rng = np.random.default_rng(8)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.concatenate([a[:2600], np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))])
    share = (neardup.signature(a) == neardup.signature(b)).mean()
    assert 0.55 < share < 0.95


@pytest.mark.parametrize("kind", privacy.KINDS)
def test_detectors_are_the_patterns(kind):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    good = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(d := re.sub(r"\D", "", s)) <= 19 and privacy.luhn(d),
        "phone": lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15,
    }
    signs = {"email": "ab@@..-_% é", "ip": "0125.....x", "card": "0123456789 -x", "phone": "++0123456789 ().-x"}
    texts = strings(3000, 60, 9, signs[kind]) + ["card 4111 1111 1111 1111.", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8.9", "é +1 (743) 555-3824!"]
    hits = 0
    for t in texts:
        want = [m.span() for m in re.finditer(patterns[kind], t, re.ASCII) if good[kind](m[0])]
        assert list(privacy.DETECTORS[kind](t)) == want, t
        hits += len(want)
    assert hits > 5


def test_detectors_on_long_texts_end_soon():
    for c in ("1", "a", ".", "@", "+1", "1 ", "a@", "1."):
        privacy.detect(c * 60_000)


def test_mask_joins_overlaps():
    assert privacy.mask("abcdefgh", [("ip", 1, 4), ("card", 2, 6), ("email", 7, 8)]) == "a[IP]g[EMAIL]"


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head&amp;line</h1><p>One <b>two
 three<br>four<p>A&nbsp;&lt;b&gt;</p><aside>side</aside><div class="ad">Buy</div><ul><li>x<li>y</ul><!-- no --><form>mail</form>
<section class="comments"><p>first!</p></section></article><footer>&copy; me</footer></body></html>"""


def test_page_text():
    assert [t for t, kind in htmltext.lines(PAGE) if kind == htmltext.IN] == ["Head&line", "One two three four", "A <b>", "x", "y"]


@pytest.mark.parametrize("page", ["", "<", "<p", "</", "<p title=\"a>b", "<!-- x", "<script>x", "a < b", "<a/><br/>", "</p></p>", "<![CDATA[x", "<?x", "<p>\x00</p>"])
def test_broken_pages_do_not_fail(page):
    htmltext.lines(page)


@pytest.mark.parametrize("c", ["é", "я", "日", "ß", "ª", "1", " ", "-", "_", "/", "<", "!", "?", "\x00", "\u2028", "\U0001f600", ""])
def test_end_tags_of_any_character(c):
    found = htmltext.lines(f"<article><p>a</{c}>b</p><p>c</p></article>")
    assert found[-1] == ("c", htmltext.IN) and found[0][0].startswith("a") and "b" in " ".join(t for t, _ in found)
    htmltext.lines(f"<article><p>a</{c}")
    htmltext.lines(f"<{c}><p>a</{c}x='>")
    if c.isalpha():
        assert found[0][0] == "ab"


def test_random_markup_does_not_fail():
    rng = random.Random(6)
    for _ in range(3000):
        htmltext.lines("".join(rng.choice(["<", ">", "/", "</", "é", "p", "li", "script", "=", '"', "'", " ", "!--", "-->", "&", ";", "x", "ª", "K", "\n"]) for _ in range(rng.randint(0, 25))))


@pytest.mark.parametrize("leaves", [[(6, 1)], [], [(24, 1)], [(0, 1), (21, 4)], [(21, None)], [(None, 1)]])
def test_leaves_that_do_not_fit_are_made_anew(leaves):
    data, pattern = byte_vocabulary()
    coder = bpe.ByteBPE(bpe.read_ranks(data), pattern)
    text = "hello brave new world"
    tree = tokencount.TokenTree(coder, text, leaves)
    assert tree.text() == text and tree.tokens == len(coder.encode(text))


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_shared_lines(monkeypatch, bits):
    monkeypatch.setattr(htmltext, "ALIGNED_BITS", bits)
    rng = random.Random(10)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = htmltext.shared(a, b)
        assert len(got) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in got)


@pytest.mark.parametrize("line", [lambda i: 0, lambda i: i % 3, lambda i: i, lambda i: i * 7919 % 8000])
def test_many_lines_are_aligned_soon(line):
    a, b = [line(i) for i in range(8000)], [line(i + 1) for i in range(7990)] + [-1]
    began = time.time()
    assert len(htmltext.shared(a, b)) > 80
    assert time.time() - began < 1


@pytest.mark.parametrize("page", ["<b>" * 10_000 + "</i>" * 10_000, "<b>" * 10_000 + "<p>x" * 10_000, "<div>" * 10_000 + "</p>" * 10_000, "<td>" * 20_000])
def test_open_and_stray_tags_end_soon(page):
    began = time.time()
    htmltext.lines(page)
    assert time.time() - began < 1


def test_classes_inside_an_article():
    page = '<article><h1>T</h1><p class="social-policy">a</p><p id="related">b</p><p class="search">c</p><div class="ad-slot">x</div><div class="comment-list">y</div></article>'
    assert [t for t, kind in htmltext.lines(page) if kind == htmltext.IN] == ["T", "a", "b", "c"]
    outside = '<div class="social-policy">a</div><div class="cookie-policy">x</div><div class="site-notice">y</div><div class="search-for-words">b</div><div class="article-footer">w</div><div id="shareButtons">z</div>'
    assert [t for t, kind in htmltext.lines(outside) if kind != htmltext.OUT] == ["a", "b"]


def model():
    texts = {"en": "the quick thing with that other thing " * 30, "fr": "les choses que nous avons vues " * 30, "ru": "это совсем другой язык " * 30}
    langs = sorted(texts)
    counts, scripts = np.zeros((3, language.BUCKETS)), np.zeros((3, len(language.SCRIPTS)))
    for i, k in enumerate(langs):
        b, _, s = language._features(texts[k])
        counts[i] += np.bincount(b, minlength=language.BUCKETS)
        scripts[i] += np.bincount(s, minlength=len(language.SCRIPTS))
    return language.Model(langs, counts, scripts)


def test_language_spans():
    m = model()
    lang, share, spans = m.label("the other thing with that thing " * 3 + "que nous avons vues les choses " * 2)
    assert lang == "en" and 0.4 < share < 0.8
    assert [s["lang"] for s in spans] == ["en", "fr"]
    assert m.label("совсем другой")[0] == "ru"
    assert m.label("") == ("und", 0.0, []) and m.label("12 34 !")[0] == "und"
    assert m.label("\u0301\u0301")[0] == "und" and m.label("1\u0308 2\u0308")[0] == "und"
    assert m.label("the other thing \u0301 1\u0308") == m.label("the other thing")
    assert m.label("漢字")[1] == 0.0 and m.label("漢字")[0] in m.langs


def test_viterbi_shortcut_agrees_with_the_recursion(monkeypatch):
    m = model()
    rng = np.random.default_rng(11)
    for _ in range(200):
        s = -rng.gamma(1, 6, (rng.integers(1, 30), 3))
        fast = m.viterbi(s)
        with monkeypatch.context() as patch:
            patch.setattr(language.Model, "_one_language", lambda self, s: None)
            slow = m.viterbi(s)

        def value(path):
            return sum(s[i, k] for i, k in enumerate(path)) - m.switch * int((np.diff(path) != 0).sum())

        assert abs(value(fast) - value(slow)) < 1e-6


def test_chain_finds_a_lexicon():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for _ in range(1200):
        toxic = rng.random() < 0.15
        w = rng.choices(words, k=60) + (rng.choices(["idiot", "scum", "moron"], k=3) if toxic else [])
        rng.shuffle(w)
        texts.append(" ".join(w).encode())
        labels.append((float(rng.random() < 0.2), float(toxic)))
    sets = list(toxicity._sets(texts))
    chain = toxicity.fit_chain(sets[:800], np.array(labels[:800]), ["low", "toxic"])
    p = chain.predict(toxicity._Rows(sets[800:]))[:, 1] >= chain.links[1].threshold
    y = np.array(labels[800:])[:, 1] > 0
    assert (p == y).mean() > 0.98


def test_chain_without_both_classes():
    chain = toxicity.fit_chain(list(toxicity._sets([b"a", b"b"])), np.array([[1.0, np.nan], [1.0, np.nan]]), ["x", "y"])
    assert chain.predict(toxicity._Rows(list(toxicity._sets([b"c"])))).shape == (1, 2)
    empty = toxicity.fit_chain([], np.empty((0, 2)), ["x", "y"])
    assert empty.predict(toxicity._Rows([])).shape == (0, 2)


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
