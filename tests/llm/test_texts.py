"""Quality, pages, secrets, benchmark passages, licences and the mix, against brute force and by hand."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from plumbline.llm import decontaminate, html_text, licences, mixing, quality, secrets
from plumbline.llm.words import WordNumbers

from .conftest import ODD


# ---- quality ---------------------------------------------------------------

def labelled(n, seed=1):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for _ in range(n):
        plain = [draw.choice(words) for _ in range(draw.randint(20, 120))]
        good = draw.random() < 0.8
        if not good:
            kind = draw.randrange(3)
            plain = [w.upper() + "!!" for w in plain] if kind == 0 else [w + draw.choice("#$%") for w in plain] if kind == 1 else [plain[0]] * 80
        texts.append(" ".join(plain) + ".")
        labels.append(int(good))
    return texts, labels


def test_quality_on_held_out_documents(frame, spark):
    texts, labels = labelled(1500)
    docs = frame([*texts, *ODD])
    rows = [(i, y, 0) for i, y in enumerate(labels)] + [(None, 1, 0), (3, None, 0), (10**6, 0, 0)]
    model = quality.train(docs, spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int"))
    scores = {r.row.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert len(scores) == len(texts) + len(ODD) and all(0 <= s <= 1 for s in scores.values())
    held = [i for i in range(len(texts)) if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= quality.CUT) == labels[i] for i in held]) > 0.97
    kept = quality.drop_poor(docs, spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= quality.CUT}


def test_quality_learns_from_all_pairs(frame, spark):
    """The weights are the optimum over every pair of a good and a poor training document, the threshold is a quantile of all of them."""
    texts, labels = labelled(700, 3)
    labels = [y if i % 11 else 1 - y for i, y in enumerate(labels)]  # no weights part them
    docs = frame(texts)
    mean, scale, weights, threshold = quality.train(docs, spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id bigint, quality int"))
    taught = [i for i in range(len(texts)) if crc32(str(i).encode()) % 5]
    f = np.array([quality.features(texts[i].encode()) for i in taught])
    y = np.array([labels[i] for i in taught])
    assert np.allclose(mean, f.mean(axis=0), atol=1e-8) and np.allclose(scale, np.where(f.std(axis=0) < 1e-6, 1, f.std(axis=0)), atol=1e-8)
    z = (f - mean) / scale
    s = z @ weights
    wrong = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0][None, :]))
    slope = (wrong.sum(1) @ z[y == 1] - wrong.sum(0) @ z[y == 0]) / wrong.size - quality.RIDGE * weights
    assert np.abs(slope).max() < 2e-5
    ordered = np.sort(s)
    at = np.searchsorted(np.cumsum(np.full(len(s), 1 / len(s))), 1 - y.mean())
    assert ordered[max(at - 1, 0)] < threshold <= ordered[at + 1] + 1e-6


def test_quality_learns_nothing_from_held_out_rows(frame, spark):
    texts, labels = labelled(400)
    docs = frame(texts)
    flipped = [(i, y, 0) for i, y in enumerate(labels)]
    held = {r.doc_id for r in docs.where(quality.held_out("doc_id")).select("doc_id").collect()}
    one = quality.train(docs, spark.createDataFrame(flipped, "doc_id bigint, quality int, toxic int"))
    two = quality.train(docs, spark.createDataFrame([(i, 1 - y if i in held else y, 1) for i, y, _ in flipped], "doc_id bigint, quality int, toxic int"))
    assert all(np.array_equal(a, b) for a, b in zip(one, two))


def test_quality_without_two_labels(frame, spark):
    docs = frame(["a", None, ""])
    for rows in ([], [(0, 1, 0), (1, 1, 0)], [(0, None, 0)]):
        model = quality.train(docs, spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int"))
        assert model is None and {r.score for r in quality.scored(docs, model).collect()} == {0.5}


# ---- pages -----------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p><article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice">We use cookies on this site, please agree to them all.</div>
<div id="wrap-3"><div class="post-17"><header><h1>The &amp; title</h1></header><p>First <b>bold</b>&nbsp;text&#33;<br>second
 line<p>Next <i>one</p><div class="ad">Buy now, it is cheap, it is good, it is yours</div><ul><li>x<li>y</ul><!-- <p>no</p> -->
<table><tr><td>1<td>2</table><form><p>Name</p><input></form></div>
<div class="sidebar">Links and more links in a long side bar text</div>
<div class="comments"><p>Great article, I have read it two times and more, thank you very much for it!</p></div></div><footer>&copy; us</footer></body></html>"""
MAIN = "The & title First bold text! second line Next one x y 1 2"


def test_page_by_itself():
    assert html_text.main_text(PAGE, None) == MAIN
    assert html_text.main_text(PAGE.replace('class="post-17"', "").replace('id="wrap-3"', "role=main"), None) == MAIN
    assert html_text.main_text(PAGE.replace('<div class="post-17">', "<article>").replace("</form></div>", "</form></article>"), None) == MAIN


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b</b></i>c", "a bc"), ("<div>a<div>b</div>c", "a b c"), ("<article></article>", ""),
    ("<article>a<script>b</script><style>c</article>", "a"), ("<article>a<!-- b", "a"), ("<p title='>'>x</p>", "x"), ("<article>1 < 2</article>", "1 < 2"),
    ("<main><p>in</p></main><p>out, and much longer than what is within the main part</p>", "in")])
def test_odd_pages(html, text):
    got = html_text.main_text(html, None)
    assert got == text or (text == "in" and got.endswith("main part"))


LONG = "<p>" + "A sentence of the article that tells something. " * 8 + "</p>"
SIDE = '<div class="sidebar"><p>Words on the side.</p></div>'


@pytest.mark.parametrize("html", [
    f'<div class="content-sidebar-wrap"><main>{LONG}</main>{SIDE}</div>', f'<div class="content-sidebar-wrap"><div class="x">{LONG}</div>{SIDE}</div>',
    f'<div class="layout-with-sidebar"><div class="x">{LONG}</div>{SIDE}</div>', f'<div class="post comments-open">{LONG}<div class="comments"><p>I like it.</p></div></div>',
    f'<div id="social-article">{LONG}</div>', f'<form id="aspnetForm"><div class="x">{LONG}</div><form class="search"><p>Search here</p></form>{SIDE}</form>',
    f'<div class="widget"><article>{LONG}</article></div><div id="comments"><article class="comment"><p>{"Well said. " * 90}</p></article></div>',
    f'<article>{LONG}<div class="related"><article><p>Another one</p></article></div></article>',
    f'<div class="x">{LONG}</div><div class="comment-list"><p>{"Well said. " * 400}</p></div>{SIDE}'])
def test_wrappers_of_the_page_are_no_boilerplate(html):
    want = " ".join(LONG[3:-4].split())
    assert html_text.main_text(f"<body><nav><a href='/'>Home</a></nav>{html}</body>", None) == want


@pytest.mark.parametrize("html, around", [
    ('<div class="post"><h1>Title</h1><p>Lead</p><div class="entry">{}</div><p>End</p></div>', "Title Lead {} End"),
    ('<div id="all"><div class="post"><div class="top"><h1>Title</h1></div><p>By <a href="/n">N</a>, on a day</p><div class="in"><div class="entry">{}</div></div></div>'
     '<div class="b">other words</div></div>', "Title By N, on a day {}"),
    ('<main><h1>Title</h1><div class="a"><div class="entry">{}</div></div></main><p>Out</p>', "Title {}"),
    ('<h1>Title</h1><div class="entry">{}</div><div class="menu"><p>Not this</p></div>', "Title {}"),
    ('<div id="all"><div class="x"><h1>Title</h1><div class="entry">{}</div></div><p><a href="/a">One other</a> <a href="/b">Two other</a></p></div>', "Title {}"),
    ('<div id="all"><div class="a">{}</div><div class="b">beside it</div></div>', "{}")])
def test_title_and_lead_around_the_best_container(spark, html, around):
    body = LONG * 6
    page, want = f"<body>{html.format(body)}</body>", around.format(" ".join(re.sub("<.*?>", " ", body).split()))
    assert html_text.main_text(page, None) == want
    pages = spark.createDataFrame([(i, "http://h.example/", page) for i in range(3)], "page_id bigint, url string, html string")
    assert {r.text for r in html_text.extract(pages).collect()} == {want}


def test_pages_follow_their_host(spark):
    def page(main, other):
        return f'<body><div class="a1">{main}</div><div class="b">{other}</div></body>'
    rows = [(i, "http://h.example/x", page(f"main text {i} " * 20, "short")) for i in range(9)]
    rows += [(9, "https://H.example:80/", page("few", "a long aside that has no name " * 20)), (10, None, page("x" * 50, "y")), (11, "nonsense", None), (11, "nonsense", None),
             (None, "http://other.example", page("few", "much longer " * 9))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS path", "'c' AS host", "2 AS raw", "'t' AS text")
    got = sorted(((r.id, r.text) for r in html_text.extract(pages).collect()), key=str)
    assert len(got) == len(rows)
    assert dict(got)[9] == "few" and dict(got)[0] == ("main text 0 " * 20).strip() and dict(got)[10] == "x" * 50
    assert dict(got)[None] == ("much longer " * 9).strip() and got.count((11, "")) == 2
    assert html_text.extract(pages.where("page_id < 0")).count() == 0


def test_many_hosts_join_by_shuffle(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7}.example/", f"<article>text {i}</article>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    monkeypatch.setattr(html_text, "FEW_HOSTS", 2)
    assert {r.id: r.text for r in html_text.extract(pages).collect()} == {i: f"text {i}" for i in range(30)}


# ---- secrets ---------------------------------------------------------------

def searched(text):
    out = []
    for name, (rule, group, least) in secrets.RULES.items():
        rule = "[0-9a-f]+" if name == "hex" else rule
        out += [(name, m.start(), m.end()) for m in re.finditer(rule, text, re.ASCII) if len(m[group]) >= least]
    rank = list(secrets.RULES)
    return sorted(out, key=lambda m: (m[1], rank.index(m[0])))


def test_secrets(frame, monkeypatch):
    monkeypatch.setattr(secrets, "STRETCH", 64)
    draw = random.Random(3)
    pieces = ["token", "secret", ":", "=", " ", '"', "'", "api_key", "AKIA", "passwd", "PassWord", "a1b2c3d4e5f6", "ABCDEFGHIJKLMNOP", "é", "\n", "x", ".", "ghp_",
              "0123456789abcdef0123", "-----BEGIN ", "PRIVATE KEY-----", "sk_live_", "apikey", "ſecret", "\U0001f600"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 40))) for _ in range(3000)] + ODD + ["token=" + "a" * 30_000]
    got = {r.id: [tuple(s) for s in r.spans] for r in secrets.secret_spans(frame(texts)).collect()}
    want = {i: searched(t or "") for i, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 2000
    assert secrets.secret_spans(frame(texts[:1]).where("doc_id < 0")).count() == 0


def test_automaton_is_minimal():
    kind, table, accept = secrets.automaton(["(?:ab|cb)+", "a[bc]b"])
    for a in range(len(table)):  # any two states are told apart by some word
        for b in range(a):
            seen, todo = set(), [(a, b)]
            while todo and all(accept[x] == accept[y] for x, y in todo):
                pairs = {(int(table[x][k]), int(table[y][k])) for x, y in todo for k in range(table.shape[1])} - seen
                seen |= pairs
                todo = list(pairs)
            assert todo


# ---- benchmark -------------------------------------------------------------

def edit_distance_within(a, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def plain(text):
    return "".join(" " if not c.isalnum() else c.lower() for c in text).split()


def brute_passages(text):
    m, half = len(text), len(text) // 2
    return [text] if m < decontaminate.WHOLE else [text[s:s + half] for s in (0, (m - half) // 2, m - half)]


def test_benchmark_passages(frame, spark):
    draw = random.Random(6)

    def text(n):
        return " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6))) for _ in range(n))

    def changed(s, edits):
        s = list(s)
        for _ in range(edits):
            at = draw.randrange(len(s))
            s[at:at + draw.choice([0, 1])] = draw.choice(["x", "", "zz"])
        return "".join(s)

    items = [text(n) for n in (8, 12, 20, 30, 60, 60, 90)] + ["tiny item", "", None]
    texts = [text(40) + " " + changed(draw.choice(items[:7]), draw.randint(0, 12)) + ". " + text(30) for _ in range(60)]
    texts += [items[4][len(items[4]) // 4:], items[5][:len(items[5]) // 3], "Tiny, ITEM!", "a tiny item", items[3].upper().replace(" ", " -\n"), *ODD[:-2], items[2], items[2]]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = decontaminate.contaminated(frame(texts), benchmark).collect()
    got = Counter((r.id, r.item) for r in found)
    want = set()
    for i, t in enumerate(texts):
        t = " ".join(plain(t or ""))[:2000]
        for k, item in enumerate(items):
            item = " ".join(plain(item or ""))
            if not item or (len(item) < decontaminate.SHORT and item != t):
                continue
            if len(item) < decontaminate.SHORT:
                want.add((i, k))
            elif any(edit_distance_within(p, t) <= min(int(len(p) * decontaminate.EDITS), (len(p) - 10) // 10) for p in brute_passages(item)):
                want.add((i, k))
    assert set(got) == want and set(got.values()) == {1} and 30 < len(want)
    clean = decontaminate.drop_contaminated(frame(texts), benchmark)
    assert clean.columns == frame(texts).columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {i for i, _ in want}


def least_edits(item, text, size):
    """For every substring of the item of that size the fewest edits to some part of the text."""
    codes, item = np.array([ord(c) for c in text]), np.array([ord(c) for c in item])
    runs = np.arange(len(item) - size + 1)
    columns = np.arange(len(codes) + 1)
    row = np.zeros((len(runs), len(columns)), np.int32)
    for i in range(size):
        new = np.full_like(row, i + 1)
        new[:, 1:] = np.minimum(row[:, :-1] + (codes != item[runs + i][:, None]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - columns, axis=1) + columns
    return row.min(axis=1)


def test_benchmark_runs_wherever_they_lie(frame, spark):
    draw = random.Random(12)

    def text(n):
        return " ".join("".join(draw.choice("abcdefé") for _ in range(draw.randint(2, 7))) for _ in range(n))

    size, limit = decontaminate.RUN, int(decontaminate.LENGTH * decontaminate.EDITS)
    items = [text(n) for n in (45, 70, 75, 120, 400)]
    texts, planted = [], []
    for k, item in enumerate(items):
        for s in (0, len(item) - size, *(draw.randrange(len(item) - size) for _ in range(6))):
            run = list(item[s:s + size])
            for at in draw.sample(range(5, size - 5), draw.choice([0, limit // 2, limit])):
                run[at] = draw.choice(["", "q", run[at] + "q"])
            texts.append(text(8) + " q" + "".join(run) + "q " + text(8))
            planted.append(k)
    for k, item in enumerate(items):
        for s in (3, 40):
            texts.append(text(8) + " " + item[s:s + 100] + " " + text(8))
            planted.append(k)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.id, r.item) for r in decontaminate.contaminated(frame(texts), benchmark).collect()}
    want = {(i, k) for i, k in enumerate(planted) if least_edits(items[k], " ".join(plain(texts[i])), size).min() <= limit}
    assert want <= got and len(want) == 8 * len(items)
    for i, k in got - want:  # a half, or a piece by itself
        t, m = " ".join(plain(texts[i])), len(items[k])
        assert k == planted[i] and any(least_edits(items[k], t, n).min() <= n * decontaminate.EDITS for n in (m // 2, decontaminate.LENGTH))
    clean = decontaminate.drop_contaminated(frame(texts), benchmark)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {i for i, _ in got}


def test_benchmark_in_parts_and_empty(frame, spark, monkeypatch):
    items = [" ".join(f"word{k}{i}" for i in range(12)) for k in range(6)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = frame([f"before {x} after" for x in items] + ["clean"])
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 200)
    assert {(r.id, r.item) for r in decontaminate.contaminated(docs, benchmark).collect()} == {(i, i) for i in range(6)}
    assert [r.text for r in decontaminate.drop_contaminated(docs, benchmark).collect()] == ["clean"]
    assert decontaminate.contaminated(docs, benchmark.where("item_id < 0")).count() == 0
    assert decontaminate.drop_contaminated(docs.where("doc_id < 0"), benchmark).count() == 0


# ---- licences --------------------------------------------------------------

def test_licences(frame):
    wrapped = [re.sub(r"(.{50,70}) ", r"\1\n", t) for _, t in licences.TEMPLATES]
    texts = [f"Some words here.\n{t}\nAnd others follow, of course." for t in wrapped]
    texts += ["Released under the MIT licence today", "released UNDER the mit-license", "Licensed under CC BY-NC 4.0. Released under the MIT License.", *ODD]
    got = {r.id: [(f.licence, round(f.dice, 2)) for f in r.found] for r in licences.licences(frame(texts)).collect()}
    n = len(wrapped)
    for i, (name, _) in enumerate(licences.TEMPLATES):
        assert name in {f[0] for f in got[i]}
        assert name != "BSD-3-Clause" or "BSD-2-Clause" not in {f[0] for f in got[i]}
    assert got[n] == [] and got[n + 1] == [("MIT", 1.0)] and got[n + 2] == [("CC-BY-NC-4.0", 1.0), ("MIT", 1.0)]
    assert all(got[i] == [] for i in range(n + 3, len(texts)))
    assert licences.licences(frame(texts).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("text, names", [
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    ("This work is licensed under the GNU General Public License, version 1.", []),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["CC-BY-ND-4.0"]),
    ("This work is licensed under a Creative Commons Attribution 3.0 International License.", ["CC-BY-3.0"]),
    ("This work is licensed under a Creative Commons Attribution-Non-Commercial 2.5 Generic License.", ["CC-BY-NC-2.5"]),
    ("All examples in this text are released under the MIT License.", ["MIT"]),
    ("The figures here, which are ours, are licensed under CC BY-NC-ND 4.0 and the code is released under the MIT License as of now.", ["CC-BY-NC-ND-4.0", "MIT"]),
    ("You know that this work is licensed under the GNU Lesser General Public License, version 2.1 or later, as all we do", ["LGPL-2.1"]),
    ("Some of this is licensed under a Creative Commons Attribution-ShareAlike 4.0 International licence, other parts are not", ["CC-BY-SA-4.0"]),
    ("Dual licensed under the MIT and GPL licenses.", ["MIT OR GPL"]), ("This package is dual-licensed: MIT License or Apache License 2.0.", ["MIT OR Apache-2.0"]),
    ("Licensed under the ISC License.", ["ISC"]), ("Licensed under the Mozilla Public License 2.0.", ["MPL-2.0"]), ("Licensed under the BSD 3-Clause License.", ["BSD-3-Clause"]),
    ("Licensed under the BSD 2-Clause License.", ["BSD-2-Clause"]), ("Distributed under the terms of the GNU GPL version 2.", ["GPL-2.0"]),
    ("We are released under the MIT of old", []), ("It is licensed under the terms of a contract", [])])
def test_licence_versions_variants_and_notices_inside_sentences(text, names):
    numbers, made = WordNumbers(), licences.prepared(licences.TEMPLATES)
    assert [f[0] for f in licences.finds(text.encode(), made, numbers, inside=True)] == names
    around = f"Words before it. {text} Words after it."
    assert [f[0] for f in licences.finds(around.encode(), made, numbers, inside=True)] == names


def test_licence_units_against_all():
    """Every unit of a short text compared with every template, without bounds."""
    draw = random.Random(8)
    templates = [("x", "a b c d e f g h"), ("y", "a b c x y z"), ("z", "m n o p q r s t u v w")]
    numbers, made = WordNumbers(), licences.prepared(templates)
    sets = {n: set(zip(t.split(), t.split()[1:])) for n, t in templates}
    for _ in range(300):
        words = [w for _ in range(3) for w in draw.choice(["a b c d e f g h", "a b c d x f g h", "a b c x y z", "m n o p q r s t", "k l", "q q q"]).split()]
        text = " ".join(w + draw.choice(["", "", "", ".", "\n"]) for w in words)
        bounds = [0]
        for unit in re.split(r"[\r\n]+|(?<=[.!?;:])[ \t]+", text):
            bounds.append(bounds[-1] + len(re.findall("[a-z]+", unit)))
        best = {}
        for s in bounds:
            for e in bounds:
                own = set(zip(words[s:e], words[s + 1:e]))
                for n, t in sets.items():
                    dice = 2 * len(own & t) / (len(own) + len(t))
                    if e > s and dice >= licences.LEAST:
                        best[n] = max(best.get(n, 0), dice)
        got = licences.finds(text.encode(), made, numbers)
        assert {f[0] for f in got} <= set(best) and bool(got) == bool(best)
        assert all(f[1] <= best[f[0]] + 1e-9 for f in got)
        if best:
            assert max(f[1] for f in got) == pytest.approx(max(best.values()))


def test_repeated_notices_in_linear_time():
    import time
    numbers, made = WordNumbers(), licences.prepared(licences.TEMPLATES)
    for notice, n in (("Licensed under CC BY-NC-SA 4.0. ", 20_000), ("licensed under cc by nc sa 4 0 and ", 20_000), (dict(licences.TEMPLATES)["ISC"] + "\n", 3000)):
        start = time.perf_counter()
        found = licences.finds((notice * n).encode(), made, numbers, inside=True)
        assert time.perf_counter() - start < 30
        assert found and (notice[-2] == "d" or len(found) == n), len(found)


# ---- mix -------------------------------------------------------------------

def brute_targets(sizes, weights=mixing.WEIGHTS):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix(spark):
    draw = random.Random(4)
    rows = [(i, "w " * draw.randint(0, 40), draw.choice(["b", "a", "é", None, "c"])) for i in range(600)]
    rows += [(700 + i, None if i % 3 else "", "empty") for i in range(20)] + [(None, "x y z", "a"), (5, "x y", "b"), (5, "x y", "b"), (800, "w " * 4000, "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS size", "'t' AS position", "2 AS positions", "3 AS place")
    got = mixing.mix(docs).collect()
    assert sorted(map(str, ((r.id, r.source, r.size) for r in got))) == sorted(str((i, s, len((t or "").split()))) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    aims = brute_targets(dict(sizes))
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(aims[s]) and len(r.positions) <= 2 for r in own)
        assert abs(sum(r.size * len(r.positions) for r in own) - aims[s]) <= max(r.size for r in own) / 2 + 1e-6
        assert all(0 <= p <= 1 for r in own for p in r.positions)
    assert sum(aims.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_in_order(spark):
    rows = [(i, f"w{i} " * 5, f"s{i % 3}") for i in range(300)] + [(7, "same", "s0"), (7, "same", "s0"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    ordered = mixing.in_training_order(docs)
    got = ordered.collect()
    taken = Counter({(r.id, r.source, r.text_hash): 0 for r in mixing.mix(docs).collect()})
    assert len(got) == sum(len(r.positions) for r in mixing.mix(docs).collect()) and taken
    places = [r.position for r in got]
    assert places == sorted(places) and ordered.columns == [*docs.columns, "position"]
    # the first weight fades out, the second grows
    early, late = Counter(r.source for r in got[:len(got) // 2]), Counter(r.source for r in got[len(got) // 2:])
    assert early["s0"] > late["s0"] and early["s1"] < late["s1"]


def test_position_inverts_the_integral(spark):
    from pyspark.sql import functions as F
    knots = ((0.0, 1.0), (0.25, 3.0), (0.5, 0.0), (1.0, 2.0))
    parts = [i / 40 for i in range(41)]
    got = [r.t for r in spark.createDataFrame([(p,) for p in parts], "d double").select(mixing.position(F.col("d"), knots).alias("t")).collect()]
    grid = np.linspace(0, 1, 400_001)
    area = np.concatenate([[0], np.cumsum(np.interp((grid[1:] + grid[:-1]) / 2, [k[0] for k in knots], [k[1] for k in knots]))])
    assert np.interp(got, grid, area / area[-1]) == pytest.approx(parts, abs=1e-5)


def test_empty_mix(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(none).count() == 0 and mixing.in_training_order(none).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], none.schema)
    assert {(r.id, r.size, r.target) for r in mixing.mix(blank).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}


@pytest.mark.parametrize("text, item", [("0" * 500_000, "0" * 250), ("a b " * 30_000, "a b " * 250), ("1 2 3 4 5 6 7 8 9 0 " * 4000, "1 2 3 4 5 6 7 8 9 0 " * 30),
                                        ("the quick brown fox jumps over it again " * 3000, "the quick brown fox jumqs over it agaim " * 20)])
def test_repetitive_texts_against_repetitive_items(text, item):
    """Memory is bounded by the text, whatever repeats."""
    import tracemalloc
    index, table = decontaminate.build_index([item]), decontaminate.letters()
    tracemalloc.start()
    hits = decontaminate._hits([text], index, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hits) == 1 and hits[0][:2] == (0, 0) and hits[0][3] <= 1
    assert peak < 150 << 20


def test_runs_of_a_gram_and_single_places(monkeypatch):
    """Bands from runs and small blocks find what edit distances over all places find."""
    draw = random.Random(8)
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    monkeypatch.setattr(decontaminate, "BLOCK", 64)
    table = decontaminate.letters()
    for _ in range(120):
        unit = "".join(draw.choice("ab 1") for _ in range(draw.randint(1, 9)))
        item = (unit * 200)[:draw.randint(40, 150)]
        if draw.random() < 0.5:
            item += "".join(draw.choice("abcdefg ") for _ in range(draw.randint(0, 9)))
        item = " ".join(item.split()).lower()
        if len(item) < decontaminate.SHORT:
            continue
        inside = list(item)
        for _ in range(draw.randint(0, 14)):
            inside[draw.randrange(len(inside))] = draw.choice("abxyz")
        text = "zq " * draw.randint(0, 40) + "".join(inside) + " kw" * draw.randint(0, 40)
        text = " ".join(text.split())
        index = decontaminate.build_index([item])
        edits = int(index.edits[0])
        # the last row of the table of edit distances of the whole item to any part of the text
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item):
            new = [i + 1]
            for j, d in enumerate(text):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        hits = decontaminate._hits([text], index, table)
        assert [h[2] for h in hits] == ([min(row)] if min(row) <= edits else []), (item, text)


PROSE = "A sentence of the article that goes on for some time, with commas and all. " * 6


@pytest.mark.parametrize("html, text", [
    ("<html><head><meta charset=utf-8><title>T</title><body><article>Hello text</article>", "Hello text"),
    ("<head><title>x</title><p>para</p><p>two", "para two"), ("<head><link rel=x>text", "text"), ("<head><script>var a</script></head><p>x", "x"),
    ("<main data-menu='hidden'>kept</main>", "kept"), ("<main data-hidden='false'>kept</main>", "kept"), ("<div title='hidden gems of Rome'>kept</div>", "kept"),
    ("<article>a<blockquote data-role='search' data-id='footer'>kept</blockquote></article>", "a kept"), ("<main title=' hidden '>kept</main>", "kept"),
    ("<p hidden>gone</p><p HIDDEN=''>gone</p><p class='x' class='ad'>kept</p>", "kept"), ("<p>a <a href='x>y'>b</a> c</p>", "a b c"),
    ("<p>x</p><!-- never <p>gone</p>", "x"), ("<p>x</p> y <!-- never", "x y"), ("<p>5 < 6 and a<b", "5 < 6 and a<b"), ("<p>x</p><script>never</p>", "x"),
    (f"<article><p>one</p><section class='related-work'><h2>Work</h2><p>{PROSE}</p></section></article>", f"one Work {PROSE.strip()}"),
    (f"<article><p>one</p><div class='search-results'><p>{PROSE}</p></div><p class='reply'>he said</p></article>", f"one {PROSE.strip()} he said"),
    (f"<article><p>{PROSE}</p><div class='related-posts'><p>see <a href=x>{PROSE}</a></p></div><div class='search'>go <button>x</button></div></article>", PROSE.strip()),
    (f"<article><p>{PROSE}</p><div class='comments'><p class='reply'>nice</p></div></article>", PROSE.strip())])
def test_pages_that_are_valid_and_odd(html, text):
    assert html_text.main_text(html, None) == text


@pytest.mark.parametrize("unit", ["<div></x>", "<span></b>", '<a "', '<a x="', "<a x='>", "<!", "<a ", "<div>t", "</script ", "<ul><li><p>", "<table><tr><td>x",
                                  "<div class=related-x>xx", "<!--", "= ", "<a =\"'", "<p></p></div>", "<article class=ad>x"])
def test_time_of_stray_tags_grows_with_the_page(unit):
    import time
    for page in (unit * (1_000_000 // len(unit)), "<p " + unit * (200_000 // len(unit)) + ">", "<script>" + unit * (200_000 // len(unit))):
        start = time.perf_counter()
        html_text.main_text(page, None)
        assert time.perf_counter() - start < 20


class Tree:
    """The same page read by Python's parser into a tree, with scores by climbing from every element."""

    def __init__(self, html):
        from html.parser import HTMLParser
        tree = self
        self.up, self.tag, self.step, self.own = [None], [""], [""], [0]
        outer = [0]

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                tree.up.append(outer[-1])
                tree.tag.append(tag)
                tree.step.append(tag + "." + dict(attrs).get("class", ""))
                tree.own.append(0)
                outer.append(len(tree.up) - 1)

            def handle_endtag(self, tag):
                outer.pop()

            def handle_data(self, data):
                tree.own[outer[-1]] += len(" ".join(data.split())) if not tree.gone(outer[-1]) else 0
        Reader().feed(html)

    def above(self, e):
        while e:
            yield e
            e = self.up[e]

    def gone(self, e):
        return any(self.tag[x] in ("nav", "footer", "aside", "a") for x in self.above(e))

    def scores(self):
        total = {}
        for e, size in enumerate(self.own):
            for rank, c in enumerate(c for c in self.above(e) if self.tag[c] in html_text.CONTAINERS):
                total[c] = total.get(c, 0) + size * 0.9 ** rank
        best = {}
        for c, score in total.items():
            path = tuple(self.step[x] for x in self.above(c))
            score *= {"article": 1.4, "main": 1.2, "body": 0.5}.get(self.tag[c], 1)
            if score:
                best[path] = max(best.get(path, 0), score)
        return sorted(round(s, 6) for s in best.values())


def test_scores_against_a_tree():
    draw = random.Random(12)

    def element(depth):
        if depth == 0 or draw.random() < 0.3:
            return " ".join(draw.choice(["word", "é", "longer"]) for _ in range(draw.randint(1, 6)))
        tag = draw.choice(["div", "section", "article", "main", "span", "b", "nav", "footer", "aside", "blockquote", "a", "table"])
        if tag == "a":
            return "<a>" + draw.choice(["link", "a b"]) + "</a>"
        inside = "".join(element(depth - 1) for _ in range(draw.randint(1, 4)))
        return f"<{tag} class='{draw.choice('xyz')}'>{inside}</{tag}>"

    for _ in range(200):
        page = "<html><body>" + "".join(element(5) for _ in range(4)) + "</body></html>"
        assert sorted(round(s, 6) for s in html_text.Page(page).scores().values()) == Tree(page).scores(), page


def test_pages_with_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a/1", "<p>x</p>", "h", "r", "t", "p"), (None, None, None, None, None, None, None)],
                               "page_id bigint, url string, html string, host string, raw string, text string, path string")
    assert sorted((r.id or 0, r.url, r.text) for r in html_text.extract(df).collect()) == [(0, None, ""), (1, "http://a/1", "x")]
    assert html_text.extract(df.where("false")).collect() == []
