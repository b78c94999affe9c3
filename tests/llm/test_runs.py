"""Runs against a reading of the definition for every period."""

import random
import time
from hashlib import sha256
from zlib import crc32

from plumbline.llm import queries, runs
from plumbline.llm.words import WordNumbers

from .conftest import ODD


def plain(words):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            run = words[start:start + length]
            if length >= max(12, 2 * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(draw, count):
    for _ in range(count):
        n, letters = draw.randint(0, 120), draw.randint(1, 6)
        words = [b"w%d" % draw.randrange(letters) for _ in range(n)]
        if n > 5 and draw.random() < 0.6:
            at = draw.randrange(n)
            p = draw.randint(1, max(1, (n - at) // 2))
            words[at:] = [words[at + i % p] for i in range(n - at)]
            words += [b"w%d" % draw.randrange(letters) for _ in range(draw.randint(0, 40))]
        if words and draw.random() < 0.1:
            words = [words[0]] * draw.randint(0, 60) + words
        yield words


def test_runs_against_every_period():
    for words in sequences(random.Random(4), 1500):
        found = runs.runs_of(words, WordNumbers().of(words))
        assert found == plain(words), words
        dropped = {i for s, n, q in found for i in range(s + q, s + n)}
        assert runs.without_repeats(words, found) == [w for i, w in enumerate(words) if i not in dropped]


def test_the_automaton_without_marks():
    for words in sequences(random.Random(5), 500):
        assert sorted(runs.squares(words), key=lambda r: (r[0], r[2])) == plain(words)


def test_edges():
    def of(text):
        words = text.split()
        return runs.runs_of(words, WordNumbers().of(words))
    assert of(b"a " * 11) == [] and of(b"a " * 12) == [(0, 12, 1)]
    assert of(b"a b c d e f a b c d e") == [] and of(b"a b c d e f a b c d e f") == [(0, 12, 6)]
    assert of(b"a b " * 6) == [(0, 12, 2)] and of(b"a b c d e " * 2 + b"a") == [] and of(b"a b c d e " * 2 + b"a b") == [(0, 12, 5)]
    seven = b"a b c d e f g "
    assert of(seven + seven[:-2]) == [] and of(seven * 2) == [(0, 14, 7)]


def test_long_texts_in_bounded_time():
    draw = random.Random(6)
    distinct = [b"w%d" % i for i in range(30_000)]
    for words, want in ([b"x"] * 300_000, 1), (distinct[:1000] * 100, 1), ((distinct * 2)[:-1] + [b"other"], 0), \
            ([draw.choice(distinct) for _ in range(100_000)], 0), (distinct * 2, 1):
        start = time.perf_counter()
        assert len(runs.runs_of(words, WordNumbers().of(words))) == want
        assert time.perf_counter() - start < 20


def digest(s):
    return sha256(s.encode()).hexdigest()


def test_query_against_the_definition(spark, frame, monkeypatch):
    draw = random.Random(7)
    texts = [" ".join(w.decode() for w in words) for words in sequences(draw, 150)] + ODD[:-1] + ["w w é " * 9]
    monkeypatch.setattr(queries, "table", lambda *a: frame(texts))
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, "").collect()}
    planted = 0
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        h, n = crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        found = plain(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        kept = [w.decode() for j, w in enumerate(words) if not any(s + q <= j < s + m for s, m, q in found)]
        r = got[i]
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (
            len(found), digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(kept)))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert planted > 5


def test_rows(spark, frame):
    df = frame([(1, "a " * 20), (1, "a " * 20), (None, "b " * 12), (2, None), (3, "")])
    rows = sorted((r.id or 0, len(r.runs), r.kept) for r in runs.periodic_runs(df).collect())
    assert rows == [(0, 1, "b"), (1, 1, "a"), (1, 1, "a"), (2, 0, ""), (3, 0, "")]
    assert runs.periodic_runs(df.where("false")).collect() == []
