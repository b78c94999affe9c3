"""Exact, near, word window and byte string duplicates against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact, near, packed, substrings, suffixes
from plumbline.llm.words import run_hashes

from .conftest import ODD


def sha(x):
    return hashlib.sha256(x).hexdigest()


def ordered(pairs):
    """Texts in the order that decides which is first, ids and texts of repeated rows once."""
    key = {(i, (t or "").encode()) for i, t in pairs}
    return sorted(key, key=lambda p: (-(1 << 63) if p[0] is None else p[0], substrings._text_hash(p[1])))


# ---- exact -----------------------------------------------------------------

@pytest.mark.parametrize("block", [3, 1 << 14])
def test_exact_groups(frame, block):
    pairs = [(i, t) for i, t in enumerate(["abcdefg", "abcdefg", "abcabc", "abcdef", "abc", "abcabcabc", *ODD[:7], *ODD[:3], "abcabc" * 9, "abcabc" * 9])]
    pairs += [(None, "abc"), (3, "abcdef"), (3, "other")]
    got = exact.exact_groups(frame(pairs), block_bytes=block).collect()
    size, most = Counter(t or "" for _, t in pairs), {}
    for i, t in pairs:
        if i is not None:
            most[t or ""] = max(most.get(t or "", i), i)
    want = {(i, sha((t or "").encode()), n, size[t or ""], most.get(t or "")) for (i, t), n in Counter((i, t or "") for i, t in pairs).items()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_exact_when_hashes_collide(frame, monkeypatch):
    real = exact._blocks
    monkeypatch.setattr(exact, "_blocks", lambda *a: real(*a).withColumn("h1", F.lit(1)).withColumn("h2", F.lit(2)))
    got = {r.id: (r.group_size, r.keep_id) for r in exact.exact_groups(frame(["ab", "ab", "ba", "abab", ""]), block_bytes=2).collect()}
    assert got == {0: (2, 1), 1: (2, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4)}


def test_exact_rows_that_stay(frame):
    docs = frame([(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "b")])
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "b"), (2, "a"), (4, "")]


# ---- near ------------------------------------------------------------------

def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)] if words else [])


def near_components(pairs):
    sets = [shingle_set(t) for _, t in pairs]
    part = list(range(len(pairs)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    for a in range(len(pairs)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 80 * len(sets[a] | sets[b]):
                part[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for x, (i, _) in enumerate(pairs):
        known = least[find(x)]
        least[find(x)] = i if known is None else known if i is None else min(known, i)
    return Counter((i, len(sets[x]), least[find(x)] if sets[x] else i) for x, (i, _) in enumerate(pairs))


def near_copies(base_words, count, seed):
    """Copies of one text with so many words changed that some are linked only through others, and some not at all."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10_000)}" for _ in range(base_words)]
    out = [" ".join(base)]
    for _ in range(count):
        words = list(base)
        for at in draw.sample(range(base_words), draw.randint(1, base_words // 7)):
            words[at] = f"v{draw.randrange(10_000)}"
        out.append(" ".join(words))
    return out


def test_near_groups(frame, passages):
    texts = [*passages, *ODD[:7], "ONE TWO", "long " + "word " * 3000, *near_copies(80, 150, 3), *near_copies(40, 60, 4)]
    pairs = [*enumerate(texts), (None, "one two"), (5, passages[7])]
    got = near.near_groups(frame(pairs)).collect()
    assert Counter((r.id, r.n, r.component) for r in got) == near_components(pairs)


def test_near_blocks_of_one_bucket(frame, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 400)
    pairs = list(enumerate(near_copies(60, 250, 9)))
    got = near.near_groups(frame(pairs)).collect()
    want = near_components(pairs)
    assert len({w[2] for w in want}) > 2
    assert Counter((r.id, r.n, r.component) for r in got) == want


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, draw.randrange(1001, 1400)) for _ in range(300)] + [(2000, 2000), (3001, 3000), (3000, 3001)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == ({i: 0 for i in range(1, 401)} | {v: 1000 for u, v in edges if u == 1000} | {3001: 3000})


def test_near_rows_that_stay(frame):
    docs = frame([(4, "a b c d e f"), (2, "A b c d e f"), (9, None), (9, None), (8, "x"), (8, "y")])
    kept = near.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(2, "A b c d e f"), (8, "x"), (8, "y"), (9, "")]


# ---- word windows ----------------------------------------------------------

def test_cover_has_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_run_hashes_depend_on_their_run_only():
    x = np.random.default_rng(1).integers(0, 9, 500).astype(np.uint64)
    for length in (1, 2, 8, 20, 21):
        runs = [x[i:i + length].tobytes() for i in range(len(x) - length + 1)]
        hashes = run_hashes(x, length, 3)
        assert len(hashes) == len(runs) and len(set(zip(runs, hashes.tolist()))) == len(set(runs)) == len(set(hashes.tolist()))


def windows_removed(pairs):
    seen, out = set(), {}
    for i, raw in ordered(pairs):
        words = raw.split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s:s + 20])
            if key in seen:
                gone[s:s + 20] = [True] * 20
            seen.add(key)
        out[i, raw] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return Counter((i, *out[i, (t or "").encode()]) for i, t in pairs)


def test_word_windows(frame, passages, monkeypatch):
    monkeypatch.setattr(packed, "PIECE_BYTES", 2000)
    pairs = [*enumerate([*passages, *ODD]), (None, passages[3]), (4, passages[4]), (4, passages[9])]
    got = substrings.remove_repeats(frame(pairs)).collect()
    assert Counter((r.id, r.n_words, r.n_removed, r.kept) for r in got) == windows_removed(pairs)


# ---- byte strings ----------------------------------------------------------

def bytes_removed(pairs):
    seen, out = set(), {}
    for i, raw in ordered(pairs):
        steps = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - 99):
            key = raw[s:s + 100]
            if key in seen:
                steps[s] += 1
                steps[s + 100] -= 1
            seen.add(key)
        gone = np.cumsum(steps)[:len(raw)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i, raw] = (len(raw), int(gone.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return Counter((i, *out[i, (t or "").encode()]) for i, t in pairs)


@pytest.mark.parametrize("often", [3, suffixes.OFTEN])
def test_byte_strings(frame, passages, often, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 3000)
    pairs = [*enumerate([*passages, *ODD[:-2], "a" * 5000, "word " * 900, "é" * 150, "é" * 150]), (None, passages[3]), (4, passages[4]), (4, passages[9])]
    got = suffixes.remove_repeats(frame(pairs), often=often).collect()
    assert Counter((r.id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == bytes_removed(pairs)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_deep_shallow_order():
    draw = np.random.default_rng(4)
    rows = draw.integers(0, 2, (500, 40)).astype(np.uint8)
    rows[:, :30] = rows[0, :30] * (draw.integers(0, 2, 500)[:, None])
    group = draw.integers(0, 3, 500)
    order, common = suffixes.deep_shallow(group, rows)
    keys = [(group[i], rows[i].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(500))
    for k in range(1, 500):
        a, b = rows[order[k - 1]], rows[order[k]]
        same = next((j for j in range(40) if a[j] != b[j]), 40)
        assert common[k] == (same if keys[k][0] == keys[k - 1][0] else -1)


@pytest.mark.parametrize("letters", [1, 2, 256])
def test_multikey_quicksort(letters):
    draw = np.random.default_rng(letters)
    words = np.concatenate([draw.integers(0, letters, (400, 3)), np.sort(draw.integers(0, 9, (300, 3)), axis=0)]).astype(np.uint64)
    group = draw.integers(0, 2, 700)
    order, start = suffixes._multikey_quicksort(group, words)
    keys = [(group[i], *words[i]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(700))
    assert start.tolist() == [keys.index(k) for k in keys]
    assert all(len(x) == 0 for x in suffixes._multikey_quicksort(group[:0], words[:0]))


def test_contexts_by_sort():
    draw = np.random.default_rng(3)
    rows = draw.integers(0, 256, (40, suffixes.AROUND)).astype(np.uint8)[draw.integers(0, 40, 600)]
    rows[300:, suffixes.SIDE:] = rows[0, suffixes.SIDE:]  # one anchor with many bytes before it
    low, high = draw.integers(0, 2, 600), draw.integers(2, 4, 600)
    first, anchor = suffixes._by_context(rows, low, high)
    keys = [(rows[i].tobytes(), low[i], high[i]) for i in range(600)]
    assert first.tolist() == [k not in keys[:i] for i, k in enumerate(keys)]
    grams = [rows[i, suffixes.SIDE:suffixes.SIDE + suffixes.GRAM].tobytes() for i in range(600)]
    assert len(set(zip(anchor.tolist(), grams))) == len(set(grams)) == len(set(anchor.tolist()))


def test_empty_tables(frame, spark):
    none = frame(["a"]).where("doc_id < 0")
    for made in (exact.exact_groups(none), exact.drop_copies(none), near.near_groups(none), near.drop_near_copies(none),
                 substrings.remove_repeats(none), suffixes.remove_repeats(none)):
        assert made.count() == 0


def test_signature_check_misses_less_than_the_bands():
    same = near.SIMILAR / 100 + (1 - near.SIMILAR / 100) / 256  # a byte of a minimum may be equal by chance
    missed = sum(comb(near.HASHES, k) * same**k * (1 - same) ** (near.HASHES - k) for k in range(near.SKETCH_MATCHES))
    bands = (1 - (near.SIMILAR / 100) ** near.ROWS) ** near.BANDS
    assert missed < bands and missed + bands < 6.5e-8
