"""The trie of conversations against a plain dictionary of prefixes."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from plumbline.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, path string, depth int, records int"


def plain(conversations):
    """(conv, depth) -> the other columns, from {id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += not kids[node]
    return {(min(m), len(n)): (min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n],
                               sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()}


def rows_of(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(draw, count, turns=3, longest=9):
    """Few different turns, so that conversations share beginnings, and a turn that most begin with."""
    out = {}
    for _ in range(count):
        c = draw.randint(-50, 3000)
        out[c] = [("system", "be kind")] * (draw.random() < 0.7) + [
            (draw.choice(["user", "assistant", ""]), draw.choice(["", "yes", "où", "no"][:turns])) for _ in range(draw.randint(0, longest))]
    return {c: t for c, t in out.items() if t}


def frame(spark, conversations, draw):
    rows = [(c, t if t else None, r or None, x or None, "x", "y", 1, 2) for c, turns in conversations.items() for t, (r, x) in enumerate(turns)]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("piece_turns", [1, 12, 40, 1 << 19])
def test_trie_against_prefixes(spark, piece_turns):
    draw = random.Random(piece_turns)
    made = conversations(draw, 250)
    for extra in range(3):   # long ones that part late, and copies
        made[4000 + extra] = [("user", str(i)) for i in range(60)] + [("user", str(extra // 2))]
    seen = prefix_trie.sequences(frame(spark, made, draw))
    assert rows_of(prefix_trie.nodes(seen, piece_turns=piece_turns)) == plain(made)


def test_many_copies_and_one_first_turn(spark):
    made = {c: [("user", "hello"), ("assistant", "hi")] + ([("user", str(c))] if c % 3 == 0 else []) for c in range(1800)}
    got = rows_of(prefix_trie.nodes(prefix_trie.sequences(frame(spark, made, random.Random(2))), piece_turns=64))
    assert got == plain(made)
    assert got[0, 1][1] == 1800


def test_turns_in_order_and_odd_rows(spark):
    turns = [(1, 5, "user", "late"), (1, None, "user", "first"), (1, 2, None, None), (None, 0, "user", "nobody"),
             (2, 0, "user", "same"), (2, 0, "user", "same")]
    df = spark.createDataFrame([(*t, "x", "y", 1, 2) for t in turns], SCHEMA)
    want = {1: [("user", "first"), ("", ""), ("user", "late")], 2: [("user", "same"), ("user", "same")]}
    assert rows_of(prefix_trie.prefix_trie(df)) == plain(want)
    assert prefix_trie.prefix_trie(df.where("false")).collect() == []
    assert prefix_trie.prefix_trie(df.where("conv_id IS NULL")).collect() == []
    # a conversation of no turns is a member of the root
    none = spark.createDataFrame([(7, []), (3, [])], "conv bigint, records array<string>")
    assert rows_of(prefix_trie.nodes(none)) == plain({7: [], 3: []})


def test_role_and_text_are_told_apart(spark):
    made = {1: [("ab", "c")], 2: [("a", "bc")], 3: [("", "abc")], 4: [("", "1:abc")]}
    assert rows_of(prefix_trie.prefix_trie(frame(spark, made, random.Random(1)))) == plain(made)


def test_very_long_turn_and_conversation(spark):
    made = {1: [("user", "é" * 300_000)], 2: [("user", "é" * 300_000), ("user", "x")],
            3: [("user", "again")] * 150, 4: [("user", "again")] * 149 + [("user", "other")]}
    assert rows_of(prefix_trie.prefix_trie(frame(spark, made, random.Random(1)))) == plain(made)


def test_rebuilt(spark):
    draw = random.Random(9)
    made = {c: t for c, t in conversations(draw, 400).items() if c >= 0}
    want = {}
    for c, turns in made.items():
        h = crc32(str(c).encode()) % 9
        want[c] = made.get(c - c % 5, [])[:h] + turns[h:]
    got = prefix_trie.nodes(queries.rebuilt(prefix_trie.sequences(frame(spark, made, draw))))
    assert rows_of(got) == plain(want)
