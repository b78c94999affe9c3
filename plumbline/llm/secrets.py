"""Secrets in documents, by one automaton for all rules.

The rules' regular expressions become one automaton by subset construction, which Moore's
refinement makes minimal, and that becomes an array: next state by state and kind of byte. One
pass over the bytes tells for each place which rules have a match that ends there. Many
stretches of text advance at a time, cut at bytes that lead back to the first state from
everywhere, so that nothing is lost at a cut. From the end of a match the automaton of its
reversed rule runs back to its longest, that is leftmost, start.

Matches are leftmost and do not overlap within a rule, as a search from left to right finds
them; a match that is too short is dropped after it has taken its place. Places are code
points, ends exclusive. A null or empty text has no matches; each row has its own result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from re import _constants as sre, _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import slices

#: kind -> (rule, group whose length counts, least length). The order is that of equal starts. Fixed values.
RULES = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    "google": (r"AIza[A-Za-z0-9_-]+", 0, 39),
    "live": (r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    "private": (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----", 0, 0),
}
BASE = ("assign", "access", "hex")
STRETCH, PIECE = 2048, 4 << 20


class Nfa:
    """States with byte transitions and empty moves, built from a parsed expression."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def build(self, tree, start: int, any_case: bool, backwards: bool) -> int:
        """Add an expression after ``start``; the state it ends in."""
        for op, arg in (reversed(list(tree)) if backwards else tree):
            if op in (sre.LITERAL, sre.IN):
                codes = {arg} if op is sre.LITERAL else {c for kind, x in arg for c in (range(x[0], x[1] + 1) if kind is sre.RANGE else (x,))}
                if any_case:
                    codes |= {ord(f(chr(c))) for c in codes for f in (str.lower, str.upper)}
                end = self.state()
                self.moves[start].append((frozenset(codes), end))
                start = end
            elif op is sre.SUBPATTERN:
                _, add, _, inner = arg
                start = self.build(inner, start, any_case or bool(add & re.IGNORECASE), backwards)
            elif op is sre.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.free[self.build(branch, start, any_case, backwards)].append(end)
                start = end
            elif op is sre.MAX_REPEAT:
                least, most, inner = arg
                for _ in range(least):
                    start = self.build(inner, start, any_case, backwards)
                if most is sre.MAXREPEAT:
                    loop = self.state()
                    self.free[start].append(loop)
                    self.free[self.build(inner, loop, any_case, backwards)].append(loop)
                    start = loop
                else:
                    end = self.state()
                    self.free[start].append(end)
                    for _ in range(most - least):
                        start = self.build(inner, start, any_case, backwards)
                        self.free[start].append(end)
                    start = end
            else:
                raise ValueError(f"not supported in a rule: {op}")
        return start

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)


def automaton(rules: Sequence[str], backwards: bool = False, anywhere: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind of each byte, next state by state and kind, bits of the rules that match in each state); state 0 is the first.

    With ``anywhere`` a match may start at every byte; else state 0 is left for good and a dead state accepts nothing.
    """
    nfa = Nfa()
    first = nfa.state()
    ends = {}
    for i, rule in enumerate(rules):
        start = nfa.state()
        nfa.free[first].append(start)
        ends[nfa.build(parser.parse(rule), start, False, backwards)] = 1 << i
    # bytes that no rule tells apart are of one kind
    sets = {codes for moves in nfa.moves for codes, _ in moves}
    tests = {b: tuple(b in s for s in sets) for b in range(256)}
    kinds = {key: k for k, key in enumerate(dict.fromkeys(tests.values()))}
    kind = np.array([kinds[tests[b]] for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(kind == k)[0]) for k in range(len(kinds))]
    start = nfa.closed({first})
    found, rows, at = {start: 0}, [], 0
    order = [start]
    while at < len(order):
        row = []
        for b in sample:
            to = nfa.closed({t for s in order[at] for codes, t in nfa.moves[s] if b in codes} | ({first} if anywhere else set()))
            if to not in found:
                found[to] = len(order)
                order.append(to)
            row.append(found[to])
        rows.append(row)
        at += 1
    table = np.array(rows)
    accept = np.array([sum({ends[s] for s in states if s in ends}) for states in order])
    # Moore: states stay together as long as they accept alike and lead to states that are together
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        _, new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == block.max():
            break
        block = new
    # number the blocks in order of first appearance, so that the first state stays 0
    _, where = np.unique(block, return_index=True)
    name = np.empty(len(where), np.int64)
    name[np.argsort(where)] = np.arange(len(where))
    keep = np.sort(where)
    return kind, name[block[table[keep]]], accept[keep]


def compiled(rules: dict = RULES):
    """Arrays of the automaton of all rules and, for each rule, of its reversal."""
    kind, table, accept = automaton([r[0] for r in rules.values()])
    kinds = table.shape[1]
    reset = np.array([bool((table[:, k] == 0).all()) for k in range(kinds)])
    backward = []
    for rule, _, _ in rules.values():
        k, t, a = automaton([rule], backwards=True, anywhere=False)
        dead = [s for s in range(len(t)) if not a[s] and (t[s] == s).all()]
        backward.append((k.tobytes(), t.tolist(), a.astype(bool).tolist(), set(dead)))
    return kind, (table * kinds).astype(np.int32), accept, reset, kinds, backward


def ends_of(raw: np.ndarray, machine) -> tuple[np.ndarray, np.ndarray]:
    """Places after which rules match, and the bits of these rules; ``raw`` ends with a byte that leads back to the first state."""
    kind, table, accept, reset, kinds, _ = machine
    code = kind[raw]
    cuts = np.flatnonzero(reset[code]) + 1
    cuts = np.unique(np.append(cuts[np.minimum(np.searchsorted(cuts, np.arange(STRETCH, len(raw), STRETCH)), len(cuts) - 1)], len(raw)))
    begin = np.append(0, cuts[:-1])
    length = cuts - begin
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    flat, hit = table.ravel(), accept != 0
    state = np.zeros(len(begin), np.int32)
    places, states = [], []
    active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
    for step, n in enumerate(active):
        now = flat[state[:n] + code[begin[:n] + step]]
        state[:n] = now
        found = np.flatnonzero(hit[now // kinds])
        if len(found):
            places.append(begin[found] + step + 1)
            states.append(now[found] // kinds)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, state = np.concatenate(places), np.concatenate(states)
    order = np.argsort(place)
    return place[order], accept[state[order]]


def _leftmost(raw: bytes, end: int, limit: int, back) -> int:
    """The leftmost start, not before ``limit``, of a match that ends here; -1 if there is none."""
    kind, table, accept, dead = back
    state, best = 0, -1
    for at in range(end - 1, limit - 1, -1):
        state = table[state][kind[raw[at]]]
        if accept[state]:
            best = at
        elif state in dead:
            break
    return best


def find(texts: list[bytes], machine, rules: dict = RULES) -> list[list[tuple[str, int, int]]]:
    """Per text the matches (kind, start, end) in bytes, by start and then by the order of the rules."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    raw = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    if not len(raw):
        return out
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    place, bits = ends_of(raw, machine)
    for i, (name, (rule, group, least)) in enumerate(rules.items()):
        own = place[(bits >> i) & 1 == 1]
        own = own[np.append(own[1:] != own[:-1] + 1, True)] if len(own) else own
        exact = re.compile(rule.encode(), re.ASCII)
        last = {}
        for t, end in zip((np.searchsorted(starts, own, "left") - 1).tolist(), own.tolist()):
            end -= int(starts[t])
            start = _leftmost(texts[t], end, last.get(t, 0), machine[5][i])
            if start < 0:
                continue
            last[t] = end
            match = exact.fullmatch(texts[t], start, end)
            if match and len(match[group]) >= least:
                out[t].append((name, start, end))
    rank = {name: i for i, name in enumerate(rules)}
    return [sorted(x, key=lambda m: (m[1], rank[m[0]])) for x in out]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict = RULES) -> DataFrame:
    """(id, spans): every row with its matches (kind, start, end), in code points."""
    machine = compiled(rules)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("raw"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for piece in slices(batches, "raw", PIECE):
            texts = [x or b"" for x in piece.column("raw").to_pylist()]
            spans = []
            for text, found in zip(texts, find(texts, machine, rules)):
                if found:  # bytes to code points
                    at = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
                    found = [{"kind": k, "start": int(at[s]), "end": int(at[e])} for k, s, e in found]
                spans.append(found)
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(spans, kind)], ["id", "spans"])

    id_type = dict(docs.dtypes)[id_col]
    return source.mapInArrow(scan, f"id {id_type}, spans array<struct<kind: string, start: bigint, end: bigint>>")
