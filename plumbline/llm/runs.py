"""Runs: stretches of words that repeat with a period, by a suffix automaton with link-cut access.

A run is a stretch of a text's words with smallest period q and at least ``max(LEAST, 2 q)``
words that neither neighbour continues with period q.

Words are appended to a suffix automaton one by one. Its suffix links form a tree whose nodes
carry the last place at which their strings ended; the path from the new word's node to the
root is exactly the strings that end here. The tree is cut into paths of one colour (the last
end), kept as splay trees as link-cut trees do: access walks the path colour by colour and
paints it with the new end. A colour ``e`` met at a node with strings of up to L words means
that the L words before and with place e come again at place i; where ``L >= d = i - e`` these are
a square of period d, and the stretch of L + d words that ends at i has period d to the left as
far as it goes. It is a run if the next word does not continue it. The period is the smallest: a
smaller one would bring the same string again at a later place than e. Access meets a number of
colours that is logarithmic on average, whatever the words.

Most of a text can't hold a run, and only the rest goes through the automaton. A run with q
in [k, 2k) brings each k-gram behind its first period again within less than 2k words, a run
with q below 6 each 6-gram. So for k = 6, 12, 24... the words around each k-gram that last came
less than 2k words earlier are marked, and each connected stretch of marked words, which
holds a run wholly or not at all, has an automaton of its own. No k-gram that came before
at any distance means that no longer one did. The marks compare 64-bit hashes: a chance
equality marks words in vain and changes nothing else.

A word is dropped if a run holds it after the run's first q words.

Only the id and the text are read, rows are independent, so repeated rows give repeated rows.
Words are runs of bytes other than space and the control characters 9 to 13. A null or empty
text has no words. The text of a task's row, and some 500 bytes for each word of its longest
marked stretch, must fit in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import WordNumbers, mixed, odd_numbers, slices

LEAST = 12
#: The shortest gram that marks words: a run has as many words that equal those one period before.
GRAM = LEAST // 2

#: Changes a text's words before runs are looked for: (id, words) -> words.
Rewrite = Callable[[object, list[bytes]], list[bytes]]


def squares(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, in the order of their ends."""
    n = len(words)
    # suffix automaton: transitions, suffix links, longest strings; node 0 is the root
    goes: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    # splay trees of the coloured paths, from the root of the tree on the left to the deepest node on the right;
    # up holds a splay parent or, at the top of a splay tree, the node above its path; colour counts at the top only
    left, right, up, colour = [-1], [-1], [-1], [-1]
    found = []

    def rotate_to_top(x: int) -> int:
        """Splay x; the colour of its path."""
        y = up[x]
        while y >= 0 and (left[y] == x or right[y] == x):
            z = up[y]
            if z >= 0 and ((low := left[z] == y) or right[z] == y):
                if low == (left[y] == x):
                    # the parent first
                    if low:
                        c = left[z] = right[y]
                        right[y] = z
                    else:
                        c = right[z] = left[y]
                        left[y] = z
                    if c >= 0:
                        up[c] = z
                    w = up[z]
                    up[z] = y
                    if left[y] == x:
                        c = left[y] = right[x]
                        right[x] = y
                    else:
                        c = right[y] = left[x]
                        left[x] = y
                    if c >= 0:
                        up[c] = y
                else:
                    if low:
                        c, b = left[x], right[x]
                        right[y], left[z] = c, b
                        left[x], right[x] = y, z
                        if c >= 0:
                            up[c] = y
                        if b >= 0:
                            up[b] = z
                    else:
                        c, b = left[x], right[x]
                        right[z], left[y] = c, b
                        left[x], right[x] = z, y
                        if c >= 0:
                            up[c] = z
                        if b >= 0:
                            up[b] = y
                    w = up[z]
                    up[z] = x
                up[y] = x
                up[x] = w
                if w >= 0:
                    if left[w] == z:
                        left[w] = x
                    elif right[w] == z:
                        right[w] = x
                colour[x] = colour[z]
            else:
                if left[y] == x:
                    c = left[y] = right[x]
                    right[x] = y
                else:
                    c = right[y] = left[x]
                    left[x] = y
                if c >= 0:
                    up[c] = y
                up[y] = x
                up[x] = z
                colour[x] = colour[y]
            y = up[x]
        return colour[x]

    last = 0
    for i, word in enumerate(words):
        new = len(goes)
        goes.append({})
        longest.append(i + 1)
        link.append(0)
        left.append(-1)
        right.append(-1)
        colour.append(i)
        up.append(0)
        p = last
        while p >= 0 and word not in goes[p]:
            goes[p][word] = new
            p = link[p]
        if p >= 0:
            q = goes[p][word]
            if longest[q] != longest[p] + 1:
                # the shorter strings of q get a node of their own between q and the node above, on the same path as q
                clone = len(goes)
                goes.append(goes[q].copy())
                longest.append(longest[p] + 1)
                link.append(link[q])
                c = rotate_to_top(q)
                above = left[q]
                left.append(above)
                right.append(-1)
                up.append(q)
                colour.append(c)
                left[q] = clone
                if above >= 0:
                    up[above] = clone
                link[q] = clone
                while p >= 0 and goes[p].get(word) == q:
                    goes[p][word] = clone
                    p = link[p]
                q = clone
            link[new] = up[new] = q
        last = new
        # access: the colours on the path to the root, which becomes one path that ends here
        after = words[i + 1] if i + 1 < n else None
        x, below = up[new], new
        while x >= 0:
            e = rotate_to_top(x)
            if e >= 0:
                size, d = longest[x], i - e
                if size >= d and size + d >= LEAST and (after is None or words[i + 1 - d] != after):
                    found.append((i + 1 - size - d, size + d, d))
            deeper = right[x]
            if deeper >= 0:
                colour[deeper] = e
            right[x] = below
            below = x
            x = up[x]
        colour[below] = i
    return found


def marked(numbers: np.ndarray) -> list[tuple[int, int]]:
    """The stretches (start, end) of a text's words that may hold runs."""
    n, k, seed = len(numbers), GRAM, 1
    edges = None
    grams, size = None, 0
    while n >= max(LEAST, 2 * k):
        if grams is None:
            grams, size = _grams(numbers, k), k
        else:
            times = odd_numbers(1, seed)[0]
            grams, size = mixed(grams[:-size] * times + grams[size:]), k
        seed += 1
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        same = np.flatnonzero(ordered[1:] == ordered[:-1])
        if not len(same):
            break
        again = order[same + 1]
        near = again[again - order[same] < 2 * k]
        if len(near):
            if edges is None:
                edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, np.maximum(near - 2 * k + 1, 0), 1)
            np.add.at(edges, near + k, -1)
        k *= 2
    if edges is None:
        return []
    inside = np.cumsum(edges) > 0
    turns = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    return [(int(s), int(e)) for s, e in zip(turns[::2], turns[1::2])]


def _grams(numbers: np.ndarray, k: int) -> np.ndarray:
    total = numbers[:len(numbers) - k + 1].copy()
    for i, times in enumerate(odd_numbers(k - 1, 77), 1):
        total = total * times + numbers[i:len(numbers) - k + 1 + i]
    return mixed(total)


def runs_of(words: list[bytes], numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs, by start, then period; ``numbers`` are hashes of the words."""
    found = []
    for start, end in marked(numbers):
        names: dict[bytes, int] = {}
        found += [(start + s, length, q) for s, length, q in squares([names.setdefault(w, len(names)) for w in words[start:end]])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    starts, lengths, periods = (np.array(c) for c in zip(*found))
    np.add.at(edges, starts + periods, 1)
    np.add.at(edges, starts + lengths, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """(id, runs, kept): every run as (start, length, period) by start, then period, and the text without repeats."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("raw"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordNumbers()
        for batch in slices(batches, "raw"):
            found, kept = [], []
            for key, raw in zip(batch.column("id").to_pylist(), batch.column("raw").to_pylist()):
                words = raw.split()
                if rewrite is not None:
                    words = rewrite(key, words)
                runs = runs_of(words, known.of(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept.append(b" ".join(without_repeats(words, runs)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, run_type), pa.array(kept, pa.binary()).cast(pa.string())],
                                             ["id", "runs", "kept"])

    return source.mapInArrow(find, f"id {dict(source.dtypes)['id']}, runs array<struct<start bigint, length bigint, period bigint>>, kept string")
