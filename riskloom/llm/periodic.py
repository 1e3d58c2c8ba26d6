"""Runs: stretches of words that repeat with a period, found whatever the period.

Words are appended one by one to a suffix automaton. Its suffix links form a
tree that a link-cut tree holds: each preferred path is the part of a root path
whose strings ended last at one place, its colour. To append word i is to
access the state of the whole text so far; on the way up, the access cuts
through the paths that it takes over. A path of colour e that is cut at a state
of length L says that the last L words stood as they are at e before, and no
longer ones. If the distance i - e is no more than L, both overlap or touch:
the text from e - L + 1 to i repeats with that period at least twice, starts
there, and no smaller period would do, for then e were not the last place. The
last i that tells of a start and period is where that run ends.

A run of the wanted length lies in one stretch of words that are covered by
word 6-grams which occur again in that stretch, so the automaton is built for
such stretches alone. They are cut down, batch by batch, until nothing falls
away; a false match of two hashes only makes a stretch longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.common import as_bytes, sliced
from riskloom.llm.lm import mixed

LEAST = 12
#: Words of a run of the least length that stand again a period further on, whatever the period.
GRAM = LEAST // 2


def runs(words: list[int], least: int = LEAST) -> dict[tuple[int, int], int]:
    """{(start, period): end} of all runs of ``least`` words and two periods or more.

    States shorter than half of ``least`` cannot tell of one; they are left
    out of the link-cut tree, whose roots are the states above them.
    """
    shallow = (least + 1) // 2
    # The automaton: state 0 is the empty text.
    length, link, follow = [0], [0], [{}]
    # The link-cut tree, by state; 0 is none. The colour of a path stands at the root of its splay tree.
    up, left, right, colour = [0], [0], [0], [0]
    found: dict[tuple[int, int], int] = {}

    def splay(x: int) -> None:
        """Make ``x`` the root of its path's tree; ``up`` of the root stays the state above the path."""
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        while True:
            p = up[x]
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                rotate(p, g)
                rotate(x, p)
            else:
                rotate(x, p)
                if inner:
                    rotate(x, g)
            if not inner:
                break
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                break

    def rotate(x: int, p: int) -> None:
        """Put ``x`` above its parent ``p``."""
        g = up[p]
        if left[p] == x:
            moved = left[p] = right[x]
            right[x] = p
        else:
            moved = right[p] = left[x]
            left[x] = p
        if moved:
            up[moved] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
            else:
                colour[x] = colour[p]
        else:
            colour[x] = colour[p]
        up[p], up[x] = x, g

    state = 0
    for i, word in enumerate(words):
        # Append the word to the automaton.
        new = len(length)
        length.append(length[state] + 1)
        follow.append({})
        for column in (link, up, left, right, colour):
            column.append(0)
        p = state
        while word not in follow[p]:
            follow[p][word] = new
            if not p:
                p = -1
                break
            p = link[p]
        if p >= 0:
            q = follow[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                follow.append(follow[q].copy())
                above = link[q]
                for column in (up, left, right, colour):
                    column.append(0)
                link.append(above)
                while follow[p].get(word) == q:
                    follow[p][word] = clone
                    if not p:
                        break
                    p = link[p]
                link[q] = link[new] = clone
                if length[clone] >= shallow:
                    # The clone ended where q did: it stands on the same path, right above q.
                    splay(q)
                    inside = left[q]
                    left[clone] = inside
                    if inside:
                        up[inside] = clone
                    left[q], up[clone] = clone, q
        # Access the new state: each path on the way up is cut below the state where it is met.
        above = link[new]
        up[new] = above if length[above] >= shallow else 0
        state = taken = new
        x, end = up[new], i + 1
        while x:
            splay(x)
            last = colour[x]
            if last != end:
                end = last
                size, period = length[x], i + 1 - last
                if period <= size and size + period >= least:
                    found[last - size, period] = i + 1
            below = right[x]
            if below:
                colour[below] = last
            right[x] = taken
            taken, x = x, up[x]
        colour[taken] = i + 1
    return found


def stretches(ids: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) places of the stretches of words that may hold runs, over texts laid end to end.

    A run of period q holds, at each of its words, a gram that stands again q
    words away, and q is no more than half of the stretch.
    """
    gram = least // 2
    place = np.arange(len(ids))
    zone = np.repeat(np.arange(len(lengths)), lengths)
    hashes = ids.astype(np.uint64)
    for k in range(1, gram):
        hashes = mixed(hashes, np.append(ids[k:], ids[:k]).astype(np.uint64))
    while True:
        # Stretches are contiguous, so a gram lies in one if its last word does.
        whole = np.flatnonzero(zone[gram - 1 :] == zone[: len(zone) - gram + 1]) if len(zone) >= gram else np.zeros(0, np.int64)
        keys = mixed(hashes[place[whole]], zone[whole].astype(np.uint64))
        order = np.argsort(keys, kind="stable")
        where = place[whole[order]]
        step = np.where(keys[order[1:]] == keys[order[:-1]], np.diff(where), len(ids))
        nearest = np.full(len(whole), len(ids))
        nearest[:-1] = step
        nearest[1:] = np.minimum(nearest[1:], step)
        sizes = np.bincount(zone, minlength=1)
        again = whole[order[2 * nearest <= sizes[zone[whole[order]]]]]
        cover = np.zeros(len(zone) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + gram, -1)
        kept = np.cumsum(cover)[:-1] > 0
        place, zone = place[kept], zone[kept]
        begins = np.ones(len(place), bool)
        begins[1:] = (np.diff(place) != 1) | (np.diff(zone) != 0)
        zone = np.cumsum(begins) - 1
        long = (np.bincount(zone, minlength=1) >= least)[zone] if len(zone) else np.zeros(0, bool)
        if kept.all() and long.all():
            first = place[begins]
            return first, first + np.bincount(zone, minlength=len(first))[: len(first)]
        place, zone = place[long], zone[long]


def find_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, in ascending order."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    coded = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ends = np.cumsum(lengths)
    for first, end in zip(*(a.tolist() for a in stretches(ids, lengths, least)), strict=True):
        owner = int(np.searchsorted(ends, first, side="right"))
        offset = first - int(ends[owner] - lengths[owner])
        found[owner] += [(offset + a, b - a, q) for (a, q), b in runs(ids[first:end].tolist(), least).items()]
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in found]


def collapsed(words: list[bytes], own: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if own:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in own:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, out in zip(words, np.cumsum(gone), strict=False) if not out]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row, ``runs`` as array<(start, length, period)>.

    A run is a stretch of ``least`` words or more, and of two periods or more,
    whose words repeat with that smallest period and that no neighbouring word
    extends. ``start`` counts words from 0; runs stand by start, then period;
    ``collapsed`` drops the words that a run holds after its first period. A
    null or empty text has no words and no runs. Every row gives one row,
    repeated or not, whatever its key; other columns are not read. No shuffle.
    """
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            texts = [value.split() for value in as_bytes(batch, text)]
            found = find_runs(texts, least)
            columns = [
                batch.column(key),
                pa.array(list(map(len, texts)), pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in found], pa.list_(item)),
                pa.array(list(map(collapsed, texts, found)), pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_words", "runs", "collapsed"])

    shape = "array<struct<start: long, length: long, period: long>>"
    return rows.mapInArrow(find, f"`{key}` {kind}, n_words long, runs {shape}, collapsed string")
