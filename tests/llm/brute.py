"""Plain repetitions of the operators, one document at a time."""

import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def base_counts(text):
    found = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    times, covered = Counter(windows), set()
    for k, window in enumerate(windows):
        if times[window] > 1:
            covered |= {k, k + 1, k + 2}
    symbols = sum(len(re.findall(r"[#*$%&|<>]", w)) for w in found)
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered)


def fingerprint(text):
    found = words((text or "").translate(UPPER))
    shingles = [" ".join(found[k : k + 3]) for k in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(values, near):
    """Smallest member reachable over ``near`` for each of ``values`` (pairs of id and value)."""
    head = {i: i for i, _ in values}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, a in values:
        for j, b in values:
            if i < j and near(a, b) and find(i) != find(j):
                low, high = sorted((find(i), find(j)))
                head[high] = low
    return {i: find(i) for i, _ in values}


KEYS = ["password", "passwd", "secret", "token", "api_?key"]
BOTH = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in KEYS)
ASSIGN = re.compile(rf"""({BOTH})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


def targets(sizes):
    """Target of each source, filling and resharing step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, got = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return got | share
        for s in over:
            got[s] = 2.0 * sizes[s]
            left -= got[s]
        open_ -= over
    return got


def planted(key, found):
    """The words of a document, from some word on repeated if its key says so."""
    h, n = zlib.crc32(str(key).encode()), len(found)
    if h % 10 or not n:
        return found
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return [w if i < first else found[first + (i - first) % period] for i, w in enumerate(found)]


def word_runs(found, least=12):
    """(start, length, period) of all runs, period by period."""
    held = []
    for q in range(1, len(found) // 2 + 1):
        same = [a == b for a, b in zip(found, found[q:])] + [False]
        first = None
        for i, equal in enumerate(same):
            if equal and first is None:
                first = i
            if not equal and first is not None:
                if i + q - first >= max(least, 2 * q):
                    held.append((first, i + q - first, q))
                first = None
    smaller = lambda r: any(s <= r[0] and s + n >= r[0] + r[1] and q < r[2] for s, n, q in held)
    inner = lambda r: any(all(found[k] == found[k + p] for k in range(r[0], r[0] + r[1] - p)) for p in range(1, r[2]) if r[2] % p == 0)
    return sorted(r for r in held if not inner(r) and not smaller(r))


def divergence(docs, least, terms):
    """Rows of the source audit, every term and pair in full."""
    letters = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    rows = [((d["lang"] or ""), (d["source"] or ""), letters.findall((d["text"] or "").translate(UPPER))) for d in docs]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        times = Counter(t for r in own for t in set(r[2]))
        kept = sorted(t for t, n in times.items() if n >= least)
        counts = {s: Counter(t for r in own if r[1] == s for t in r[2] if times[t] >= least) for s in {r[1] for r in own}}
        whole = sum(counts.values(), Counter())

        def share(count, t):
            return 1 + 10**9 * (count[t] + 5) // (sum(count.values()) + 5 * len(kept))

        for s, count in counts.items():
            pairs = [(-sum(abs(share(count, t) - share(c, t)) for t in kept), o) for o, c in counts.items() if o != s]
            above = [(share(whole, t) - share(count, t), t) for t in kept if count[t] and share(count, t) > share(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(above)[:terms])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)
