"""Plain loops for what SQL cannot say."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(rows, percent=90, k=3):
    """(doc_id, set size, smallest doc_id reachable) of (doc_id, text) rows, as a bag."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(x), least.get(find(i)) if x else d) for i, ((d, _), x) in enumerate(zip(rows, sets, strict=True)))


def removals(rows, width=50):
    """(doc_id, bytes, removed, spans, digest of the rest) of (doc_id, text) rows, as a bag."""
    order = lambda d: 2**63 - 1 if d is None else d
    first = {}
    for d, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - width + 1):
            s = data[i : i + width]
            first[s] = min(order(d), first.get(s, order(d)))
    out = Counter()
    for d, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if first[data[i : i + width]] < order(d):
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def fingerprint(text, k, value_of, pair, single, functions=64):
    """Order MinHash of one text, from a hash of numbered k-mers (unsigned): 64 times over all of them."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    words = [w[i : i + 32] for w in words for i in range(0, len(w), 32)]
    grams = [tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
    seen, entries = Counter(), []
    for place, gram in enumerate(grams):
        entries.append((value_of(gram, seen[gram]), place))
        seen[gram] += 1
    out = {}
    for s in range(functions if entries else 0):
        least = sorted(entries, key=lambda e: (e[0] - s * (2**64 // functions)) % 2**64)[:2]
        chosen = [v for v, _ in sorted(least, key=lambda e: e[1])]
        out[s] = single(*chosen) if len(chosen) == 1 else pair(*chosen)
    return out
