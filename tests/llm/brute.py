"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter

LIMIT = 400


def shingles(text: str | None) -> frozenset:
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(texts: list[str | None]) -> list[int]:
    """Index of the component of every text (position of its first member); -1 without words."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return [top(i) if sets[i] else -1 for i in range(len(texts))]


def link_counts(texts: list[str | None]) -> list[int]:
    """Number of other rows whose texts link to a row's."""
    sets = [shingles(t) for t in texts]
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= 75 * len(a | b)
    return [sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]


def repeats_removed(texts: list[str | None]) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed, spans, kept) of every text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + LIMIT] for r in raws for i in range(len(r) - LIMIT + 1))
    out = []
    for r in raws:
        covered = bytearray(len(r))
        for i in range(len(r) - LIMIT + 1):
            if seen[r[i : i + LIMIT]] > 1:
                covered[i : i + LIMIT] = b"\1" * LIMIT
        runs = len(re.findall(rb"\x01+", bytes(covered)))
        out.append((len(r), sum(covered), runs, bytes(b for b, c in zip(r, covered, strict=True) if not c)))
    return out


def contained(text: str | None, item: str | None) -> float:
    wanted = shingles(item)
    return len(wanted & shingles(text)) / len(wanted) if wanted else 0.0


def smallest_capacity(sizes: list[int], shards: int) -> int:
    def fits(capacity: int) -> bool:
        used, load = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if load + s > capacity:
                used, load = used + 1, 0
            load += s
        return used <= shards

    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low
