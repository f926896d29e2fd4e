"""Spans of a text, as (kind, start, end) in code points, end exclusive, and their digests."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then kind as listed, then end, joined by commas."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(spans: list[Span], kinds: list[str]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


class Taken:
    """Ranges of a text that are in use, kept disjoint and in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def claim(self, a: int, b: int) -> bool:
        """Takes a range if it is free."""
        at = bisect_right(self.starts, a)
        if at and self.ends[at - 1] > a or at < len(self.starts) and self.starts[at] < b:
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True
