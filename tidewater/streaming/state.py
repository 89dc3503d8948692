"""State of temporal features for one key, event by event. Plain Python: streams keep it, tests use it as an interpreter.

Events of a key are taken in order of time. Buckets and values that no later window can reach are dropped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..functions.histogram import insert, merged
from ..functions.windows import Span


@dataclass
class FeatureState:
    op: str
    w: Span
    bins: int = 0
    buckets: dict = field(default_factory=dict)
    last_seen: dict = field(default_factory=dict)
    amounts: list = field(default_factory=list)
    two: list = field(default_factory=list)

    def update(self, ms: int, value) -> None:
        """Takes what an event contributes; None contributes nothing."""
        if value is None:
            return
        if self.op in ("COUNT_DISTINCT", "SET"):
            self.last_seen[str(value)] = max(ms, self.last_seen.get(str(value), ms))
            return
        if self.op != "COUNT":
            try:
                value = float(value)
            except ValueError:
                return
        if self.op == "SUM":
            self.amounts.append((ms, value))
        elif self.op == "DIFF":
            self.two = [*self.two[-1:], value]
        elif self.op == "HIST":
            insert(self.buckets.setdefault(ms // self.w.unit, []), value, 1.0, self.bins)
        elif self.op == "COUNT":
            self.buckets[ms // self.w.unit] = self.buckets.get(ms // self.w.unit, 0) + 1
        else:
            n, s, q, low, high = self.buckets.get(ms // self.w.unit, (0, 0.0, 0.0, math.inf, -math.inf))
            self.buckets[ms // self.w.unit] = (n + 1, s + value, q + value * value, min(low, value), max(high, value))

    def read(self, ms: int):
        if self.op == "SUM":
            return math.fsum(v for t, v in self.amounts if ms - self.w.ms < t <= ms)
        if self.op == "DIFF":
            return self.two[1] - self.two[0] if len(self.two) == 2 else 0.0
        if self.op in ("COUNT_DISTINCT", "SET"):
            there = sorted(v for v, t in self.last_seen.items() if ms - self.w.ms < t <= ms)
            return there if self.op == "SET" else len(there)
        last = ms // self.w.unit
        parts = [b for k, b in sorted(self.buckets.items()) if last - self.w.n < k <= last]
        if self.op == "COUNT":
            return float(sum(parts))
        if self.op == "HIST":
            return merged(parts, self.bins)
        n = sum(p[0] for p in parts)
        if self.op == "MAX":
            return max((p[4] for p in parts), default=0.0)
        if self.op == "MIN":
            return min((p[3] for p in parts), default=0.0)
        if not n:
            return math.nan
        mean = math.fsum(p[1] for p in parts) / n
        return mean if self.op == "AVG" else math.fsum(p[2] for p in parts) / n - mean * mean

    def evict(self, ms: int) -> None:
        """Drops what windows that end at ms or later don't reach."""
        self.amounts = [a for a in self.amounts if a[0] > ms - self.w.ms]
        self.last_seen = {v: t for v, t in self.last_seen.items() if t > ms - self.w.ms}
        self.buckets = {k: b for k, b in self.buckets.items() if k > ms // self.w.unit - self.w.n}
