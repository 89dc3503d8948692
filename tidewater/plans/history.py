"""Texts of features over a keyed history: sum(amount#user_id.history,1d), count(user_id.history,2h)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .syntax import FeatureError

UNITS = {"h": 3_600_000, "d": 86_400_000}
TEXT = re.compile(r"\s*(sum|count|count_distinct)\s*\(\s*(?:(\w+)\s*#\s*)?(\w+)\.history\s*,\s*([0-9]+)([hd])\s*\)\s*")


@dataclass(frozen=True)
class HistoryFeature:
    """op over target in the last `window` milliseconds of the history by `on`."""

    op: str
    target: str | None
    on: str
    window: int


def parse_history(text: str) -> HistoryFeature:
    m = TEXT.fullmatch(text)
    if not m or int(m[4]) == 0 or (m[2] is None) != (m[1] == "count"):
        raise FeatureError(f"not a feature of a history: {text!r}")
    return HistoryFeature(m[1], m[2], m[3], int(m[4]) * UNITS[m[5]])
