"""From feature texts to layers of distinct calls, inner ones first."""

from __future__ import annotations

from dataclasses import dataclass

from .syntax import Call, FeatureError, Macros, parse_call

UPDATE, UPGET, GET = "update", "upget", "get"


@dataclass(frozen=True)
class Feature:
    """A feature as declared: its name (the text without white space), what it expands to, its mode, its event type."""

    name: str
    call: Call
    mode: str
    event_type: str


def declare(text: str, macros: Macros, mode: str, event_type: str) -> Feature:
    if mode not in (UPDATE, UPGET, GET):
        raise FeatureError(f"no such mode: {mode}")
    call = parse_call(text)
    expanded = macros.expand(call)
    return Feature(str(call), expanded, mode, event_type)


def fused(features: list[Feature]) -> list[Feature]:
    """A call that is both updated and read is one that does both."""
    by: dict[tuple, Feature] = {}
    for f in features:
        key = (f.name, f.event_type)
        old = by.get(key)
        if old and old.mode != f.mode:
            f = Feature(f.name, f.call, UPGET, f.event_type)
        by[key] = f
    return list(by.values())


def layers(features: list[Feature]) -> list[list[tuple[Call, str]]]:
    """(call, mode) by depth, each once. Inner calls run in the mode of the outermost one."""
    found: dict[tuple[Call, str], int] = {}

    def visit(call: Call, mode: str) -> None:
        for a in call.args:
            if isinstance(a, Call):
                visit(a, mode)
        found[call, mode] = call.depth

    for f in features:
        if f.mode != UPDATE:
            visit(f.call, f.mode)
    depths = sorted(set(found.values()))
    return [[key for key, d in found.items() if d == depth] for depth in depths]
