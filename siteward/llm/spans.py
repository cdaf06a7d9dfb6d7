"""Linear-time array expressions over the matches of a regex, as SQL text for ``expr``.

A value that a lambda uses is bound by ``let`` and so computed once; sums and maxima of what stands
before an element are taken in blocks, since an array that grows in a fold is copied at every step.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

_CHUNK = 128
_names = count()


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(x: str, f: Callable[[str], str]) -> str:
    """f of x, with x computed once."""
    v = f"v{next(_names)}"
    return f"get(transform(array({x}), {v} -> {f(v)}), 0)"


def each(a: str, f: Callable[[str, str], str]) -> str:
    """f of every element and its place."""
    v, i = f"v{next(_names)}", f"i{next(_names)}"
    return f"transform({a}, ({v}, {i}) -> {f(v, i)})"


def those(a: str, f: Callable[[str, str], str]) -> str:
    """The elements for which f of them and their place holds."""
    v, i = f"v{next(_names)}", f"i{next(_names)}"
    return f"filter({a}, ({v}, {i}) -> {f(v, i)})"


def places(a: str) -> str:
    return f"sequence(0, size({a}) - 1)"


def _blocked(a: str, whole: Callable[[str], str], join: Callable[[str, str], str], start: str, more: int) -> str:
    """Of every element ``whole`` of the elements before it (and itself, if more is 1)."""
    none = f"slice(array({start}), 1, 0)"

    def filled(a: str) -> str:
        s, v = f"v{next(_names)}", f"v{next(_names)}"
        blocks = each(f"sequence(0, (size({a}) - 1) div {_CHUNK})", lambda j, _: whole(f"slice({a}, cast({j} * {_CHUNK} + 1 AS INT), {_CHUNK})"))
        sums = f"aggregate({blocks}, named_struct('s', {start}, 'o', {none}), ({s}, {v}) -> named_struct('s', {join(f'{s}.s', v)}, 'o', array_append({s}.o, {s}.s)), {s} -> {s}.o)"
        at = lambda i: f"cast({i} div {_CHUNK} AS INT)"
        return let(sums, lambda sums: each(places(a), lambda i, _: join(f"get({sums}, {at(i)})", whole(f"slice({a}, {at(i)} * {_CHUNK} + 1, {i} % {_CHUNK} + {more})"))))

    return let(a, lambda a: f"CASE WHEN size({a}) > 0 THEN {filled(a)} ELSE {none} END")


def before(a: str) -> str:
    """Sums of what stands before each element of an array of bigint."""

    def whole(x: str) -> str:
        s, v = f"v{next(_names)}", f"v{next(_names)}"
        return f"aggregate({x}, 0L, ({s}, {v}) -> {s} + {v})"

    return _blocked(a, whole, lambda x, y: f"{x} + {y}", "0L", 0)


def highest(a: str) -> str:
    """The greatest of each element and those before it, -1 at least, of an array of bigint."""
    return _blocked(a, lambda x: f"coalesce(array_max({x}), -1L)", lambda x, y: f"greatest({x}, {y})", "-1L", 1)


def matches(body: str, regex: str, gap: Callable[[str], str], own: Callable[[str], str], made: Callable[[str, str, str, str], str]) -> str:
    """An array of ``made(start, end, match, gap before it)`` of every match; places are sums of ``gap`` (of
    a stretch without a match) and ``own`` (of a match), both bigint."""

    def build(m: str, g: str) -> str:
        steps = each(m, lambda x, i: f"{gap(f'get({g}, {i})')} + {own(x)}")
        start = lambda s, i: f"get({s}, {i}) + {gap(f'get({g}, {i})')}"
        return let(before(steps), lambda s: each(m, lambda x, i: made(start(s, i), f"{start(s, i)} + {own(x)}", x, f"get({g}, {i})")))

    return let(f"regexp_extract_all({body}, {regex}, 0)", lambda m: let(f"split({body}, {regex}, -1)", lambda g: build(m, g)))
