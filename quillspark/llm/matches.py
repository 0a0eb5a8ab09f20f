"""Where a regular expression matches in a text, with DataFrame functions only."""

from __future__ import annotations

#: Matches whose places are summed up one after the other; longer lists are cut into such parts.
PART = 512


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(text: str, pattern: str, *groups: int) -> str:
    """SQL: array of (start, stop, g0, ...) of the leftmost, non-overlapping matches, in code
    points; start counts from 0, stop is exclusive. The pattern must not match empty strings.

    The texts between the matches come from a split, and the places are sums of their lengths:
    first of parts of ``PART`` matches, then within each part, as a sum that is kept for every
    match is copied with each.
    """
    rx = quoted(pattern)
    gaps = f"transform(arrays_zip(split({text}, {rx}, -1), regexp_extract_all({text}, {rx}, 0)), x -> named_struct('b', char_length(x.`0`), 'n', coalesce(char_length(x.`1`), 0)))"
    parts = f"transform(sequence(0, (size(all) - 1) div {PART}), i -> slice(all, int(i * {PART} + 1), {PART}))"
    size = "aggregate(p, 0, (n, x) -> n + x.b + x.n)"
    tops = f"aggregate(parts, named_struct('at', 0, 'all', cast(array() as array<int>)), (s, p) -> named_struct('at', s.at + {size}, 'all', array_append(s.all, s.at)), s -> s.all)"
    inner = """aggregate(z.parts, named_struct('at', z.tops, 'all', cast(array() as array<struct<start:int,stop:int>>)),
        (s, x) -> named_struct('at', s.at + x.b + x.n, 'all', if(x.n > 0, array_append(s.all, named_struct('start', s.at + x.b, 'stop', s.at + x.b + x.n)), s.all)), s -> s.all)"""
    each = f"transform({tops}, (t, i) -> named_struct('parts', parts[i], 'tops', t))"
    places = f"transform(array({gaps}), all -> transform(array({parts}), parts -> flatten(transform({each}, z -> {inner})))[0])[0]"
    if not groups:
        return places
    hits = ", ".join(f"regexp_extract_all({text}, {rx}, {g})" for g in groups)
    names = ", ".join(f"'g{g}', z.`{i}`" for i, g in enumerate(groups, 1))
    return f"transform(arrays_zip({places}, {hits}), z -> named_struct('start', z.`0`.start, 'stop', z.`0`.stop, {names}))"
