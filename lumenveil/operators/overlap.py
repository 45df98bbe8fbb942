"""Overlaps and intervals: resolution, merging, expansion and containment, by sorts and running values inside a row."""

from __future__ import annotations

from ..functions import fixed
from ..functions.text import FINDING, clusters, empty, lit, meeting

_PRIORITY = "CASE {} " + " ".join(f"WHEN {lit(t)} THEN {p}" for t, p in fixed.PRIORITY.items()) + " ELSE 10000 END"


def resolve_sensitive(findings: str) -> str:
    """Greedy: secrets first, then the longest, the type's priority, the start, the type; by start. Sensitive ones only.

    Findings that meet in no chain of overlaps don't concern each other, so each such chain is decided by itself.
    """
    keyed = f"transform(filter({findings}, f -> f.sensitivity IN ('secret', 'pii')), f -> struct(f.start AS start, f.end AS end, f AS f))"
    ranked = (
        "array_sort(transform(c, x -> struct(if(x.f.sensitivity = 'secret', 0, 1) AS a, x.start - x.end AS b, "
        f"{_PRIORITY.format('x.f.type')} AS c, x.start AS d, x.f.type AS e, x.f AS f)))"
    )
    greedy = f"aggregate({ranked}, {empty(FINDING)}, (got, x) -> if(exists(got, g -> g.start < x.f.end AND x.f.start < g.end), got, array_append(got, x.f)))"
    ordered = f"transform(array_sort(transform({greedy}, f -> struct(f.start AS s, f AS f))), x -> x.f)"
    return f"flatten(transform({clusters(keyed, False)}, c -> if(size(c) = 1, array(c[0].f), {ordered})))"


def instructions(findings: str) -> str:
    """Instruction findings, each (type, category, span) once."""
    return f"array_distinct(filter({findings}, f -> f.sensitivity = 'instruction'))"


def resolve(findings: str) -> str:
    """Resolved sensitive findings and the instructions, by start, end, type."""
    both = f"concat({resolve_sensitive(findings)}, {instructions(findings)})"
    return f"transform(array_sort(transform({both}, f -> struct(f.start AS a, f.end AS b, f.type AS c, f AS f))), x -> x.f)"


INTERVAL = "struct<start:int,end:int>"


def merge(intervals: str) -> str:
    """Merged intervals; touching ones merge."""
    return f"transform({clusters(f'transform({intervals}, x -> struct(x.start AS start, x.end AS end))', True)}, c -> struct(c[0].start AS start, array_max(transform(c, x -> x.end)) AS end))"


def quarantine(findings: str, sensitive: str) -> str:
    """Merged instruction intervals, grown over every sensitive span that they overlap.

    Sensitive spans are disjoint, so that growing once reaches the fixed point.
    """
    base = merge(instructions(findings))
    met = f"transform({meeting(sensitive, 'q', True, FINDING)}, s -> struct(s.start AS start, s.end AS end))"
    return f"transform(array({base}), q -> if(size(q) = 0, q, {merge(f'concat(q, {met})')}))[0]"


def merged_count(intervals: str) -> str:
    """Number of merged intervals (leaf, start, end); touching ones stay apart."""
    return (
        f"aggregate(array_sort({intervals}), struct(0 AS n, -1 AS leaf, -1 AS reach), (s, x) -> if(x.leaf <> s.leaf OR x.start >= s.reach, "
        f"struct(s.n + 1 AS n, x.leaf AS leaf, x.end AS reach), struct(s.n AS n, s.leaf AS leaf, greatest(s.reach, x.end) AS reach)), s -> s.n)"
    )
