"""Regex helpers that stay inside the JVM.

Spark has no built-in that returns every match of a pattern together
with its position. ``spans_sql`` gets them with one regex pass:

    parts = split(regexp_replace(t, P, OPEN || '$0' || CLOSE), OPEN, -1)
    parts[0]          = text before the first match
    parts[i] (i >= 1) = match_i || CLOSE || text up to the next match

so match i starts at len(parts[0]) + sum(len(parts[j]) - 1 for 1 <= j < i),
counted in code points like Python ``len``. ``split`` on one plain
character takes Java's no-regex fast path. The find loop behind
``regexp_replace`` is the one of ``finditer`` for patterns that cannot
match the empty string (true for every catalog pattern).

A text that already holds a marker character takes the exact fallback
``regexp_extract_all`` + ``split(t, P)`` (two regex passes).

Expressions are produced as Spark SQL text: one ``F.expr`` per detector
is far cheaper to build than thousands of py4j Column calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# private-use characters, written as escapes so that no editor drops them
OPEN = "\ue000"
CLOSE = "\ue001"

SPAN_TYPE = "array<struct<pos:int,raw:string>>"

# Python str.isspace() also counts U+001C..U+001F, Java's \s does not
_WS = r"[\s\x1c-\x1f]"
STRIP_PATTERN = rf"(?U)^{_WS}+|{_WS}+$"


def sql_str(s: str) -> str:
    """A Spark SQL string literal holding exactly ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ustrip(c: Column) -> Column:
    """Unicode-aware ``str.strip()`` (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(c, F.lit(STRIP_PATTERN), F.lit(""))


def ustrip_sql(x: str) -> str:
    return f"regexp_replace({x}, {sql_str(STRIP_PATTERN)}, '')"


def spans_sql(text: str, pattern: str) -> str:
    """SQL for ``array<struct<pos:int, raw:string>>`` of all non-overlapping
    matches of ``pattern`` (Java syntax) in the column/expression ``text``."""
    p = sql_str(pattern)
    o, c = sql_str(OPEN), sql_str(CLOSE)
    empty = f"CAST(array() AS {SPAN_TYPE})"
    marked = (
        f"aggregate(split(regexp_replace({text}, {p}, {sql_str(OPEN + '$0' + CLOSE)}), {o}, -1), "
        f"named_struct('off', -1, 'out', {empty}), "
        f"(acc, x) -> CASE WHEN acc.off < 0 THEN named_struct('off', length(x), 'out', acc.out) "
        f"ELSE named_struct('off', acc.off + length(x) - 1, 'out', "
        f"concat(acc.out, array(named_struct('pos', acc.off, 'raw', substring_index(x, {c}, 1))))) END, "
        f"acc -> acc.out)"
    )
    exact = (
        f"aggregate(zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), (v, g) -> named_struct('v', v, 'g', g)), "
        f"named_struct('off', 0, 'out', {empty}), "
        f"(acc, e) -> CASE WHEN e.v IS NULL THEN acc ELSE named_struct('off', acc.off + length(e.g) + length(e.v), 'out', "
        f"concat(acc.out, array(named_struct('pos', acc.off + length(e.g), 'raw', e.v)))) END, "
        f"acc -> acc.out)"
    )
    return (f"CASE WHEN {text} IS NULL THEN {empty} "
            f"WHEN contains({text}, {o}) OR contains({text}, {c}) THEN {exact} "
            f"ELSE {marked} END")


def match_spans(text_col: str, pattern: str) -> Column:
    """Column form of ``spans_sql`` over the column named ``text_col``."""
    return F.expr(spans_sql(f"`{text_col}`", pattern))
