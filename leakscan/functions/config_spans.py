"""Spans of the config-fragment pattern (D27) without its backtracking.

The pattern is ``{ .* key .* : \\s* quote? [^"']+ quote? }`` on one line up to the colon, or
``- word: word``. Its three open repetitions make a regex engine try every brace, key and
colon of a line together: worse than quadratic on one long line.

What the engine would find follows from a few places. A colon *holds* if a closing brace can
follow it: with q the next quote, ``q}``, or else the last ``}`` between colon and q (at least
one character away); if the colon's value begins with a quote, the same beyond that quote. Of all colons
of a line that hold the engine takes the last one, from every brace of the line with a
key between; so the first brace that is left of the last key before that colon starts
the match, and later ones lie inside it. A match may end lines later; then the first brace behind
its end counts.

One pass from right to left over quotes, braces, colons, keys and line ends keeps the next two
quotes, the last closing brace before each, and the line's colon, key and brace; a short pass
over the lines that match picks the matches from left to right. Both are folds in
the JVM, linear in the text. ``- word: word`` never holds a brace, so it is matched on its own, outside
those spans.
"""

from __future__ import annotations

from .regex import CLOSE, OPEN, SPAN_TYPE, spans_sql, sql_str

#: Shortest keys of the pattern: its other keys hold one of them, at the same end or start.
KEYS = ("pass", "pwd", "key", "token", "secret")
DASH_PATTERN = r"(?dU)- \w+: \w+"
# white space as Python's re understands it; a run of opening braces with nothing of interest between them is one
# event, as its first one counts
_OPEN_RUN = r"\{(?:[^\"'}:\n{pkts]*+\{)*+"
_EVENTS = r"(?dU)[\"']|\}+|:[\s\x1c-\x1f]*+|\n|" + _OPEN_RUN + "|" + "|".join(KEYS)

_LINE = "struct<ks:int,pf:int,ce:int>"
_STATE = ("pos", "nq", "qc", "lb", "nq2", "qc2", "lb2", "bs", "ce", "ks", "pf", "out")


def _state(**changed: str) -> str:
    """The next state: unnamed fields stay."""
    return "named_struct(" + ", ".join(f"'{f}', {changed.get(f, 'a.' + f)}" for f in _STATE) + ")"


# a line that has a brace before its key before its colon
_LINES_DONE = "CASE WHEN a.pf >= 0 THEN concat(a.out, array(named_struct('ks', a.ks, 'pf', a.pf, 'ce', a.ce))) ELSE a.out END"


def _colon_end(i: str, w: str) -> str:
    """End of the match behind a colon at ``i`` whose white space ends at ``w``; -1 if it doesn't hold."""
    quoted = (f"CASE WHEN a.qc2 AND a.nq2 >= {w} + 2 THEN a.nq2 + 2 WHEN a.lb2 >= {w} + 2 THEN a.lb2 + 1 "
              f"WHEN {w} > {i} + 1 AND a.qc THEN {w} + 2 ELSE -1 END")
    plain = f"CASE WHEN a.qc THEN a.nq + 2 WHEN a.lb >= {i} + 2 THEN a.lb + 1 ELSE -1 END"
    return f"CASE WHEN a.nq = {w} AND {w} < a.n THEN {quoted} ELSE {plain} END"


def brace_spans_sql(text: str) -> str:
    """SQL of ``array<struct<pos, raw>>``: matches of the part of the pattern that starts with a brace."""
    # marker characters are ordinary ones to the pattern
    clean = f"translate({text}, {sql_str(OPEN + CLOSE)}, {sql_str(chr(1) * 2)})"
    marked = f"split(regexp_replace({clean}, {sql_str(_EVENTS)}, {sql_str(OPEN + '$0' + CLOSE)}), {sql_str(OPEN)}, -1)"
    events = (f"reverse(transform(slice({marked}, 2, 2000000000), x -> named_struct('len', length(x) - 1, "
              f"'raw', substring_index(x, {sql_str(CLOSE)}, 1), 't', substring(x, 1, 1))))")
    i = "(a.pos - x.len)"
    w = f"({i} + length(x.raw))"
    breaks = "instr(x.raw, '\\n') > 0"
    fresh = f"CASE WHEN {breaks} THEN -1 ELSE a.{{}} END"
    held = _colon_end(i, w).replace("a.n THEN", f"length({text}) THEN")
    step = ("CASE "
            f"WHEN x.t IN ('\"', {sql_str(chr(39))}) THEN "
            + _state(pos=i, nq=i, qc=f"a.bs = {i} + 1", lb="-1", nq2="a.nq", qc2="a.qc", lb2="a.lb")
            + " WHEN x.t = '}' THEN " + _state(pos=i, lb=f"CASE WHEN a.lb < 0 THEN {i} + length(x.raw) - 1 ELSE a.lb END", bs=i)
            + " WHEN x.t = ':' THEN " + _state(
                pos=i, out=f"CASE WHEN {breaks} THEN {_LINES_DONE} ELSE a.out END", ks=fresh.format("ks"), pf=fresh.format("pf"),
                ce=f"CASE WHEN a.ce >= 0 AND NOT {breaks} THEN a.ce ELSE {held} END")
            + " WHEN x.t = '\\n' THEN " + _state(pos=i, out=_LINES_DONE, ce="-1", ks="-1", pf="-1")
            + " WHEN x.t = '{' THEN " + _state(pos=i, pf=f"CASE WHEN a.ks >= 0 THEN {i} ELSE a.pf END")
            + " ELSE " + _state(pos=i, ks=f"CASE WHEN a.ce >= 0 AND a.ks < 0 THEN {i} ELSE a.ks END") + " END")
    n = f"length({text})"
    zero = (f"named_struct('pos', {n}, 'nq', {n}, 'qc', false, 'lb', -1, 'nq2', {n}, 'qc2', false, 'lb2', -1, 'bs', -2, "
            f"'ce', -1, 'ks', -1, 'pf', -1, 'out', CAST(array() AS array<{_LINE}>))")
    lines = f"aggregate({events}, {zero}, (a, x) -> {step}, a -> {_LINES_DONE})"
    empty = f"CAST(array() AS {SPAN_TYPE})"
    # the first brace of a line, or the first one behind a match that ended within the line
    brace = f"CASE WHEN l.pf >= s.e THEN l.pf ELSE locate('{{', {text}, s.e + 1) - 1 END"
    hit = f"(l.pf >= s.e OR (s.e < l.ks AND locate('{{', {text}, s.e + 1) - 1 BETWEEN s.e AND l.ks - 1))"
    return (f"aggregate(reverse({lines}), named_struct('e', 0, 'out', {empty}), (s, l) -> CASE WHEN {hit} THEN "
            f"named_struct('e', l.ce, 'out', concat(s.out, array(named_struct('pos', {brace}, 'raw', substring({text}, {brace} + 1, l.ce - ({brace})))))) "
            f"ELSE s END, s -> s.out)")


def config_spans_sql(text: str) -> str:
    """SQL of all matches of the whole pattern, by position."""
    keys = " OR ".join(f"contains({text}, '{k}')" for k in KEYS)
    empty = f"CAST(array() AS {SPAN_TYPE})"
    braces = (f"CASE WHEN contains({text}, '{{') AND contains({text}, '}}') AND contains({text}, ':') AND ({keys}) "
              f"THEN {brace_spans_sql(text)} ELSE {empty} END")
    dashes = f"CASE WHEN contains({text}, '- ') THEN {spans_sql(text, DASH_PATTERN)} ELSE {empty} END"
    # one element arrays stand for local names: both lists are computed once
    both = f"transform(array(named_struct('b', {braces}, 'd', {dashes})), t -> "
    outside = "filter(t.d, d -> NOT exists(t.b, b -> d.pos >= b.pos AND d.pos < b.pos + length(b.raw)))"
    return f"flatten({both} array_sort(concat(t.b, {outside}))))"
