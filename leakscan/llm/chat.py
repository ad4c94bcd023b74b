"""Chat formatting with compiled templates.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested
Python closures that write pieces of text and the marks of generation blocks to a sink.
Conversations stream through the closures turn by turn and leave them in segments of whole turns,
so that no conversation is held as one string.

Language: text, ``{{ expression }}``, ``{% for x in messages %}..{% endfor %}``,
``{% if %}..{% elif %}..{% else %}..{% endif %}``, ``{% set x = expression %}``,
``{% generation %}..{% endgeneration %}`` and ``{# comment #}``. Expressions: strings,
integers, true, false, none, names, ``x.key``, ``x['key']``, ``+``, ``~``, ``==``, ``!=``, ``in``,
``not``, ``and``, ``or``, ``a if c else b``, parentheses and the filters ``escape upper lower trim
length``. The sandbox has no calls and no attributes of Python objects: a key is only looked
up in the turn (role, text, turn) or in ``loop`` (index, index0, first, last).

Control strings inside texts are escaped reversibly: each backslash is doubled, then a single
backslash goes behind the first character of every control string, so that the formatted
text holds control strings at the template's marks only.

Defined results: null roles and texts are empty; turns are ordered by (turn, role, text),
null turns first; repeated rows stay; rows with a null conv_id form one conversation;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Strings with a meaning for common chat models, and the marks of the template below.
CONTROL = ("<|turn|>", "<|says|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
           "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = """{% for m in messages %}<|turn|>{{ m.role | escape }}<|says|>{% if m.role == 'assistant' %}{% generation %}\
{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>
{% endfor %}"""

#: Characters after which a segment ends in front of the next turn.
SEGMENT = 16_000

_BREAK = re.compile("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL))
_JOIN = re.compile(r"\\\\|\\")


def escape(text: str) -> str:
    return _BREAK.sub(r"\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _JOIN.sub(lambda m: "\\" if len(m[0]) == 2 else "", text)


class TemplateError(ValueError):
    pass


FILTERS = {"escape": escape, "upper": str.upper, "lower": str.lower, "trim": str.strip, "length": len}
_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[+~|.()\[\]=]))")


class Expression:
    """Recursive descent over one expression; nodes are tuples headed by their kind."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[at:]!r}")
            at = m.end()
            kind = ("int", "str", "name", "op")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
        self.at = 0

    def peek(self, *values):
        return self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "str"

    def take(self, value=None):
        if self.at >= len(self.tokens) or value is not None and not self.peek(value):
            raise TemplateError(f"expected {value or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self):
        node = self.any()
        if self.peek("if"):
            self.take()
            cond = self.any()
            self.take("else")
            node = ("choice", cond, node, self.choice())
        return node

    def any(self):
        node = self.all()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.all())
        return node

    def all(self):
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self):
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        node = self.sum()
        while self.peek("==", "!=", "in"):
            op = self.take()[1]
            node = (op, node, self.sum())
        return node

    def sum(self):
        node = self.filtered()
        while self.peek("+", "~"):
            op = self.take()[1]
            node = (op, node, self.filtered())
        return node

    def filtered(self):
        node = self.member()
        while self.peek("|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def member(self):
        node = self.atom()
        while self.peek(".", "["):
            if self.take()[1] == ".":
                kind, key = self.take()
                if kind != "name":
                    raise TemplateError("a name is expected after a dot")
            else:
                kind, raw = self.take()
                if kind != "str":
                    raise TemplateError("keys are strings")
                key = _string(raw)
                self.take("]")
            node = ("key", node, key)
        return node

    def atom(self):
        kind, value = self.take()
        if kind == "int":
            return ("const", int(value))
        if kind == "str":
            return ("const", _string(value))
        if kind == "name":
            if value in ("true", "false", "none"):
                return ("const", {"true": True, "false": False, "none": None}[value])
            return ("name", value)
        if value == "(":
            node = self.choice()
            self.take(")")
            return node
        raise TemplateError(f"unexpected {value!r}")


def _string(raw: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), raw[1:-1], flags=re.S)


def parse(source: str):
    """The syntax tree of a template: ("block", [nodes])."""
    stack: list = [("block", None, [])]
    for part in _TAG.split(source):
        body = stack[-1][2]
        if not part or part.startswith("{#"):
            continue
        if part.startswith("{{"):
            body.append(("print", Expression(part[2:-2]).whole()))
            continue
        if not part.startswith("{%"):
            body.append(("print", ("const", part)))
            continue
        words = part[2:-2].strip()
        head, _, rest = words.partition(" ")
        if head == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
            if not m:
                raise TemplateError("loops go over messages")
            stack.append(("for", m[1], []))
        elif head == "if":
            stack.append(("if", [(Expression(rest).whole(), [])], None))
            stack[-1] = ("if", stack[-1][1], stack[-1][1][-1][1])
        elif head in ("elif", "else"):
            if stack[-1][0] != "if":
                raise TemplateError(f"{head} outside if")
            arms = stack[-1][1]
            arms.append((Expression(rest).whole() if head == "elif" else ("const", True), []))
            stack[-1] = ("if", arms, arms[-1][1])
        elif head == "set":
            name, eq, value = rest.partition("=")
            if not eq or not name.strip().isidentifier():
                raise TemplateError("set name = expression")
            body.append(("set", name.strip(), Expression(value).whole()))
        elif head == "generation":
            stack.append(("generation", None, []))
        elif head in ("endfor", "endif", "endgeneration"):
            kind, arg, inner = stack.pop()
            if kind != head[3:]:
                raise TemplateError(f"{head} without {head[3:]}")
            stack[-1][2].append((kind, arg, inner) if kind == "for" else (kind, arg) if kind == "if" else (kind, inner))
        else:
            raise TemplateError(f"no tag {head!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return ("block", stack[0][2])


_BINARY = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b,
           "~": lambda a, b: _text(a) + _text(b)}


def _plus(a, b):
    if type(a) is not type(b) or not isinstance(a, (str, int)):
        raise TemplateError("+ takes two strings or two integers")
    return a + b


_BINARY["+"] = _plus


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node):
    """Constant folding: expressions without names become constants, branches decided in
    advance vanish, neighbouring constant prints join."""
    kind = node[0]
    if kind == "block":
        out: list = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "block" else [x]:
                if y[0] == "print" and y[1][0] == "const":
                    y = ("print", ("const", _text(y[1][1])))
                    if out and out[-1][0] == "print" and out[-1][1][0] == "const":
                        out[-1] = ("print", ("const", out[-1][1][1] + y[1][1]))
                        continue
                out.append(y)
        return ("block", out)
    if kind == "print":
        return ("print", fold(node[1]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "for":
        return ("for", node[1], fold(("block", node[2])))
    if kind == "generation":
        return ("generation", fold(("block", node[1])) if isinstance(node[1], list) else fold(node[1]))
    if kind == "if":
        arms = []
        for cond, body in node[1]:
            cond = fold(cond)
            if cond[0] == "const" and not cond[1]:
                continue
            arms.append((cond, fold(("block", body)) if isinstance(body, list) else fold(body)))
            if cond[0] == "const":
                break
        if not arms or arms[0][0][0] == "const":
            return arms[0][1] if arms else ("block", [])
        return ("if", arms)
    if kind in _BINARY:
        a, b = fold(node[1]), fold(node[2])
        return ("const", _BINARY[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind in ("and", "or"):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "not":
        a = fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "choice":
        c, a, b = map(fold, node[1:])
        return (a if c[1] else b) if c[0] == "const" else ("choice", c, a, b)
    if kind == "filter":
        a = fold(node[2])
        return ("const", FILTERS[node[1]](a[1])) if a[0] == "const" else ("filter", node[1], a)
    if kind == "key":
        return ("key", fold(node[1]), node[2])
    return node


def _value(node):
    """Closure env -> value."""
    kind = node[0]
    if kind == "const":
        v = node[1]
        return lambda env: v
    if kind == "name":
        name = node[1]

        def look(env):
            if name not in env:
                raise TemplateError(f"no name {name!r}")
            return env[name]
        return look
    if kind == "key":
        of, key = _value(node[1]), node[2]

        def get(env):
            d = of(env)
            if type(d) is not dict or key not in d:
                raise TemplateError(f"no key {key!r}")
            return d[key]
        return get
    if kind == "filter":
        f, a = FILTERS[node[1]], _value(node[2])
        return lambda env: f(a(env))
    if kind == "not":
        a = _value(node[1])
        return lambda env: not a(env)
    if kind == "choice":
        c, a, b = map(_value, node[1:])
        return lambda env: a(env) if c(env) else b(env)
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    op = _BINARY[kind]
    return lambda env: op(a(env), b(env))


def _emit(node):
    """Closure (env, messages, sink) that writes a node."""
    kind = node[0]
    if kind == "block":
        parts = [_emit(x) for x in node[1]]

        def block(env, messages, sink):
            for p in parts:
                p(env, messages, sink)
        return block
    if kind == "print":
        v = _value(node[1])
        return lambda env, messages, sink: sink.write(_text(v(env)))
    if kind == "set":
        name, v = node[1], _value(node[2])
        return lambda env, messages, sink: env.__setitem__(name, v(env))
    if kind == "generation":
        body = _emit(node[1])

        def generation(env, messages, sink):
            sink.begin()
            body(env, messages, sink)
            sink.end()
        return generation
    if kind == "if":
        arms = [(_value(c), _emit(b)) for c, b in node[1]]

        def branch(env, messages, sink):
            for c, b in arms:
                if c(env):
                    return b(env, messages, sink)
        return branch
    name, body = node[1], _emit(node[2])

    def loop(env, messages, sink):
        for scope in _scopes(env, name, messages):
            body(scope, messages, sink)
    return loop


def _scopes(env, name, messages):
    """The names of a loop's body, turn by turn; one turn is read ahead."""
    turns, k = iter(messages), 0
    turn = next(turns, None)
    while turn is not None:
        after = next(turns, None)
        yield {**env, name: turn, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": after is None}}
        turn, k = after, k + 1


class Sink:
    """Text with its length in code points, and the spans of generation blocks."""

    def __init__(self):
        self.parts, self.length, self.spans, self.open, self.start = [], 0, [], None, 0

    def write(self, text):
        self.parts.append(text)
        self.length += len(text)

    def begin(self):
        if self.open is not None:
            raise TemplateError("generation blocks don't nest")
        self.open = self.length

    def end(self):
        self.spans.append((self.open, self.length))
        self.open = None

    def take(self):
        """(start, text, spans in that text) of what was written since the last call."""
        out = self.start, "".join(self.parts), [(a - self.start, z - self.start) for a, z in self.spans]
        self.parts, self.spans, self.start = [], [], self.length
        return out


def compile_template(source: str):
    """messages -> (formatted text, spans of the loss mask in code points)."""
    emit = _emit(fold(parse(source)))

    def render(messages):
        sink = Sink()
        emit({}, messages, sink)
        return "".join(sink.parts), sink.spans
    return render


def _loops(node) -> int:
    """Loops in a syntax tree."""
    return isinstance(node, (tuple, list)) and (bool(node) and node[0] == "for") + sum(map(_loops, node))


def compile_segments(source: str, limit: int = SEGMENT):
    """messages -> segments (start, text, loss spans in that text), cut in front of a turn of an
    outer loop where a segment has ``limit`` characters. A template whose only loop is an outer one reads
    its messages once, turn by turn; others take a list of them."""
    tree = fold(parse(source))
    nodes = tree[1] if tree[0] == "block" else [tree]
    once = _loops(tree) == 1 and any(x[0] == "for" for x in nodes)
    parts = [(x[1], _emit(x[2])) if x[0] == "for" else (None, _emit(x)) for x in nodes]

    def segments(messages):
        env, sink = {}, Sink()
        messages = messages if once else list(messages)
        for name, emit in parts:
            if name is None:
                emit(env, messages, sink)
                continue
            for scope in _scopes(env, name, messages):
                if sink.length - sink.start >= limit:
                    yield sink.take()
                emit(scope, messages, sink)
        yield sink.take()
    return segments


def format_conversations(rows: DataFrame, template: str = TEMPLATE, limit: int = SEGMENT) -> DataFrame:
    """conv_id, part, start, formatted, loss_spans (array of struct<start, stop>, places in
    ``formatted``): the segments of each conversation, ``part`` from 0, ``start`` characters into it. Most
    conversations are one segment.

    One shuffle by conv_id; the sorted rows stream through the closures, so a task holds
    one turn and one segment at a time, however long a conversation is. The segments of a conversation follow
    each other in one partition."""
    import pyarrow as pa
    ship(rows.sparkSession)
    d = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id bigint, part bigint, start bigint, formatted string, loss_spans array<struct<start: bigint, stop: bigint>>"
    arrow = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), ("formatted", pa.string()),
                       ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def run(batches):
        from itertools import groupby
        segments = compile_segments(template, limit)
        turns = (t for b in batches for t in b.to_pylist())
        out, size = [], 0
        for conv_id, own in groupby(turns, key=lambda t: t["conv_id"]):
            for part, (start, text, spans) in enumerate(segments(own)):
                out.append({"conv_id": conv_id, "part": part, "start": start, "formatted": text, "loss_spans": [{"start": a, "stop": z} for a, z in spans]})
                size += len(text)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return d.mapInArrow(run, schema)


_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text formatted with ``TEMPLATE``."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def digests(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """Turns and loss mask, read back from the formatted segments (``TEMPLATE``), one row per conversation.
    Hashes are fed segment by segment, so a task holds a few segments at a time. ``ordered``: the segments of
    each conversation already follow each other in one partition, as ``format_conversations`` gives them."""
    import pyarrow as pa
    ship(formatted.sparkSession)
    d = formatted.select("conv_id", "part", "formatted", "loss_spans")
    if not ordered:
        d = d.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches):
        from itertools import groupby
        names = "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
        segments = (r for b in batches for r in b.to_pylist())
        out: list = []

        def table():
            return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k.endswith("sha256") else pa.int64()) for k, v in zip(names, zip(*out))], names=list(names))

        for conv_id, own in groupby(segments, key=lambda r: r["conv_id"]):
            said, masked, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for r in own:
                text = r["formatted"]
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"]:s["stop"]]) for s in r["loss_spans"])
                said.update("".join(f"{role}\n{t}\n" for role, t in turns).encode("utf-8"))
                masked.update(loss.encode("utf-8"))
                n_turns, loss_chars, chars = n_turns + len(turns), loss_chars + len(loss), chars + len(text)
            out.append((conv_id, n_turns, said.hexdigest(), loss_chars, masked.hexdigest(), chars))
            if len(out) >= 10_000:
                yield table()
                out.clear()
        if out:
            yield table()

    return d.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
