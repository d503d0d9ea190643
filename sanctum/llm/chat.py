r"""Chat formatting by compiled templates.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures that yield pieces of
text; nothing of it is ever evaluated as Python.  The language: ``{{ expr }}``; ``{% for x in expr %}``, with ``loop.index``,
``loop.index0``, ``loop.first`` and ``loop.last``; ``{% if %}``/``{% elif %}``/``{% else %}``; ``{% set x = expr %}``;
``{% generation %}`` around what a model is to learn; ``{# comments #}``; ``-`` inside a tag trims white space beside it.
Expressions: strings, integers, true, false, none, lists, names, ``a.b`` and ``a['b']`` on dicts alone, ``+ ~ == != < <= > >=
in not and or``, parentheses and the filters given to the compiler.  There are no calls, and attributes of Python objects
are out of reach.

Loops draw from iterators one element ahead, so a conversation is rendered as it streams in and no more than two turns of
it are held.  The format read back here, ``TEMPLATE``, marks turns as ``### Role: text</turn>``.  In roles and texts a
backslash becomes two, ``### `` becomes ``#\## `` and ``</turn>`` becomes ``<\/turn>``, so no control string occurs in a text,
and dropping the first backslash of each pair gives the text back.

Edge cases: a null text or role counts as empty; turns of equal number are ordered by role, then text; a null turn is first;
a null conv_id is a conversation of its own; repeated rows are turns of their own; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_type, read_table, slices

ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
_ROLE_OF = {v: k for k, v in ROLES.items()}
TEMPLATE = """{% for m in messages %}### {{ m.role | role }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>
{% endfor %}"""


class TemplateError(ValueError):
    pass


# == parsing ==

_TAG = re.compile(r"\{\{-?|\{%-?|\{#")
_LEX = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.()\[\],=]))""", re.S)
_UNESCAPE = {"n": "\n", "t": "\t", "r": "\r"}


def _lex(code: str) -> list[tuple[str, str]]:
    out, at = [], 0
    code = code.rstrip()
    while at < len(code):
        m = _LEX.match(code, at)
        if not m:
            raise TemplateError(f"unexpected {code[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _segments(source: str) -> list:
    """('text' | 'expr' | 'tag', content), white space trimmed as asked for."""
    out, at, trim = [], 0, False
    while at < len(source):
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if trim:
            text = text.lstrip()
        if m and m[0].endswith("-"):
            text = text.rstrip()
        if text:
            out.append(("text", text))
        if not m:
            break
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        end = _find(source, m.end(), close)
        body = source[m.end() : end]
        trim = body.endswith("-") and close != "#}"
        if close != "#}":
            out.append(("expr" if close == "}}" else "tag", body[:-1] if trim else body))
        at = end + 2
    return out


def _find(source: str, at: int, close: str) -> int:
    """The end of a tag, quotes skipped."""
    if close == "#}":
        end = source.find(close, at)
    else:
        m = re.compile(r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|(?!%s).)*?(?=%s)""" % (re.escape(close), re.escape(close)), re.S).match(source, at)
        end = m.end() if m else -1
    if end < 0:
        raise TemplateError("a tag isn't closed")
    return end


class _Expression:
    """Recursive descent over tokens; nodes are tuples ('const', v), ('name', n), ('get', e, key), ('op', o, a, b), ..."""

    def __init__(self, code: str, filters: dict[str, Callable]):
        self.tokens, self.at, self.filters = _lex(code), 0, filters

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        e = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def either(self):
        e = self.both()
        while self.peek("or"):
            self.take("or")
            e = ("or", e, self.both())
        return e

    def both(self):
        e = self.inverse()
        while self.peek("and"):
            self.take("and")
            e = ("and", e, self.inverse())
        return e

    def inverse(self):
        if self.peek("not"):
            self.take("not")
            return ("not", self.inverse())
        return self.compared()

    def compared(self):
        e = self.sum()
        while self.peek("==", "!=", "<", "<=", ">", ">=", "in"):
            o = self.take("==", "!=", "<", "<=", ">", ">=", "in")
            e = ("op", o, e, self.sum())
        return e

    def sum(self):
        e = self.filtered()
        while self.peek("+", "~", "-"):
            o = self.take("+", "~", "-")
            e = ("op", o, e, self.filtered())
        return e

    def filtered(self):
        e = self.atom()
        while self.peek("|", ".", "["):
            o = self.take("|", ".", "[")
            if o == "|":
                n = self.name()
                if n not in self.filters:
                    raise TemplateError(f"no filter {n}")
                e = ("filter", n, e)
            elif o == ".":
                e = ("get", e, ("const", self.name()))
            else:
                e = ("get", e, self.either())
                self.take("]")
        return e

    def atom(self):
        if self.peek("("):
            self.take("(")
            e = self.either()
            self.take(")")
            return e
        if self.peek("["):
            self.take("[")
            items = []
            while not self.peek("]"):
                items.append(self.either())
                if not self.peek("]"):
                    self.take(",")
            self.take("]")
            return ("list", items)
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _UNESCAPE.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if kind == "name":
            known = {"true": True, "false": False, "none": None}
            return ("const", known[value.lower()]) if value.lower() in known else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str, filters: dict[str, Callable]) -> list:
    """The syntax tree: a list of ('text', s), ('out', e), ('for', name, e, body), ('if', [(e, body)]), ('set', name, e),
    ('gen', body)."""
    segments, at = _segments(source), 0

    def block(*ends: str) -> tuple[list, str]:
        nonlocal at
        out = []
        while at < len(segments):
            kind, content = segments[at]
            at += 1
            if kind == "text":
                out.append(("text", content))
                continue
            if kind == "expr":
                out.append(("out", _Expression(content, filters).whole()))
                continue
            word, _, rest = content.strip().partition(" ")
            if word in ends:
                return out, content.strip()
            if word == "for":
                e = _Expression(rest, filters)
                var = e.name()
                e.take("in")
                out.append(("for", var, e.whole(), block("endfor")[0]))
            elif word == "if":
                arms, test = [], _Expression(rest, filters).whole()
                while True:
                    body, end = block("elif", "else", "endif")
                    arms.append((test, body))
                    if end == "endif":
                        break
                    test = ("const", True) if end == "else" else _Expression(end.partition(" ")[2], filters).whole()
                out.append(("if", arms))
            elif word == "set":
                e = _Expression(rest, filters)
                var = e.name()
                e.take("=")
                out.append(("set", var, e.whole()))
            elif word == "generation":
                out.append(("gen", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {word}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    return block()[0]


# == folding and closures ==


def _show(v) -> str:
    return "" if v is None else str(v)


def _apply(o: str, a, b):
    if o == "~":
        return _show(a) + _show(b)
    if o == "+":
        return a + b
    if o == "-":
        return a - b
    if o == "in":
        return a in b
    return {"==": a == b, "!=": a != b}[o] if o in ("==", "!=") else {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[o]


def fold_expr(e: tuple, filters: dict[str, Callable]) -> tuple:
    if e[0] in ("const", "name"):
        return e
    if e[0] == "list":
        items = [fold_expr(x, filters) for x in e[1]]
        return ("const", [x[1] for x in items]) if all(x[0] == "const" for x in items) else ("list", items)
    parts = [fold_expr(x, filters) if isinstance(x, tuple) else x for x in e[1:]]
    if e[0] in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (e[0] == "and") else parts[0]
    out = (e[0], *parts)
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        try:
            return ("const", compile_expr(out, filters)({}))
        except (TypeError, KeyError, TemplateError):
            return out  # fails when it is rendered, if it is
    return out


def fold(tree: list, filters: dict[str, Callable]) -> list:
    """Constant expressions become text, constant conditions choose their arm, adjacent text joins."""
    out: list = []

    def add(node):
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in tree:
        if node[0] == "out":
            e = fold_expr(node[1], filters)
            add(("text", _show(e[1])) if e[0] == "const" else ("out", e))
        elif node[0] == "for":
            add(("for", node[1], fold_expr(node[2], filters), fold(node[3], filters)))
        elif node[0] == "set":
            add(("set", node[1], fold_expr(node[2], filters)))
        elif node[0] == "gen":
            add(("gen", fold(node[1], filters)))
        elif node[0] == "if":
            arms = []
            for test, body in node[1]:
                test = fold_expr(test, filters)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold(body, filters)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                add(("if", arms))
        else:
            add(node)
    return out


def compile_expr(e: tuple, filters: dict[str, Callable]) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":

        def name(env, n=e[1]):
            if n not in env:
                raise TemplateError(f"{n} isn't defined")
            return env[n]

        return name
    if kind == "get":
        inner, key = compile_expr(e[1], filters), compile_expr(e[2], filters)

        def get(env):
            o, k = inner(env), key(env)
            if isinstance(o, dict):
                return o.get(k)
            if isinstance(o, (list, tuple)) and isinstance(k, int):
                return o[k]
            raise TemplateError(f"no {k!r} in a {type(o).__name__}")

        return get
    if kind == "filter":
        f, inner = filters[e[1]], compile_expr(e[2], filters)
        return lambda env: f(inner(env))
    if kind == "not":
        inner = compile_expr(e[1], filters)
        return lambda env: not inner(env)
    if kind == "list":
        items = [compile_expr(x, filters) for x in e[1]]
        return lambda env: [i(env) for i in items]
    if kind in ("and", "or"):
        a, b = compile_expr(e[1], filters), compile_expr(e[2], filters)
        return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))
    o, a, b = e[1], compile_expr(e[2], filters), compile_expr(e[3], filters)
    return lambda env: _apply(o, a(env), b(env))


#: A renderer yields (piece, whether it is to be learnt).
Renderer = Callable[[dict], Iterator[tuple[str, bool]]]


def compile_tree(tree: list, filters: dict[str, Callable], learn: bool = False) -> Renderer:
    steps = [_step(n, filters, learn) for n in tree]

    def run(env):
        for s in steps:
            yield from s(env)

    return run


def _step(node: tuple, filters: dict[str, Callable], learn: bool) -> Renderer:
    if node[0] == "text":
        return lambda env, piece=[(node[1], learn)]: piece
    if node[0] == "out":
        e = compile_expr(node[1], filters)
        return lambda env: [(_show(e(env)), learn)]
    if node[0] == "gen":
        return compile_tree(node[1], filters, True)
    if node[0] == "set":
        e = compile_expr(node[2], filters)

        def assign(env):
            env[node[1]] = e(env)
            return ()

        return assign
    if node[0] == "if":
        arms = [(compile_expr(t, filters), compile_tree(b, filters, learn)) for t, b in node[1]]

        def choose(env):
            for t, b in arms:
                if t(env):
                    return b(env)
            return ()

        return choose
    items, body, var = compile_expr(node[2], filters), compile_tree(node[3], filters, learn), node[1]

    def loop(env):
        ahead = iter(items(env))
        missing = object()
        now, i = next(ahead, missing), 0
        while now is not missing:
            after = next(ahead, missing)
            own = env | {var: now, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": after is missing}}
            yield from body(own)
            now, i = after, i + 1

    return loop


# == the format ==


def escape(text: str | None) -> str:
    return (text or "").replace("\\", "\\\\").replace("### ", "#\\## ").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def role_name(role: str | None) -> str:
    """Known roles by name, others as '=' and the escaped role, in which a colon is escaped as well."""
    return ROLES.get(role or "") or "=" + escape(role).replace(":", "\\:")


def role_of(name: str) -> str:
    return unescape(name[1:]) if name.startswith("=") else _ROLE_OF[name]


FILTERS: dict[str, Callable] = {"escape": escape, "role": role_name, "trim": lambda v: _show(v).strip(), "upper": lambda v: _show(v).upper(), "lower": lambda v: _show(v).lower()}


def compile_template(source: str = TEMPLATE, filters: dict[str, Callable] | None = None) -> Callable[..., Iterator[tuple[str, bool]]]:
    """A function of the template's variables that yields (piece, learn)."""
    known = FILTERS | (filters or {})
    run = compile_tree(fold(parse(source, known), known), known)
    return lambda **variables: run(dict(variables))


def render(messages: Iterable[dict], template: Callable | None = None) -> tuple[str, list[tuple[int, int]]]:
    """The whole text and the spans under the loss mask, in code points."""
    out, spans, at = [], [], 0
    for piece, learn in (template or compile_template())(messages=messages):
        if piece:
            if learn:
                spans.append((at, at + len(piece)))
            out.append(piece)
            at += len(piece)
    return "".join(out), spans


_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)


class Reader:
    """Reads a formatted stream back turn by turn; holds one turn at most."""

    def __init__(self):
        self.held = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.held += piece
        while (end := self.held.find("</turn>\n")) >= 0:
            m = _HEAD.match(self.held)
            if not m or m.end() > end:
                raise ValueError("not a formatted conversation")
            yield role_of(m[1]), unescape(self.held[m.end() : end])
            self.held = self.held[end + 8 :]

    def close(self) -> None:
        if self.held:
            raise ValueError("a turn isn't ended")


class Digest:
    """What the query reports of one conversation, from its formatted stream."""

    def __init__(self):
        self.reader, self.turns, self.loss = Reader(), hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.learnt = ""

    def add(self, piece: str, learn: bool) -> None:
        self.chars += len(piece)
        if learn:
            self.learnt += piece
        else:
            self._learn()
        for role, text in self.reader.feed(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())

    def _learn(self) -> None:
        if self.learnt:
            text = unescape(self.learnt)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
            self.learnt = ""

    def done(self) -> tuple:
        self._learn()
        self.reader.close()
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # sorted on disk if need be, and streamed: a conversation is never held whole
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conv_id, its messages) of sorted rows."""
    from itertools import groupby

    rows = ((c, {"role": r, "text": t}) for b in slices(batches, 512) for c, r, t in zip(*(x.to_pylist() for x in b.columns)))
    for conv, group in groupby(rows, key=lambda r: r[0]):
        yield conv, (m for _, m in group)


def format_conversations(rows: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): the text of each conversation and its spans under the loss mask."""
    ordered = _ordered(rows, conv_col, turn_col, role_col, text_col)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        compiled = compile_template(template)
        for conv, messages in _stream(batches):
            text, spans = render(messages, compiled)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa_id), pa.array([text]), pa.array([[{"start": a, "end": b} for a, b in spans]], span)], names=["conv_id", "formatted", "loss_spans"])

    pa_id = _arrow_type(ordered, "conv_id")
    return ordered.mapInArrow(run, f"conv_id {id_type(ordered, 'conv_id')}, formatted string, loss_spans array<struct<start:long,end:long>>")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def read_back(rows: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Format each conversation and read it back from the output: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars)."""
    ordered = _ordered(rows, conv_col, turn_col, role_col, text_col)
    pa_id = _arrow_type(ordered, "conv_id")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa_id, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        compiled, out = compile_template(template), []
        for conv, messages in _stream(batches):
            digest = Digest()
            for piece, learn in compiled(messages=messages):
                digest.add(piece, learn)
            out.append((conv, *digest.done()))
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return ordered.mapInArrow(run, f"conv_id {id_type(ordered, 'conv_id')}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = r"\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    return read_back(rows.unionByName(probe))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS escaped,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'tool' THEN 'Tool'
      ELSE '=' || replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ':', '\:') END AS shown
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(shown) + length(escaped) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
