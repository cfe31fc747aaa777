"""A template language for conversations: parsed to a syntax tree, constants folded, compiled to closures.

    text                          as it is
    {{ expression }}              the value as text
    {% for x in list %} ... {% endfor %}       with loop.first, loop.last, loop.index0
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}   what a model is trained to say: under the loss mask
    {# comment #}                 nothing; a dash inside a mark ({%- -%}) trims white space beside it

Expressions: strings, integers, true, false, none, names, ``a.field``, ``a[0]``, ``not``, ``and``, ``or``,
``==  !=  <  <=  >  >=  in``, ``+`` (numbers), ``~`` (joins texts), ``x | filter``.

The language is closed: a field is a key of a mapping, never an attribute; there are no calls but the
filters given to ``compile_template``; the only loop is over a list that is there. So a template cannot
reach Python.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field


class TemplateError(ValueError):
    """The template cannot be parsed, or uses what the language does not have."""


# --- syntax tree ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    key: object


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing -------------------------------------------------------------------------------------

#: What a mark holds: strings are passed over whole, so that one may hold the end of a mark.
_HELD = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|.)*?"""
_MARK = re.compile(r"(\{\{-?" + _HELD + r"-?\}\}|\{%-?" + _HELD + r"-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)"""
                    r"""|(?P<op>==|!=|<=|>=|[<>+~|().\[\]=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def accept(self, *values: str):
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.accept(value):
            raise TemplateError(f"expected {value!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def whole(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.accept("or"):
            out = Binary("or", out, self.both())
        return out

    def both(self):
        out = self.negation()
        while self.accept("and"):
            out = Binary("and", out, self.negation())
        return out

    def negation(self):
        return Not(self.negation()) if self.accept("not") else self.comparison()

    def comparison(self):
        out = self.sum()
        while op := self.accept("==", "!=", "<", "<=", ">", ">=", "in"):
            out = Binary(op, out, self.sum())
        return out

    def sum(self):
        out = self.filtered()
        while op := self.accept("+", "~"):
            out = Binary(op, out, self.filtered())
        return out

    def filtered(self):
        out = self.value()
        while self.accept("|"):
            out = Filter(out, self.name())
        return out

    def value(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            out = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "int":
            out = Const(int(value))
        elif kind == "name" and value not in ("and", "or", "not", "in"):
            out = Const(_WORDS[value]) if value in _WORDS else Name(value)
        elif value == "(":
            out = self.either()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while op := self.accept(".", "["):
            if op == ".":
                out = Field(out, Const(self.name()))
            else:
                out = Field(out, self.either())
                self.need("]")
        return out


class _Parser:
    def __init__(self, source: str):
        parts = _MARK.split(source)
        for i in range(1, len(parts), 2):  # marks are at odd places
            if parts[i][2] == "-":
                parts[i - 1] = parts[i - 1].rstrip()
            if parts[i][-3] == "-" and len(parts[i]) > 5:
                parts[i + 1] = parts[i + 1].lstrip()
        self.parts, self.at = parts, 0

    def block(self, *ends: str) -> tuple[tuple, str, str]:
        """Nodes up to a tag of ``ends``; that tag and what stands behind its name."""
        nodes: list = []
        while self.at < len(self.parts):
            part, mark = self.parts[self.at], self.at % 2
            self.at += 1
            if not mark:
                if part:
                    nodes.append(Text(part))
            elif part.startswith("{{"):
                nodes.append(Output(_Expression(part[2:-2].strip("-")).whole()))
            elif part.startswith("{%"):
                tag, _, rest = part[2:-2].strip("-").strip().partition(" ")
                if tag in ends:
                    return tuple(nodes), tag, rest
                nodes.append(self.tag(tag, rest))
        if ends:
            raise TemplateError(f"missing {ends[-1]!r}")
        return tuple(nodes), "", ""

    def tag(self, tag: str, rest: str):
        if tag == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            over = e.whole()
            return For(name, over, self.block("endfor")[0])
        if tag == "if":
            return self.branches(rest)
        if tag == "set":
            e = _Expression(rest)
            name = e.name()
            e.need("=")
            return Set(name, e.whole())
        if tag == "generation":
            return Generation(self.block("endgeneration")[0])
        raise TemplateError(f"unknown tag {tag!r}")

    def branches(self, test: str):
        then, end, rest = self.block("elif", "else", "endif")
        other: tuple = ()
        if end == "elif":
            other = (self.branches(rest),)
        elif end == "else":
            other = self.block("endif")[0]
        return If(_Expression(test).whole(), then, other)


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of nodes."""
    return _Parser(source).block()[0]


# --- values --------------------------------------------------------------------------------------

def _shown(value) -> str:
    if value is None:
        return ""
    return str(value).lower() if isinstance(value, bool) else str(value)


def _field(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and key < len(of):
        return of[key]
    return None


_OPERATORS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda a, b: a in b, "+": operator.add, "~": lambda a, b: _shown(a) + _shown(b),
}


# --- folding -------------------------------------------------------------------------------------

def fold(node, filters: dict[str, Callable]):
    """``node`` (or a tuple of nodes) with every constant part computed, constant branches chosen and
    neighbouring texts joined."""
    if isinstance(node, tuple):
        return _joined([x for n in node for x in _spread(fold(n, filters))])
    if isinstance(node, Field):
        of, key = fold(node.of, filters), fold(node.key, filters)
        return Const(_field(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Field(of, key)
    if isinstance(node, Filter):
        of = fold(node.of, filters)
        return Const(filters[node.name](_shown(of.value))) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Not):
        of = fold(node.of, filters)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(node, Binary):
        left, right = fold(node.left, filters), fold(node.right, filters)
        if node.op in ("and", "or"):
            if isinstance(left, Const):
                return right if bool(left.value) == (node.op == "and") else left
        elif isinstance(left, Const) and isinstance(right, Const):
            return Const(_OPERATORS[node.op](left.value, right.value))
        return Binary(node.op, left, right)
    if isinstance(node, Output):
        value = fold(node.value, filters)
        return Text(_shown(value.value)) if isinstance(value, Const) else Output(value)
    if isinstance(node, If):
        test = fold(node.test, filters)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, filters)
        return If(test, fold(node.then, filters), fold(node.other, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


def _spread(node) -> tuple:
    return node if isinstance(node, tuple) else (node,)


def _joined(nodes: list) -> tuple:
    out: list = []
    for n in nodes:
        if isinstance(n, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + n.text)
        elif not (isinstance(n, Text) and not n.text):
            out.append(n)
    return tuple(out)


# --- closures ------------------------------------------------------------------------------------

@dataclass
class Rendered:
    """What a template says: its text in parts, and where the loss mask lies (code points)."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def say(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def _value(node, filters: dict[str, Callable]) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, k=node.name: env.get(k)
    if isinstance(node, Field):
        of, key = _value(node.of, filters), _value(node.key, filters)
        return lambda env: _field(of(env), key(env))
    if isinstance(node, Filter):
        of, call = _value(node.of, filters), filters[node.name]
        return lambda env: call(_shown(of(env)))
    if isinstance(node, Not):
        of = _value(node.of, filters)
        return lambda env: not of(env)
    left, right = _value(node.left, filters), _value(node.right, filters)
    if node.op == "and":
        return lambda env: left(env) and right(env)
    if node.op == "or":
        return lambda env: left(env) or right(env)
    call = _OPERATORS[node.op]
    return lambda env: call(left(env), right(env))


def _closure(node, filters: dict[str, Callable]) -> Callable[[dict, Rendered], None]:
    if isinstance(node, tuple):
        steps = [_closure(n, filters) for n in node]

        def run(env: dict, out: Rendered) -> None:
            for step in steps:
                step(env, out)

        return run
    if isinstance(node, Text):
        return lambda env, out, t=node.text: out.say(t)
    if isinstance(node, Output):
        value = _value(node.value, filters)
        return lambda env, out: out.say(_shown(value(env)))
    if isinstance(node, Set):
        value = _value(node.value, filters)
        return lambda env, out, k=node.name: env.__setitem__(k, value(env))
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _closure(node.then, filters), _closure(node.other, filters)
        return lambda env, out: (then if test(env) else other)(env, out)
    if isinstance(node, Generation):
        body = _closure(node.body, filters)

        def generate(env: dict, out: Rendered) -> None:
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))

        return generate
    over, body = _value(node.over, filters), _closure(node.body, filters)

    def loop(env: dict, out: Rendered) -> None:
        items = over(env) or ()
        last = len(items) - 1
        for i, item in enumerate(items):
            env[node.name] = item
            env["loop"] = {"index0": i, "first": i == 0, "last": i == last}
            body(env, out)

    return loop


def _filters_used(node) -> set[str]:
    if isinstance(node, tuple):
        return set().union(*map(_filters_used, node)) if node else set()
    own = {node.name} if isinstance(node, Filter) else set()
    return own.union(*(_filters_used(v) for v in getattr(node, "__dict__", {}).values() if hasattr(v, "__dict__") or isinstance(v, tuple)))


def compile_template(source: str, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], Rendered]:
    """A function from the variables to what the template says about them."""
    tree = parse(source)
    if unknown := _filters_used(tree) - filters.keys():
        raise TemplateError(f"unknown filters: {', '.join(sorted(unknown))}")
    run = _closure(fold(tree, filters), filters)

    def render(env: dict) -> Rendered:
        out = Rendered()
        run(dict(env), out)
        return out

    return render
