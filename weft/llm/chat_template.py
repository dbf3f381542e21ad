"""A small sandboxed template language for conversations, compiled to Python closures.

``{{ expr }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% generation %} ... {% endgeneration %}`` (what is
written inside is under the loss mask), one ``{% for message in messages %} ... {% endfor %}`` at the top, comments
``{# #}``, ``-`` beside a bracket to strip white space. Expressions know strings, whole numbers, true, false, lists,
``message.role``, ``message.text``, ``and or not in == != < <= > >= ~ +`` and the filters of ``FILTERS``: no
other name, attribute or call exists, so a template ends and reaches nothing outside.

``{% control 'a' 'b' %}`` names the control strings. What comes from a message is escaped where it is written: a
backslash goes after each backslash and after the first character of each control string, so no control string is
left in it; ``unescape`` takes the character after each backslash as it is. ``Template.read`` finds the turns in the text again, by patterns made from the
same tree.

Text before the loop opens a conversation, text after it closes it; both are constant. So each message is
rendered by itself, and a long conversation in pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

ESCAPE = "\\"
FIELDS = ("message.role", "message.text")
FILTERS: dict[str, Callable] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}
OPERATORS: dict[str, Callable] = {
    "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b, "in": lambda a, b: a in b, "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "~": lambda a, b: f"{a}{b}", "+": lambda a, b: a + b
}


class TemplateError(ValueError):
    """The template is not in the language, or its texts could not be told apart again."""


# The syntax tree.


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator or filter on its arguments; ``elements`` makes a list."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, nodes); the last condition may be Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


# Parsing.

_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(==|!=|<=|>=|[<>~+|(),\[\]]))", re.S)
_LEVELS = (("or",), ("and",), ("in", "==", "!=", "<=", ">=", "<", ">"), ("~", "+"))
_ESCAPES = {"n": "\n", "t": "\t"}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        quoted, number, name, sign = m.groups()
        if quoted:
            out.append(("value", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), quoted[1:-1], flags=re.S)))
        else:
            out.append(("value", int(number)) if number else ("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one bracket."""

    def __init__(self, source: str):
        self.left = _tokens(source)

    def next(self, *texts: str) -> str | None:
        if self.left and self.left[0][0] != "value" and self.left[0][1] in texts:
            return self.left.pop(0)[1]
        return None

    def whole(self):
        out = self.level(0)
        if self.left:
            raise TemplateError(f"unexpected {self.left[0][1]!r}")
        return out

    def level(self, k: int):
        if k == len(_LEVELS):
            return self.filtered()
        if k == 2 and self.next("not"):
            return Apply("not", (self.level(2),))
        out = self.level(k + 1)
        while True:
            if k == 2 and [x[1] for x in self.left[:2]] == ["not", "in"]:
                del self.left[:2]
                out = Apply("not", (Apply("in", (out, self.level(k + 1))),))
            elif op := self.next(*_LEVELS[k]):
                out = Apply(op, (out, self.level(k + 1)))
            else:
                return out

    def filtered(self):
        out = self.single()
        while self.next("|"):
            kind, name = self.left.pop(0) if self.left else ("", "nothing")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Apply(name, (out,))
        return out

    def single(self):
        if self.next("("):
            out = self.level(0)
            if not self.next(")"):
                raise TemplateError("a bracket is open")
            return out
        if self.next("["):
            items = []
            while not self.next("]"):
                items.append(self.level(0))
                if not self.next(",") and not (self.left and self.left[0] == ("sign", "]")):
                    raise TemplateError("a list is open")
            return Apply("elements", tuple(items))
        kind, x = self.left.pop(0) if self.left else ("", "the end")
        if kind == "value":
            return Const(x)
        if kind == "name" and x in ("true", "false"):
            return Const(x == "true")
        if kind == "name" and x in FIELDS:
            return Field(x)
        raise TemplateError(f"unexpected {x!r}")


def fold(e):
    """An expression with its constant parts worked out."""
    if not isinstance(e, Apply):
        return e
    args = tuple(fold(a) for a in e.args)
    if e.name in ("and", "or") and isinstance(args[0], Const):
        return args[1] if bool(args[0].value) == (e.name == "and") else args[0]
    if not all(isinstance(a, Const) for a in args):
        return Apply(e.name, args)
    values = [a.value for a in args]
    try:
        return Const(tuple(values) if e.name == "elements" else (FILTERS.get(e.name) or OPERATORS[e.name])(*values))
    except TypeError as x:
        raise TemplateError(f"{e.name}: {x}") from x


def _joined(nodes: list) -> tuple:
    out: list = []
    for n in nodes:
        if isinstance(n, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + n.text)
        elif n != Text(""):
            out.append(n)
    return tuple(out)


class _Parser:
    def __init__(self, source: str):
        self.parts, self.controls, self.strip = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", source, flags=re.S), [], False

    def nodes(self, *ends: str, top: bool = False) -> tuple[list, str, str]:
        """Nodes up to one of the closing statements; that statement and the rest of it."""
        out: list = []
        while self.parts:
            p = self.parts.pop(0)
            if p[:2] not in ("{{", "{%", "{#"):
                p = p.lstrip() if self.strip else p
                self.strip = False
                out.append(Text(p.rstrip() if self.parts and self.parts[0][2:3] == "-" else p))
                continue
            inner, self.strip = p[2:-2].removeprefix("-").removesuffix("-").strip(), p[-3:-2] == "-"
            if p[:2] == "{{":
                e = fold(_Expression(inner).whole())
                out.append(Text(str(e.value)) if isinstance(e, Const) else Out(e))
            elif p[:2] == "{%":
                word, _, rest = inner.partition(" ")
                if word in ends:
                    return out, word, rest
                out += self.statement(word, rest.strip(), top)
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return out, "", ""

    def statement(self, word: str, rest: str, top: bool) -> list:
        if word == "control" and top:
            self.controls += [x for _, x in _tokens(rest)]
            return []
        if word == "generation" and not rest:
            return [Generation(_joined(self.nodes("endgeneration")[0]))]
        if word == "for" and top and rest.split() == ["message", "in", "messages"]:
            return [("for", _joined(self.nodes("endfor")[0]))]
        if word == "if":
            branches, word = [], "elif"
            while word != "endif":
                condition = fold(_Expression(rest).whole()) if word == "elif" else Const(True)
                body, word, rest = self.nodes("elif", "else", "endif") if word == "elif" else self.nodes("endif")
                if condition != Const(False) and not (branches and branches[-1][0] == Const(True)):
                    branches.append((Const(True) if isinstance(condition, Const) and condition.value else condition, _joined(body)))
            branches = [b for b in branches if not isinstance(b[0], Const) or b[0].value]
            return list(branches[0][1]) if branches and branches[0][0] == Const(True) else [If(tuple(branches))] if branches else []
        raise TemplateError(f"unexpected statement {word!r}")


# Closures.


class _Page:
    """What is being written: parts, their length, spans under the loss mask."""

    __slots__ = ("parts", "size", "spans")

    def __init__(self):
        self.parts, self.size, self.spans = [], 0, []

    def put(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)


def _value(e) -> Callable[[str, str], object]:
    if isinstance(e, Const):
        return lambda role, text, v=e.value: v
    if isinstance(e, Field):
        return (lambda role, text: role) if e.name == "message.role" else (lambda role, text: text)
    args = [_value(a) for a in e.args]
    if e.name == "elements":
        return lambda role, text: tuple(a(role, text) for a in args)
    if e.name in ("and", "or"):
        a, b, both = *args, e.name == "and"
        return lambda role, text: b(role, text) if bool(x := a(role, text)) == both else x
    f = FILTERS.get(e.name) or OPERATORS[e.name]
    if len(args) == 1:
        return lambda role, text, a=args[0]: f(a(role, text))
    return lambda role, text, a=args[0], b=args[1]: f(a(role, text), b(role, text))


def _writer(nodes: tuple, escape: Callable[[str], str]) -> Callable[[_Page, str, str], None]:
    def one(n):
        if isinstance(n, Text):
            return lambda page, role, text: page.put(n.text)
        if isinstance(n, Out):
            value = _value(n.value)
            return lambda page, role, text: page.put(escape(str(value(role, text))))
        if isinstance(n, Generation):
            body = _writer(n.body, escape)

            def masked(page, role, text):
                begin = page.size
                body(page, role, text)
                page.spans.append((begin, page.size))

            return masked
        branches = [(_value(c), _writer(b, escape)) for c, b in n.branches]

        def choose(page, role, text):
            for condition, body in branches:
                if condition(role, text):
                    return body(page, role, text)
            return None

        return choose

    steps = [one(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def all_of(page, role, text):
        for step in steps:
            step(page, role, text)

    return all_of


# Reading back.


def _paths(nodes: tuple, roles: tuple[str, ...] | None = None) -> list[tuple[tuple[str, ...] | None, list]]:
    """Every way through the nodes: the roles it is taken for (None: any other) and its literals and fields."""
    ways: list = [(roles, [])]
    for n in nodes:
        if isinstance(n, Text):
            ways = [(r, [*p, n.text]) for r, p in ways]
        elif isinstance(n, Out):
            if not isinstance(n.value, Field):
                raise TemplateError("only a field itself can be read back")
            ways = [(r, [*p, n.value]) for r, p in ways]
        elif isinstance(n, Generation):
            ways = [(r, [*p, *q]) for r, p in ways for _, q in _paths(n.body, r)]
        else:
            ways = [(own or r, [*p, *q]) for r, p in ways for c, body in n.branches for own in [_roles(c)] for _, q in _paths(body, own or r)]
            if n.branches[-1][0] != Const(True):
                raise TemplateError("a role without a branch cannot be read back")
    return ways


def _roles(c) -> tuple[str, ...] | None:
    if c == Const(True):
        return None
    if isinstance(c, Apply) and c.name in ("==", "in") and c.args[0] == Field("message.role") and isinstance(c.args[1], Const):
        return (c.args[1].value,) if c.name == "==" else c.args[1].value
    raise TemplateError("a condition that is no role cannot be read back")


@dataclass
class Template:
    """A compiled template; raises TemplateError if what it writes could not be read back."""

    source: str
    opening: str = field(init=False)
    closing: str = field(init=False)

    def __post_init__(self):
        parser = _Parser(self.source)
        nodes, _, _ = parser.nodes(top=True)
        loops = [k for k, n in enumerate(nodes) if isinstance(n, tuple)]
        if len(loops) != 1 or not all(isinstance(n, Text) for k, n in enumerate(nodes) if k not in loops):
            raise TemplateError("a template is constant text around one loop over messages")
        text = lambda part: "".join(n.text for n in part)
        self.opening, self.closing, self.tree = text(nodes[: loops[0]]), text(nodes[loops[0] + 1 :]), nodes[loops[0]][1]
        self.controls = sorted(set(parser.controls))
        self._check_controls()
        either = "|".join(map(re.escape, self.controls))
        self._escape = re.compile(rf"\\|(?=(?:{either})).", re.S)
        self._write = _writer(self.tree, self.escape)
        self._turn, self._ways = self._reader()

    def _check_controls(self) -> None:
        if not self.controls:
            raise TemplateError("name the control strings")
        for a in self.controls:
            if not isinstance(a, str) or len(a) < 2 or ESCAPE in a:
                raise TemplateError(f"{a!r} is no control string: two characters or more, without backslash")
            for b in self.controls:
                for k in range(1, len(a)):
                    if b.startswith(a[k:]) or a[k:].startswith(b):
                        raise TemplateError(f"control strings {a!r} and {b!r} overlap")

    def _reader(self) -> tuple[re.Pattern, dict]:
        ways, patterns, first = {}, [], []
        shapes: list = []
        for k, (roles, parts) in enumerate(_paths(self.tree)):
            merged: list = []
            for p in parts:
                if isinstance(p, str) and merged and isinstance(merged[-1], str):
                    merged[-1] += p
                else:
                    merged.append(p)
            if merged in shapes and Field("message.role") in merged:  # the branches differ in the mask alone
                continue
            shapes.append(merged)
            if not merged or not isinstance(merged[0], str) or not isinstance(merged[-1], str) or any(isinstance(a, Field) and isinstance(b, Field) for a, b in zip(merged, merged[1:])):
                raise TemplateError("a field needs constant text before and after it")
            if not all(any(c in p for c in self.controls) for p in merged if isinstance(p, str)):
                raise TemplateError("text beside a field needs a control string")
            names, seen = "", set()
            for p in merged:
                if isinstance(p, str):
                    names += re.escape(p)
                else:
                    g = f"{p.name[8:]}{k}"
                    names += f"(?P={g})" if g in seen else f"(?P<{g}>.*?)"
                    seen.add(g)
            if f"text{k}" not in seen or (f"role{k}" not in seen and (roles is None or len(roles) > 1)):
                raise TemplateError("every message must show its text, and its role unless one branch is for it alone")
            first.append(merged[0])
            ways[str(k)] = (None if f"role{k}" in seen else roles[0], f"role{k}", f"text{k}")
            patterns.append(names)
        for a in range(len(first)):
            for b in range(len(first)):
                if a != b and first[a].startswith(first[b]):
                    raise TemplateError(f"turns that begin with {first[b]!r} cannot be told apart")
        if self.closing and any(f.startswith(self.closing) or self.closing.startswith(f) for f in first):
            raise TemplateError("the closing text cannot be told from a turn")
        return re.compile("|".join(patterns), re.S), ways

    def escape(self, s: str) -> str:
        return self._escape.sub(lambda m: m[0] + ESCAPE, s) if ESCAPE in s or any(c in s for c in self.controls) else s

    @staticmethod
    def unescape(s: str) -> str:
        return re.sub(r"\\(.)", r"\1", s, flags=re.S) if ESCAPE in s else s

    def page(self) -> _Page:
        return _Page()

    def write(self, page: _Page, role: str, text: str) -> None:
        """One message, at the end of the page."""
        self._write(page, role, text)

    def format(self, messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """A whole conversation and its spans under the loss mask."""
        page = _Page()
        page.put(self.opening)
        for role, text in messages:
            self.write(page, role, text)
        page.put(self.closing)
        return "".join(page.parts), page.spans

    def read(self, s: str, opened: bool = True, closed: bool = True) -> list[tuple[str, str]]:
        """The messages that ``s`` shows; ``opened`` and ``closed`` tell whether it has the conversation's ends."""
        at, end = len(self.opening) if opened else 0, len(s) - len(self.closing) if closed else len(s)
        if opened and not s.startswith(self.opening) or closed and not s.endswith(self.closing):
            raise TemplateError("the conversation's ends are missing")
        out = []
        while at < end:
            m = self._turn.match(s, at, end)
            if not m:
                raise TemplateError(f"no turn at {at}: {s[at:at + 40]!r}")
            role, role_group, text_group = self._ways[m.lastgroup[4:]]
            out.append((self.unescape(m[role_group]) if role is None else role, self.unescape(m[text_group])))
            at = m.end()
        return out
