"""Chat templates as data, compiled to column expressions.

``compile_template`` turns the template text a tokenizer carries into a function from a
message array (``array<struct<role, content>>``) to its rendering.  The result is a Spark
column: rows are rendered in the JVM, and no template engine runs in a worker.

The subset: text; ``{{ expression }}``; ``{% for message in messages %}`` over the messages
or a tail of them (``messages[1:]``); ``if`` / ``elif`` / ``else``; ``set``; comments;
``-`` at a tag's inner ends.  Expressions: string and integer literals, ``true`` and
``false``, ``message['role']`` or ``message.content``, ``messages[0]``, ``eos_token``,
``bos_token``, ``add_generation_prompt``, ``loop.first``, ``loop.last``, ``loop.index``,
``loop.index0``, ``+``, ``~``, ``%``, ``==``, ``!=``, ``and``, ``or``, ``not``, brackets,
the filter ``trim``.  Anything else is a ``TemplateError`` when the template is compiled.

As the library that renders such templates sets it, the newline after a block tag and the
white space before one that begins a line are dropped (``trim_blocks``).  A null role or
content, or a message that is not there, is an empty text; null messages render to null.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefline.config import DEFAULT_EOS

_QUOTED = r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*\""""
_TAG = re.compile(r"\{#.*?#\}|\{%(?:" + _QUOTED + r"|[^'\"])*?%\}|\{\{(?:" + _QUOTED + r"|[^'\"])*?\}\}", re.S)
_TOKEN = re.compile(r"\s*(" + _QUOTED + r"|\d+|\w+|==|!=|[-+~%|.:()\[\]=])")
# What Python's str.strip drops, which is what the filter trim does.
WHITE = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


class TemplateError(ValueError):
    """The template uses something outside the subset."""


# --------------------------------------------------------------------------- pieces

def _pieces(source: str, trim_blocks: bool) -> list[tuple[str, str]]:
    """("text" | "print" | "block", content) in order, white space control applied."""
    out, at = [], 0
    strip_next = newline_next = False
    for tag in [*_TAG.finditer(source), None]:
        text = segment = source[at:tag.start() if tag else len(source)]
        if "{%" in text or "{{" in text or "{#" in text:
            raise TemplateError(f"a tag is not closed near {text[-40:]!r}")
        if strip_next:
            text = text.lstrip()
        elif newline_next and text.startswith("\n"):
            text = text[1:]
        raw = tag.group() if tag else ""
        if raw[2:3] == "-":
            text = text.rstrip()
        elif trim_blocks and raw[:2] in ("{%", "{#"):
            line = segment.rpartition("\n")[2]
            begins_line = "\n" in segment or at == 0 or source[at - 1] == "\n"
            if begins_line and not line.strip(" \t"):
                text = text[:len(text) - len(line)]
        if text:
            out.append(("text", text))
        if tag:
            kind = {"{%": "block", "{{": "print", "{#": "comment"}[raw[:2]]
            if kind != "comment":
                out.append((kind, raw[2:-2].removeprefix("-").removesuffix("-").strip()))
            strip_next, newline_next = raw[-3] == "-", trim_blocks and kind != "print"
            at = tag.end()
    return out


# --------------------------------------------------------------------------- expressions

class _Expression:
    """One expression read from left to right, with the names of ``scope``."""

    def __init__(self, text: str, scope: dict):
        self.text, self.scope, self.tokens, at = text, scope, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append(m.group(1))
            at = m.end()
        self.i = 0

    def value(self):
        out = self._or()
        if self.i < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.i]!r} in {self.text!r}")
        return out

    def _peek(self, *wanted):
        return self.i < len(self.tokens) and self.tokens[self.i] in wanted

    def _next(self, wanted: str | None = None) -> str:
        if self.i >= len(self.tokens) or (wanted and self.tokens[self.i] != wanted):
            raise TemplateError(f"expected {wanted or 'more'} in {self.text!r}")
        self.i += 1
        return self.tokens[self.i - 1]

    def _left(self, part, operators: dict):
        out = part()
        while self._peek(*operators):
            out = operators[self._next()](out, part())
        return out

    def _or(self):
        return self._left(self._and, {"or": lambda a, b: a | b})

    def _and(self):
        return self._left(self._not, {"and": lambda a, b: a & b})

    def _not(self):
        if self._peek("not"):
            self._next()
            return ~self._not()
        return self._left(self._sum, {"==": lambda a, b: a == b, "!=": lambda a, b: a != b})

    def _sum(self):
        return self._left(self._rest, {"+": F.concat, "~": F.concat})

    def _rest(self):
        return self._left(self._postfix, {"%": lambda a, b: a % b})

    def _postfix(self):
        name, out = self._atom()
        while self._peek("[", ".", "|"):
            mark = self._next()
            if mark == "|":
                if self._next() != "trim":
                    raise TemplateError(f"unknown filter in {self.text!r}")
                out = F.trim(out, F.lit(WHITE))
            elif name == "messages":
                if mark != "[":
                    raise TemplateError(f"messages has no attributes: {self.text!r}")
                start = self._index()
                if self._peek(":"):
                    self._next()
                    out = F.slice(out, start + 1, F.greatest(F.size(out) - start, F.lit(0)))
                else:
                    name, out = "message", F.get(out, F.lit(start))
                self._next("]")
            elif name == "message":
                field = self._next()
                field = field[1:-1] if mark == "[" else field
                if mark == "[":
                    self._next("]")
                if field not in ("role", "content"):
                    raise TemplateError(f"a message has no {field!r}")
                name, out = "text", F.coalesce(out[field], F.lit(""))
            else:
                raise TemplateError(f"{self.text!r} takes a part of something that has none")
        self.kind = name
        return out

    def _index(self) -> int:
        token = self._next()
        if not token.isdigit():
            raise TemplateError(f"only whole numbers are indices: {self.text!r}")
        return int(token)

    def _atom(self):
        token = self._next()
        if token[0] in "'\"":
            return "text", F.lit(ast.literal_eval(token.replace("\n", "\\n")))
        if token.isdigit():
            return "number", F.lit(int(token))
        if token in ("true", "True", "false", "False"):
            return "flag", F.lit(token in ("true", "True"))
        if token == "(":
            out = self._or()
            self._next(")")
            return "text", out
        if token == "loop":
            self._next(".")
            token = f"loop.{self._next()}"
        if token not in self.scope:
            raise TemplateError(f"unknown name {token!r} in {self.text!r}")
        return self.scope[token]


def _value(text: str, scope: dict) -> tuple[str, Column]:
    e = _Expression(text, scope)
    out = e.value()
    return getattr(e, "kind", "text") if len(e.tokens) == 1 or e.tokens[-1] == "]" else "text", out


# --------------------------------------------------------------------------- blocks

class _Template:
    def __init__(self, pieces: list[tuple[str, str]]):
        self.pieces, self.i = pieces, 0

    def until(self, scope: dict, *ends: str) -> tuple[Column, str | None]:
        """The rendering up to a block that begins with one of ``ends``, and that block."""
        parts = []
        while self.i < len(self.pieces):
            kind, content = self.pieces[self.i]
            self.i += 1
            word = content.split(None, 1)[0] if content.strip() else ""
            if kind == "text":
                parts.append(F.lit(content))
            elif kind == "print":
                parts.append(_value(content, scope)[1].cast("string"))
            elif word in ends:
                return self._joined(parts), content
            elif word == "for":
                parts.append(self._for(content, scope))
            elif word == "if":
                parts.append(self._if(content, scope))
            elif word == "set":
                m = re.fullmatch(r"set\s+(\w+)\s*=\s*(.*)", content, re.S)
                if not m:
                    raise TemplateError(f"cannot read {content!r}")
                scope[m.group(1)] = _value(m.group(2), scope)
            else:
                raise TemplateError(f"unknown block {content!r}")
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return self._joined(parts), None

    @staticmethod
    def _joined(parts: list[Column]) -> Column:
        return F.concat(*parts) if parts else F.lit("")

    def _for(self, content: str, scope: dict) -> Column:
        m = re.fullmatch(r"for\s+(\w+)\s+in\s+(.*)", content, re.S)
        if not m or "loop.first" in scope:
            raise TemplateError(f"only a plain loop over messages is known: {content!r}")
        kind, messages = _value(m.group(2), scope)
        if kind != "messages":
            raise TemplateError(f"a loop goes over messages: {content!r}")
        start = self.i

        def body(message, index):
            self.i = start  # the lambda may be built more than once
            inner = dict(scope)
            inner[m.group(1)] = ("message", message)
            inner |= {"loop.first": ("flag", index == 0), "loop.last": ("flag", index == F.size(messages) - 1),
                      "loop.index": ("number", index + 1), "loop.index0": ("number", index)}
            return self.until(inner, "endfor")[0]

        return F.array_join(F.transform(messages, body), "")

    def _if(self, content: str, scope: dict) -> Column:
        branches, inner = [], []
        while True:
            word, _, condition = content.partition(" ")
            test = F.coalesce(_value(condition, scope)[1], F.lit(False)) if word in ("if", "elif") else None
            own = dict(scope)
            text, content = self.until(own, "endif") if test is None else self.until(own, "elif", "else", "endif")
            branches.append((test, text))
            inner.append(own)
            if content == "endif":
                break
        if branches[-1][0] is not None:
            branches.append((None, F.lit("")))
            inner.append(dict(scope))

        def chosen(values):
            out = values[-1]
            for (test, _), v in reversed(list(zip(branches[:-1], values[:-1]))):
                out = F.when(test, v).otherwise(out)
            return out

        for name in {n for own in inner for n in own if own[n] is not scope.get(n)}:
            if not all(name in own for own in inner):
                raise TemplateError(f"{name!r} is not set in every branch")
            scope[name] = (inner[0][name][0], chosen([own[name][1] for own in inner]))
        return chosen([t for _, t in branches])


def compile_template(source: str, eos_token: str = DEFAULT_EOS, bos_token: str = "", add_generation_prompt: bool = False,
                     trim_blocks: bool = True) -> Callable[[Column], Column]:
    """A function from a message array column to the rendered text."""
    pieces = _pieces(source, trim_blocks)

    def render(messages) -> Column:
        column = F.col(messages) if isinstance(messages, str) else messages
        scope = {"messages": ("messages", column), "eos_token": ("text", F.lit(eos_token)), "bos_token": ("text", F.lit(bos_token)),
                 "add_generation_prompt": ("flag", F.lit(add_generation_prompt))}
        text, _ = _Template(pieces).until(scope)
        return F.when(column.isNotNull(), text)

    render(F.array(F.struct(F.lit("user").alias("role"), F.lit("").alias("content"))))  # errors come here, not per query
    return render
