"""A lexical reader of one source text: tokens with matched brackets, and the declarations among them.

It is no grammar: it looks at words, brackets and line ends only, so that broken text
still gives what can be told. Every pass is linear in the tokens and none recurses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

LANGUAGES = ("typescript", "typescriptreact", "javascript", "javascriptreact")
_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+')
    |(?P<number>\.?\d(?:[\w.]|(?<=[eE])[+-])*)
    |(?P<name>\#?[^\W\d][\w$]*|\#?\$[\w$]*)
    |(?P<mark>=>|\?\.(?!\d)|\.\.\.|[=!]==?|&&|\|\||\?\?|.)""",
    re.VERBOSE | re.DOTALL,
)
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*+", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*")
_WORDS_BEFORE_VALUES = frozenset("return typeof case do else in of instanceof new delete void throw yield await default extends".split())
_WORDS_AFTER_VALUES = frozenset("instanceof in as satisfies of extends implements is".split())
_PAIRS = {")": "(", "]": "[", "}": "{"}
_MODIFIERS = frozenset("public private protected static readonly abstract override async get set declare accessor".split())
#: Words that start a statement wherever they stand, unless they follow a dot.
_STARTS = frozenset("const let var return export if for while switch try".split())
_LEADS = frozenset("export default declare abstract async".split())


class Declaration(NamedTuple):
    """Tokens ``first`` to ``last``; of a method ``opening`` is its parenthesis, of a class its brace, of a binding the value's first token."""

    kind: str
    name: str | None
    exported: bool
    first: int
    last: int
    opening: int
    level: bool = True


def byte_offsets(text: str) -> np.ndarray | range:
    """The byte in UTF-8 at which each character starts, and the end."""
    if text.isascii():
        return range(len(text) + 1)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])


class Source:
    def __init__(self, text: str):
        self.text = text
        self.kind: list[str] = []
        self.word: list[str] = []
        self.span: list[tuple[int, int]] = []
        self.fresh: list[bool] = []
        self._read()
        n, words = len(self.word), self.word
        self.pair, self.inside, opened = [n] * n, [-1] * n, []
        for i, (kind, word) in enumerate(zip(self.kind, words, strict=True)):
            mark = kind == "mark"
            if mark and opened and word in _PAIRS:
                wanted = _PAIRS[word]
                if words[opened[-1]] == wanted or any(words[o] == wanted for o in opened[-64:]):
                    while words[opened[-1]] != wanted:  # an opening bracket without an end ends here
                        self.pair[opened.pop()] = i
                    self.pair[i] = opened.pop()
                    self.pair[self.pair[i]] = i
            if opened:
                self.inside[i] = opened[-1]
            if mark and word in "([{":
                opened.append(i)
        self.body: dict[int, str] = {}

    def _add(self, kind: str, start: int, end: int, fresh: bool = False) -> None:
        self.kind.append(kind)
        self.word.append(self.text[start:end])
        self.span.append((start, end))
        self.fresh.append(fresh)

    def _read(self) -> None:
        at, braces, text, size, match, fresh = 0, [], self.text, len(self.text), _TOKEN.match, True
        kinds, words, spans, lines = self.kind.append, self.word.append, self.span.append, self.fresh.append
        while at < size:
            found = match(text, at)
            kind, end = found.lastgroup, found.end()
            if kind == "space":
                fresh = fresh or "\n" in found[0]
                at = end
                continue
            if kind == "mark" and text[at] in "/`{}":
                char = text[at]
                if char == "/" and not (self.word and self.ends_value(len(self.word) - 1)):
                    regex = _REGEX.match(text, at)
                    kind, end = ("regex", regex.end()) if regex else (kind, end)
                elif char == "`" or (char == "}" and braces and braces[-1]):
                    if char == "}":
                        braces.pop()
                        self._add("mark", at, end, fresh)
                    stop = _TEMPLATE.match(text, end).end()
                    self._add("template", at if char == "`" else end, min(size, stop + 1) if text[stop : stop + 2] != "${" else stop, fresh and char == "`")
                    fresh, at = False, stop + 1
                    if text[stop : stop + 2] == "${":
                        braces.append(True)
                        self._add("mark", stop + 1, stop + 2)
                        at = stop + 2
                    continue
                elif char == "{":
                    braces.append(False)
                elif braces and char == "}":
                    braces.pop()
            kinds(kind)
            words(text[at:end])
            spans((at, end))
            lines(fresh)
            fresh, at = False, end

    def __len__(self) -> int:
        return len(self.word)

    def at(self, i: int) -> str:
        return self.word[i] if 0 <= i < len(self.word) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.word) and self.kind[i] == "name"

    def ends_value(self, i: int) -> bool:
        return (self.word[i] not in _WORDS_BEFORE_VALUES) if self.kind[i] == "name" else (self.kind[i] != "mark" or self.word[i] in ")]}")

    def breaks(self, i: int) -> bool:
        """Whether a statement ends before token i because a line does."""
        return self.fresh[i] and i > 0 and self.ends_value(i - 1) and not (self.kind[i] == "template" or self.word[i] in _WORDS_AFTER_VALUES or (self.kind[i] == "mark" and self.word[i] not in "@{"))

    def skip_angles(self, i: int, stop: int) -> int:
        """The token after the type parameters that start at i."""
        depth = 0
        while i < stop:
            word = self.word[i]
            depth += (word == "<") - (word == ">")
            if word in "([{" and self.kind[i] == "mark":
                i = min(self.pair[i], stop)
            i += 1
            if depth <= 0 or word == ";":
                break
        return min(i, stop)

    def until(self, i: int, stop: int, ends: str, angles: bool = False) -> int:
        """The first token from i on, outside of brackets, that is one of ``ends`` or starts a new statement."""
        first = i
        while i < stop:
            mark = self.kind[i] == "mark"
            if (mark and self.word[i] in ends) or (i > first and (self.breaks(i) or (self.word[i] in _STARTS and not mark and self.word[i - 1] not in (".", "?.")))):
                return i
            if mark and self.word[i] == "<" and angles:
                i = self.skip_angles(i, stop)
            else:
                i = self.pair[i] + 1 if mark and self.word[i] in "([{" else i + 1
        return min(i, stop)

    def items(self, opening: int) -> list[tuple[int, int]]:
        """Token ranges between the commas of a bracket."""
        out, stop, at = [], min(self.pair[opening], len(self)), opening + 1
        start = at
        while at < stop:
            if self.kind[at] == "mark" and self.word[at] == ",":
                out.append((start, at))
                start = at = at + 1
            else:
                at = self.pair[at] + 1 if self.kind[at] == "mark" and self.word[at] in "([{" else at + 1
        return [(a, b) for a, b in [*out, (start, stop)] if a < b]

    def parameters(self, opening: int) -> list[tuple[int, int]]:
        """As ``items``, but commas within type arguments do not part."""
        out: list[tuple[int, int]] = []
        depth = 0
        for a, b in self.items(opening):
            out = [*out[:-1], (out[-1][0], b)] if depth > 0 else [*out, (a, b)]
            depth += self.word[a:b].count("<") - self.word[a:b].count(">")
        return out

    def decorator_end(self, i: int) -> int:
        """The token after the decorator at i."""
        i += 1
        while self.is_name(i) and self.at(i + 1) == ".":
            i += 2
        return min(len(self), self.pair[i + 1] + 1 if self.at(i + 1) == "(" else i + 1)

    def decorators_before(self, i: int) -> int:
        """The first token of the decorators that end right before i."""
        while True:
            j = self.pair[i - 1] - 1 if self.at(i - 1) == ")" else i - 1
            while self.is_name(j) and self.at(j - 1) == "." and self.is_name(j - 2):
                j -= 2
            if not (self.is_name(j) and self.at(j - 1) == "@" and self.decorator_end(j - 1) == i):
                return i
            i = j - 1

    def _heading(self, i: int) -> tuple[bool, bool, int] | None:
        """(exported, at statement level, first token) of a declaration whose keyword is i; None within an expression."""
        first = i
        while self.at(first - 1) in _LEADS and self.kind[first - 1] == "name":
            first -= 1
        own = next((k for k in range(first, i) if self.word[k] in ("abstract", "async")), i)
        marked = self.decorators_before(first)
        before = marked - 1
        fine = before < 0 or marked < first or self.word[before] in (";", "{", "}", ")") or self.fresh[first] and self.ends_value(before) or self.word[before] == "else"
        exported = "export" in self.word[first:i]
        return (exported, self.body.get(self.inside[i], "") == "module" or self.inside[i] < 0, own if exported or self.decorators_before(own) == own else self.decorators_before(own)) if fine else None

    def declarations(self) -> Iterator[Declaration]:
        """Classes, interfaces, types, enums, namespaces, functions, bindings and members, in order of their first keyword."""
        n = len(self)
        for i in range(n):
            if self.kind[i] != "name" or self.at(i - 1) in (".", "?."):
                continue
            word, named = self.word[i], self.is_name(i + 1)
            if word in ("class", "interface", "enum") and named and (found := self._heading(i - (word == "enum" and self.at(i - 1) == "const"))) and self.at(i + 1) not in ("extends", "implements"):
                brace = i + 1
                while brace < n and self.word[brace] != "{":
                    brace = self.skip_angles(brace, n) if self.word[brace] == "<" else (self.pair[brace] if self.word[brace] in "([" else brace) + 1
                exported, level, first = found
                if word == "enum" and self.at(i - 1) == "const":
                    first = i - 1
                yield Declaration(word, self.word[i + 1], exported, first, min(self.pair[brace], n - 1) if brace < n else n - 1, brace, level)
                if brace < n and word != "enum":
                    self.body[brace] = word
                    yield from self._members(brace)
            elif word in ("namespace", "module") and (named or (i + 1 < n and self.kind[i + 1] == "string")) and not self.fresh[i + 1] and (found := self._heading(i)):
                brace = next((k for k in range(i + 2, min(n, i + 40)) if self.word[k] == "{" or not (self.is_name(k) or self.word[k] == ".")), n)
                if self.at(brace) == "{":
                    self.body[brace] = "module"
                    name = "".join(self.word[i + 1 : brace])
                    yield Declaration(word, name[1:-1] if name[0] in "'\"" else name, found[0], i, min(self.pair[brace], n - 1), brace, found[1])
            elif word == "type" and named and not self.fresh[i + 1] and (found := self._heading(i)):
                equals = self.skip_angles(i + 2, n) if self.at(i + 2) == "<" else i + 2
                if self.at(equals) == "=":
                    end = self.until(equals + 1, n, ";}", True)
                    yield Declaration("type_alias", self.word[i + 1], found[0], i, end if self.at(end) == ";" else end - 1, equals, found[1])
            elif word == "function" and (found := self._heading(i)):
                name = i + 2 if self.at(i + 1) == "*" else i + 1
                paren = self.skip_angles(name + 1, n) if self.at(name + 1) == "<" else name + 1
                if self.is_name(name) and self.at(paren) == "(":
                    yield Declaration("function", self.word[name], found[0], found[2], self._body_end(paren, n), paren, found[1])
            elif word in ("const", "let", "var") and self.at(i + 1) != "enum" and self.at(self.inside[i]) != "(":
                yield from self._bindings(i, n)

    def _body_end(self, paren: int, stop: int) -> int:
        """The last token of a function whose parameters open at ``paren``: its body's brace, or the end of its signature."""
        i = min(self.pair[paren], stop - 1) + 1
        if self.at(i) == ":":
            i += 1
            while i < stop and not self.breaks(i) and self.word[i] not in (";", "}", ","):
                if self.word[i] == "{" and self.ends_value(i - 1):
                    break
                if self.word[i] == "{" and self.word[i - 1] == ">":
                    break
                i = self.skip_angles(i, stop) if self.word[i] == "<" else (self.pair[i] if self.word[i] in "([{" else i) + 1
        i = min(i, stop)
        if self.at(i) == "{" and i < stop:
            self.body[i] = "function"
            return min(self.pair[i], stop - 1)
        return i if self.at(i) == ";" and i < stop else i - 1

    def _members(self, brace: int) -> Iterator[Declaration]:
        stop, i, typed = min(self.pair[brace], len(self)), brace + 1, self.body[brace] == "interface"
        while i < stop:
            if self.word[i] in (";", ","):
                i += 1
                continue
            marked = i
            while i < stop and self.word[i] == "@":
                i = self.decorator_end(i)
            first = i
            while i + 1 < stop and self.word[i] in _MODIFIERS and self.word[i + 1] not in ("(", ":", "=", ";", "?", "!", ",", "<") and not (self.word[i + 1] == "{"):
                i += 1
            i += i < stop and self.word[i] == "*"
            if i >= stop:
                return
            name = self.word[i] if self.kind[i] == "name" else None
            after = self.pair[i] + 1 if self.word[i] in ("[", "{") and self.kind[i] == "mark" else i + 1
            if self.word[i] == "static" and self.at(after) == "{":
                i = min(self.pair[after], stop) + 1
                continue
            after += self.at(after) in ("?", "!")
            paren = self.skip_angles(after, stop) if self.at(after) == "<" else after
            if self.at(paren) == "(" and paren < stop:
                last = self._body_end(paren, stop)
                if name:
                    yield Declaration("constructor" if name == "constructor" else "method", name, False, first, last - (self.word[last] == ";"), paren, False)
            else:
                last = max(i, self.until(after, stop, ";,", True) if typed else self.until(after, stop, ";", False)) - 1
                last = max(last, i)
                if name:
                    yield Declaration("property", name, False, marked, last, after, False)
            i = max(i, last) + 1

    def _bindings(self, i: int, stop: int) -> Iterator[Declaration]:
        lead = i
        while self.at(lead - 1) in ("export", "declare"):
            lead -= 1
        inside = self.inside[i]
        level = inside < 0 or self.body.get(inside) == "module"
        stop = min(stop, self.pair[inside]) if inside >= 0 else stop
        exported, at = self.at(lead) == "export", i + 1
        while at < stop:
            name = self.word[at] if self.kind[at] == "name" else None
            end = after = self.pair[at] + 1 if self.word[at] in ("{", "[") and self.kind[at] == "mark" else at + 1
            after += self.at(after) == "!"
            if self.at(after) == ":" and after < stop:
                after = end = self.until(after + 1, stop, "=;,", True)
            value = stop
            if self.at(after) == "=" and after < stop:
                value = after + 1
                end = self.until(value, stop, ";,")
            if name:
                kind = "function" if value < stop and self.handler(value, end) else ("constant" if self.word[i] == "const" else "variable")
                yield Declaration(kind, name, exported, at, max(at, end - 1), value, level)
            if self.at(end) != "," or end >= stop:
                return
            at = end + 1

    def handler(self, a: int, b: int) -> tuple[int] | None:
        """(its parenthesis or -1,) if the tokens a to b are an arrow function or a function expression."""
        a += self.at(a) == "async" and a + 1 < b
        if self.at(a) == "function":
            while a < b and self.word[a] != "(":
                a += 1
            return (a,) if a < b and self.at(self.pair[a] + 1) in ("{", ":") else None
        if self.is_name(a) and self.at(a + 1) == "=>" and a + 1 < b:
            return (-1,)
        a = self.skip_angles(a, b) if self.at(a) == "<" else a
        if self.at(a) != "(" or self.pair[a] >= b:
            return None
        i = self.pair[a] + 1
        if self.at(i) == ":":
            while i < b and self.word[i] != "=>":
                i = (self.pair[i] if self.word[i] in "([{" and self.kind[i] == "mark" else i) + 1
        return (a,) if i < b and self.at(i) == "=>" else None


def scan_symbols(language: str, text: str) -> list[dict]:
    """Declarations with kind, name, exported and byte range; bindings that hold no function count only outside of functions."""
    if language not in LANGUAGES:
        return []
    source = Source(text)
    byte, out = byte_offsets(text), []
    for d in source.declarations():
        if d.kind in ("constant", "variable") and not d.level:
            continue
        out.append({"kind": d.kind, "name": d.name, "exported": d.exported, "start_byte": int(byte[source.span[d.first][0]]), "end_byte": int(byte[source.span[min(d.last, len(source) - 1)][1]])})
    return out
