"""Syntax of ECMAScript 5 (sloppy mode): tokens by class, automatic semicolons, recursive descent."""

import re

PIECE = re.compile(
    r"""(?P<space>[ \t\v\f ﻿]+)|(?P<line>[\r\n  ]\s*|//[^\r\n  ]*)|(?P<comment>/\*[\s\S]*?\*/)
|(?P<word>(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4})*)
|(?P<text>"(?:[^"\\\r\n]|\\(?:\r\n|[^xu]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}))*"|'(?:[^'\\\r\n]|\\(?:\r\n|[^xu]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}))*')
|(?P<number>(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w$]))
|(?P<sign>=>|===|!==|>>>=|>>=|<<=|>>>|>>|<<|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.()\[\]{}])""",
    re.VERBOSE,
)
PATTERN = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[\w$]*")

#: The words and operators of the language, with a class each; k is a reserved word that has no use yet.
WORDS = {
    "function": "f", "var": "v", "if": "F", "else": "E", "while": "W", "for": "R", "do": "D", "switch": "w", "case": "a", "default": "d",
    "break": "b", "continue": "B", "return": "r", "throw": "H", "try": "Y", "catch": "K", "finally": "L", "with": "M", "new": "n",
    "delete": "u", "void": "u", "typeof": "u", "in": "N", "instanceof": "I", "this": "T", "null": "T", "true": "T", "false": "T", "debugger": "g",
    "class": "k", "const": "k", "enum": "k", "export": "k", "extends": "k", "import": "k", "super": "k", "get": "G", "set": "G",
}
SIGNS = {c: c for c in "?:;,.()[]{}="} | {"=>": "#", "++": "p", "--": "p", "+": "s", "-": "s", "!": "!", "~": "!"}
SIGNS |= dict.fromkeys("=== !== >>> >> << == != <= >= && || * / % & | ^ < >".split(), "o")
SIGNS |= dict.fromkeys(">>>= >>= <<= += -= *= /= %= &= |= ^=".split(), "%")
NAMES = "iGfvFEWRDwadbBrHYKLMnuNITgk"  # any word may name a property


class Bad(Exception):
    pass


#: Lexer states: in a comment or not, and whether the last token ends an operand (a slash after it divides).
STATES = tuple((comment, operand) for comment in (False, True) for operand in (False, True))
OPERAND_ENDS = "iGlT)]}"


def lex(text: str, state: tuple[bool, bool] = (False, False)) -> tuple[tuple[bool, bool], str]:
    """(state at the end, classes) of a chunk of whole lines; a newline stands before a token that a line end precedes, # for what is no token."""
    comment, operand = state
    i, n, out = 0, len(text), []
    if comment:
        i = text.find("*/") + 2
        if i < 2:
            return state, ""
    match = PIECE.match
    while i < n:
        m = match(text, i)
        kind = m.lastgroup if m else None
        if kind == "sign" and text[i] == "/" and not operand and (m2 := PATTERN.match(text, i)):
            m, c = m2, "l"
        elif kind is None or kind == "sign" and text.startswith("/*", i):
            if text.startswith("/*", i):
                return (True, operand), "".join([*out, "\n"])
            return (False, False), "".join([*out, "#"])
        elif kind == "space":
            i = m.end()
            continue
        elif kind == "line" or kind == "comment":
            if kind == "line" or "\n" in m.group():
                out.append("\n")
            i = m.end()
            continue
        elif kind == "word":
            c = WORDS.get(m.group(), "i")
        elif kind == "sign":
            c = SIGNS[m.group()]
        else:
            c = "l"
        out.append(c)
        operand, i = c in OPERAND_ENDS, m.end()
    return (False, operand), "".join(out)


def _either(text: str, comment: bool) -> dict[tuple[bool, bool], tuple[tuple[bool, bool], str]]:
    """The entries of both operand states: they differ only where the first token begins with a slash or there is none."""
    one = lex(text, (comment, False))
    first = one[1].lstrip("\n")[:1]
    if first and first not in "lo%#":
        return {(comment, False): one, (comment, True): one}
    return {(comment, False): one, (comment, True): lex(text, (comment, True))}


def chunk_map(text: str) -> dict[tuple[bool, bool], tuple[tuple[bool, bool], str]]:
    """state before a chunk -> (state after it, its classes)."""
    return _either(text, False) | ({s: (s, "") for s in STATES if s[0]} if "*/" not in text else _either(text, True))


class Script:
    def __init__(self, classes: str):
        """classes: those of a whole text, as lex gives them."""
        lines = [line for line in classes.split("\n")]
        self.breaks = [k == 0 and at > 0 for at, line in enumerate(lines) for k in range(len(line))] + [True, True, True]
        s = "".join(lines)
        self.s, self.n = s + "\n\n\n", len(s)

    def check(self) -> None:
        i = 0
        while i < self.n:
            i = self.statement(i)

    def need(self, i: int, c: str) -> int:
        if self.s[i] not in c:
            raise Bad
        return i + 1

    def end(self, i: int) -> int:
        """A semicolon, or a place where one is inserted."""
        c = self.s[i]
        if c == ";":
            return i + 1
        if c == "}" or i >= self.n or self.breaks[i]:
            return i
        raise Bad

    def block(self, i: int) -> int:
        i = self.need(i, "{")
        while self.s[i] != "}":
            i = self.statement(i)
        return i + 1

    def condition(self, i: int) -> int:
        return self.need(self.expression(self.need(i, "(")), ")")

    def statement(self, i: int) -> int:
        s, c = self.s, self.s[i]
        if c == "{":
            return self.block(i)
        if c == ";":
            return i + 1
        if c == "v":
            return self.end(self.variables(i + 1))
        if c == "f":
            return self.function(i, True)
        if c == "F":
            i = self.statement(self.condition(i + 1))
            return self.statement(i + 1) if s[i] == "E" else i
        if c in "WM":
            return self.statement(self.condition(i + 1))
        if c == "D":
            i = self.condition(self.need(self.statement(i + 1), "W"))
            return i + 1 if s[i] == ";" else i
        if c == "R":
            return self.loop(i + 1)
        if c in "bB":
            i += 1
            if s[i] in "iG" and not self.breaks[i]:
                i += 1
            return self.end(i)
        if c == "r":
            i += 1
            if s[i] not in ";}\n" and not self.breaks[i]:
                i = self.expression(i)
            return self.end(i)
        if c == "H":
            if self.breaks[i + 1]:
                raise Bad
            return self.end(self.expression(i + 1))
        if c == "g":
            return self.end(i + 1)
        if c == "Y":
            i, done = self.block(i + 1), False
            if s[i] == "K":
                i, done = self.block(self.need(self.need(self.need(i + 1, "("), "iG"), ")")), True
            if s[i] == "L":
                i, done = self.block(i + 1), True
            if not done:
                raise Bad
            return i
        if c == "w":
            i = self.need(self.condition(i + 1), "{")
            defaults = 0
            while s[i] != "}":
                if s[i] == "a":
                    i = self.need(self.expression(i + 1), ":")
                else:
                    i = self.need(self.need(i, "d"), ":")
                    defaults += 1
                while s[i] not in "ad}":
                    i = self.statement(i)
            if defaults > 1:
                raise Bad
            return i + 1
        if c in "iG" and s[i + 1] == ":":
            return self.statement(i + 2)
        return self.end(self.expression(i))

    def variables(self, i: int, allow_in: bool = True) -> int:
        while True:
            i = self.need(i, "iG")
            if self.s[i] == "=":
                i = self.assignment(i + 1, allow_in)
            if self.s[i] != ",":
                return i
            i += 1

    def loop(self, i: int) -> int:
        s = self.s
        i = self.need(i, "(")
        if s[i] == "v":
            j = self.variables(i + 1, False)
        else:
            j = i if s[i] == ";" else self.expression(i, False)
        if s[j] == "N" and j > i:
            return self.statement(self.need(self.expression(j + 1), ")"))
        i = self.need(j, ";")
        i = self.need(i if s[i] == ";" else self.expression(i), ";")
        return self.statement(self.need(i if s[i] == ")" else self.expression(i), ")"))

    def function(self, i: int, named: bool = False) -> int:
        i += 1
        if named or self.s[i] in "iG":
            i = self.need(i, "iG")
        return self.signature(i)

    def signature(self, i: int) -> int:
        i = self.need(i, "(")
        if self.s[i] != ")":
            i = self.need(i, "iG")
            while self.s[i] == ",":
                i = self.need(i + 1, "iG")
        return self.block(self.need(i, ")"))

    def expression(self, i: int, allow_in: bool = True, first: tuple[int, bool] | None = None) -> int:
        """first: the end and kind of its first operand, if that is known."""
        i = self.assignment(i, allow_in, first)
        while self.s[i] == ",":
            i = self.assignment(i + 1, allow_in)
        return i

    def assignment(self, i: int, allow_in: bool = True, first: tuple[int, bool] | None = None) -> int:
        s = self.s
        i, place = first or self.unary(i)
        while True:
            c = s[i]
            if c in "=%" and place:
                return self.assignment(i + 1, allow_in)
            if c == "o" or c == "s" or c == "I" or c == "N" and allow_in:
                i, _ = self.unary(i + 1)
                place = False
            elif c == "?":
                return self.assignment(self.need(self.assignment(i + 1), ":"), allow_in)
            else:
                return i

    def unary(self, i: int) -> tuple[int, bool]:
        """(end, whether it may be assigned to)"""
        c = self.s[i]
        if c in "us!":
            return self.unary(i + 1)[0], False
        if c == "p":
            i, place = self.unary(i + 1)
            if not place:
                raise Bad
            return i, False
        i, place = self.postfix(i)
        if self.s[i] == "p" and not self.breaks[i]:
            if not place:
                raise Bad
            return i + 1, False
        return i, place

    def postfix(self, i: int, calls: bool = True) -> tuple[int, bool]:
        s, c = self.s, self.s[i]
        place = False
        if c in "iG":
            i, place = i + 1, True
        elif c in "lT":
            i += 1
        elif c == "(":
            first = self.unary(i + 1)
            place = first[1] and s[first[0]] == ")"
            i = self.need(self.expression(i + 1, True, first), ")")
        elif c == "[":
            i += 1
            while s[i] != "]":
                if s[i] == ",":
                    i += 1
                else:
                    i = self.assignment(i)
                    if s[i] != "]":
                        i = self.need(i, ",")
            i += 1
        elif c == "{":
            i = self.object(i + 1)
        elif c == "f":
            i = self.function(i)
        elif c == "n":
            i, _ = self.postfix(i + 1, False)
            if s[i] == "(":
                i = self.arguments(i)
        else:
            raise Bad
        while True:
            c = s[i]
            if c == ".":
                i, place = self.need(i + 1, NAMES), True
            elif c == "[":
                i, place = self.need(self.expression(i + 1), "]"), True
            elif c == "(" and calls:
                i, place = self.arguments(i), False
            else:
                return i, place

    def arguments(self, i: int) -> int:
        i += 1
        if self.s[i] != ")":
            i = self.assignment(i)
            while self.s[i] == ",":
                i = self.assignment(i + 1)
        return self.need(i, ")")

    def object(self, i: int) -> int:
        s = self.s
        while s[i] != "}":
            if s[i] == "G" and s[i + 1] in NAMES + "l":
                i = self.signature(i + 2)
            else:
                i = self.assignment(self.need(self.need(i, NAMES + "l"), ":"))
            if s[i] != "}":
                i = self.need(i, ",")
        return i + 1


def check(classes: str) -> bool:
    """Whether a text's classes are a program."""
    if "#" in classes:
        return False
    try:
        Script(classes).check()
    except (Bad, IndexError):
        return False
    return True
