"""Syntax of Java 7: a lexer that maps each token to one character, and local grammars over balanced slices.

Everything is a function of the slice's token classes, of which there are few in any code base, so verdicts on
expressions, statements and headers are kept and most slices cost one look-up.
"""

import re

TOKEN = re.compile(
    r"""\s*([^\W\d][\w$]*|[.][.][.]|[.](?!\d)|[()\[\]{};,]
|//[^\n\r]*|/\*(?:[\s\S]*?\*/|[\s\S]*)
|"(?:[^"\\\n\r]|\\[btnfru"'\\0-7])*"|'(?:[^'\\\n\r]|\\(?:[btnfr"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))'
|0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9]+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?
|==|!=|<=|>>>=|>>=|>=|&&|\|\||<<=|<<|\+\+|--|[-+*/%&|^]=|(?:[$]|\\u+[0-9a-fA-F]{4})(?:[\w$]|\\u+[0-9a-fA-F]{4})*
|\S)""",
    re.VERBOSE,
)

#: The reserved words and operators of the language, and the class character of each.
WORDS = {
    "boolean": "t", "byte": "t", "char": "t", "short": "t", "int": "t", "long": "t", "float": "t", "double": "t", "void": "v",
    "public": "m", "protected": "m", "private": "m", "abstract": "m", "native": "m", "transient": "m", "volatile": "m", "strictfp": "m",
    "static": "S", "final": "f", "synchronized": "y", "default": "d", "class": "c", "interface": "C", "enum": "e", "extends": "x",
    "implements": "X", "throws": "h", "package": "P", "import": "M", "this": "T", "super": "U", "new": "n", "instanceof": "I",
    "if": "F", "else": "E", "while": "W", "for": "R", "do": "D", "switch": "w", "case": "a", "break": "b", "continue": "B",
    "return": "r", "throw": "H", "try": "Y", "catch": "K", "finally": "L", "assert": "A", "goto": "#", "const": "#",
    "true": "l", "false": "l", "null": "l",
    "=": "=", "++": "p", "--": "p", "+": "s", "-": "s", "!": "u", "~": "u", "*": "*", "<": "<", ">": ">", "&": "&", "|": "|",
    "?": "?", ":": ":", ",": ",", ";": ";", ".": ".", "...": "z", "@": "@", "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}",
}
WORDS |= dict.fromkeys(["/", "%", "^", "==", "!=", "<=", ">=", "&&", "||", "<<"], "o")
WORDS |= dict.fromkeys(["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="], "%")

CLOSE = {"(": ")", "[": "]", "{": "}"}
BRACKETS = re.compile(r"[()\[\]{}]")
MODIFIERS = "mSfyd@"
#: Verdicts are kept for shorter slices only.
KEPT = 300
#: Levels of bodies reduced at once; deeper ones are left to what follows.
PASSES = 16
#: A body that can only be a block, by what stands before it (a method's head or a statement's), with at most empty bodies inside.
BODY = re.compile(
    r"""((?:[EDYL]|[FWRyK]\((?:[^(){}]|\((?:[^(){}]|\((?:[^(){}]|\([^(){}]*+\))*+\))*+\))*+\)
|(?<![@.])[tvi\]>]i\([^(){}]*+\)(?:\[\])*+(?:h[i.,<>]++)?))\{((?:[^{}]|\{\})++)\}""",
    re.VERBOSE,
)


class Bad(Exception):
    pass


class Classes(dict):
    """token -> class character; comments vanish; emptied when large."""

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
        c = token[0]
        if token in WORDS:
            out = WORDS[token]
        elif c.isalpha() or c in "_$\\" and (c != "\\" or len(token) > 1):
            out = "i"
        elif c.isdigit() or c == "." and len(token) > 1:
            out = "l" if not token.endswith("_") and token not in ("0x", "0X") else "#"
        elif c in "\"'" and len(token) > 1:
            out = "l"
        elif token.startswith("//"):
            out = ""
        elif token.startswith("/*"):
            out = "" if token.endswith("*/") and len(token) > 3 else "\x00"
        elif c == "\x1a":
            out = ""
        else:
            out = "#"
        if len(token) < 60:
            self[token] = out
        return out


NORMAL, COMMENT = 0, 1
STATES = (NORMAL, COMMENT)


def lex(text: str, classes: Classes, state: int = NORMAL) -> tuple[int, str]:
    """(state at the end, classes) of a chunk of whole lines that starts in `state`."""
    if state == COMMENT:
        end = text.find("*/")
        if end < 0:
            return COMMENT, ""
        text = text[end + 2 :]
    out = "".join(map(classes.__getitem__, TOKEN.findall(text)))
    return (COMMENT, out[:-1]) if out.endswith("\x00") else (NORMAL, out)


def chunk_map(text: str, classes: Classes) -> dict[int, tuple[int, str]]:
    """state before a chunk -> (state after it, its classes).

    What follows the first end of a comment is lexed once for both states, if the normal state is in that comment too.
    """
    end = text.find("*/") + 2
    if end < 2:
        return {NORMAL: lex(text, classes), COMMENT: (COMMENT, "")}
    after = lex(text[end:], classes)
    tokens = TOKEN.findall(text[:end])
    if tokens and tokens[-1].startswith("/*") and tokens[-1].endswith("*/") and len(tokens[-1]) > 3:
        return {NORMAL: (after[0], "".join(map(classes.__getitem__, tokens)) + after[1]), COMMENT: after}
    return {NORMAL: lex(text, classes), COMMENT: after}


def matching(s: str) -> dict[int, int]:
    """Place of each bracket's closing bracket; Bad if they do not pair."""
    stack, out = [], {}
    for m in BRACKETS.finditer(s):
        c = m.group()
        if c in "([{":
            stack.append(m.start())
        else:
            if not stack or CLOSE[s[stack[-1]]] != c:
                raise Bad
            out[stack.pop()] = m.start()
    if stack:
        raise Bad
    return out


class Grammar:
    """Verdicts are kept in bounded sets shared by all files of a worker."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self.good_expressions: dict[str, str] = {}
        self.good_statements: set[str] = set()
        self.good_headers: dict[str, str] = {}
        self.good_blocks: set[str] = set()
        self.s, self.match = "\n", {}

    def check(self, s: str) -> bool:
        """Whether a file's classes are a compilation unit."""
        if "#" in s or "\x00" in s:
            return False
        for kept in (self.good_expressions, self.good_statements, self.good_headers, self.good_blocks):
            if len(kept) > self.most:
                kept.clear()
        self.s = s + "\n"
        try:
            self.match = matching(s)
            self.unit(0, len(s))
        except (Bad, IndexError):
            return False
        return True

    def local(self, body: str) -> bool:
        """Whether the classes between two braces are a sequence of statements."""
        if body in self.good_blocks:
            return True
        if "#" in body or "\x00" in body:
            return False
        outer = self.s, self.match
        self.s = body + "\n"
        try:
            self.match = matching(body)
            self.block(0, len(body))
        except (Bad, IndexError):
            return False
        finally:
            self.s, self.match = outer
        if len(body) < KEPT:
            self.good_blocks.add(body)
        return True

    def reduced(self, s: str) -> str:
        """Classes with the balanced bodies of methods and controlled statements judged on the spot: a sound one becomes {}, another #.

        Both stand for themselves in all that follows, so the reduction of a text is that of its reduced parts in a row.
        """
        for _ in range(PASSES):
            before, s = s, BODY.sub(lambda m: m.group(1) + ("{}" if self.local(m.group(2)) else "#"), s)
            if s == before:
                break
        return s

    # --- names and types

    def need(self, i: int, c: str) -> int:
        if self.s[i] != c:
            raise Bad
        return i + 1

    def qualified(self, i: int) -> int:
        i = self.need(i, "i")
        while self.s[i] == "." and self.s[i + 1] == "i":
            i += 2
        return i

    def arguments(self, i: int) -> int:
        """Type arguments from '<'."""
        i += 1
        if self.s[i] == ">":
            return i + 1
        while True:
            while self.s[i] == "@":
                i = self.annotation(i)
            if self.s[i] == "?":
                i += 1
                if self.s[i] in "xU":
                    i = self.type(i + 1)
            else:
                i = self.type(i)
            if self.s[i] == ",":
                i += 1
            else:
                return self.need(i, ">")

    def type(self, i: int, dims: bool = True) -> int:
        s = self.s
        if s[i] == "t":
            i += 1
        else:
            i = self.need(i, "i")
            while True:
                if s[i] == "<":
                    i = self.arguments(i)
                if s[i] == "." and s[i + 1] == "i":
                    i += 2
                else:
                    break
        if dims:
            while s[i] == "[" and s[i + 1] == "]":
                i += 2
        return i

    def dims(self, i: int) -> int:
        while self.s[i] == "[" and self.s[i + 1] == "]":
            i += 2
        return i

    def parameters(self, i: int) -> int:
        """Type parameters from '<'."""
        i += 1
        while True:
            while self.s[i] == "@":
                i = self.annotation(i)
            i = self.need(i, "i")
            if self.s[i] == "x":
                i = self.type(i + 1)
                while self.s[i] == "&":
                    i = self.type(i + 1)
            if self.s[i] == ",":
                i += 1
            else:
                return self.need(i, ">")

    def annotation(self, i: int) -> int:
        i = self.qualified(i + 1)
        if self.s[i] == "(":
            end = self.match[i]
            if end > i + 1:
                if self.s[i + 1] == "i" and self.s[i + 2] == "=":
                    for a, b in self.parts(i + 1, end):
                        if self.s[a] != "i" or self.s[a + 1] != "=":
                            raise Bad
                        self.element(a + 2, b)
                else:
                    self.element(i + 1, end)
            i = end + 1
        return i

    def element(self, i: int, end: int) -> None:
        if self.s[i] == "@":
            if self.annotation(i) != end:
                raise Bad
        elif self.s[i] == "{" and self.match[i] == end - 1:
            for a, b in self.parts(i + 1, end - 1, True):
                self.element(a, b)
        else:
            self.expression(i, end)

    def modifiers(self, i: int) -> int:
        s = self.s
        while s[i] in "mSfyd@":
            if s[i] == "@":
                if s[i + 1] == "C":
                    return i
                i = self.annotation(i)
            elif s[i] == "d" and s[i + 1] in ":":
                return i
            else:
                i += 1
        return i

    def parts(self, i: int, end: int, trailing: bool = False) -> list[tuple[int, int]]:
        """Slices between commas outside brackets; none if empty."""
        out, a = [], i
        while i < end:
            c = self.s[i]
            if c == ",":
                if a == i:
                    if trailing and not out and i + 1 == end:
                        return []
                    raise Bad
                out.append((a, i))
                a = i + 1
            elif c in "([{":
                i = self.match[i]
            elif c == "<":
                try:
                    j = self.arguments(i)
                    if self.s[j] in "i(.[,)>:" or j == end:
                        i = j - 1
                except (Bad, IndexError):
                    pass
            i += 1
        if a < end:
            out.append((a, end))
        elif out and not trailing:
            raise Bad
        return out

    # --- expressions

    def expression(self, i: int, end: int) -> str:
        """Kind of the expression that fills the slice: 's' if it may stand as a statement, else 'e'."""
        key = self.s[i:end] if end - i < KEPT else None
        kind = self.good_expressions.get(key) if key is not None else None
        if kind is None:
            if i >= end:
                raise Bad
            j, kind = self.assignment(i, end)
            if j != end:
                raise Bad
            if key is not None:
                self.good_expressions[key] = kind
        return kind

    def assignment(self, i: int, end: int) -> tuple[int, str]:
        j, kind = self.ternary(i, end)
        while j < end and self.s[j] in "=%":
            j, kind = self.ternary(j + 1, end)[0], "s"
        return j, kind

    def ternary(self, i: int, end: int) -> tuple[int, str]:
        s = self.s
        j, kind = self.operand(i, end)
        while j < end:
            c = s[j]
            if c == ">":
                while s[j + 1] == ">" and j + 1 < end:
                    j += 1
                c = "o"
            if c in "os*<&|":
                j, kind = self.operand(j + 1, end)[0], "e"
            elif c == "I":
                j, kind = self.type(j + 1), "e"
            elif c == "?":
                # the last arm goes on in this loop, so a long chain of conditions needs no depth
                j = self.assignment(j + 1, end)[0]
                j, kind = self.operand(self.need(j, ":"), end)[0], "e"
            else:
                break
        return j, kind

    def operand(self, i: int, end: int) -> tuple[int, str]:
        s = self.s
        if i >= end:
            raise Bad
        c = s[i]
        if c == "s" or c == "u" or c == "p":
            while i < end and s[i] in "sup":
                i += 1
            return self.operand(i, end)[0], "s" if c == "p" else "e"
        kind = "e"
        if c == "(":
            close = self.match[i]
            after = s[close + 1] if close + 1 < end else "\n"
            cast = False
            if s[i + 1] in "ti":
                try:
                    cast = self.type(i + 1) == close and (s[i + 1] == "t" and (s[i + 2] != "." or False) or after in "il(uTUntv")
                    if s[i + 1] == "t" and cast and after not in "il(uTUntvsp":
                        raise Bad
                except Bad:
                    if s[i + 1] == "t" and s[i + 2] == ")":
                        raise
                    cast = False
            if cast:
                return self.operand(close + 1, end)[0], "e"
            self.expression(i + 1, close)
            i = close + 1
        elif c == "i":
            i += 1
            if s[i] == "(":
                i, kind = self.call(i), "s"
            elif s[i] == "[" and s[i + 1] == "]":
                i = self.need(self.need(self.dims(i), "."), "c")
        elif c == "l":
            i += 1
        elif c == "T":
            i += 1
            if s[i] == "(":
                i, kind = self.call(i), "s"
        elif c == "U":
            i += 1
            if s[i] == "(":
                i, kind = self.call(i), "s"
            elif s[i] == ".":
                if s[i + 1] not in "i<":
                    raise Bad
            else:
                raise Bad
        elif c == "n":
            i, kind = self.creation(i + 1), "s"
        elif c == "t":
            i = self.need(self.need(self.dims(i + 1), "."), "c")
        elif c == "v":
            i = self.need(self.need(i + 1, "."), "c")
        elif c == "<":
            i = self.arguments(i)
            i = i + 1 if s[i] in "TU" else self.need(i, "i")
            i, kind = self.call(i), "s"
        else:
            raise Bad
        while i < end:
            c = s[i]
            if c == ".":
                d = s[i + 1]
                if d == "i":
                    i += 2
                    kind = "e"
                    if s[i] == "(":
                        i, kind = self.call(i), "s"
                    elif s[i] == "[" and s[i + 1] == "]":
                        i = self.need(self.need(self.dims(i), "."), "c")
                elif d == "<":
                    i = self.arguments(i + 1)
                    i = i + 1 if s[i] == "U" else self.need(i, "i")
                    i, kind = self.call(i), "s"
                elif d == "n":
                    i, kind = self.creation(i + 2), "s"
                elif d == "T" or d == "c":
                    i, kind = i + 2, "e"
                elif d == "U":
                    i += 2
                    if s[i] == "(":
                        i, kind = self.call(i), "s"
                else:
                    raise Bad
            elif c == "[":
                self.expression(i + 1, self.match[i])
                i, kind = self.match[i] + 1, "e"
            elif c == "p":
                i, kind = i + 1, "s"
            else:
                break
        return i, kind

    def call(self, i: int) -> int:
        self.need(i, "(")
        end = self.match[i]
        if end > i + 1:
            key = self.s[i : end + 1] if end - i < KEPT else None
            if key is None or key not in self.good_expressions:
                j = i + 1
                while True:
                    j = self.assignment(j, end)[0]
                    if j == end:
                        break
                    j = self.need(j, ",")
                if key is not None:
                    self.good_expressions[key] = "("
        return end + 1

    def creation(self, i: int) -> int:
        """After new."""
        s = self.s
        while s[i] == "@":
            i = self.annotation(i)
        if s[i] == "<":
            i = self.arguments(i)
        i = self.type(i, False)
        if s[i] == "(":
            i = self.call(i)
            if s[i] == "{":
                self.members(i + 1, self.match[i], "c")
                i = self.match[i] + 1
            return i
        self_dims = 0
        while s[i] == "[":
            if s[i + 1] == "]":
                i += 2
                if not self_dims:
                    self_dims = -1
            elif self_dims >= 0:
                self.expression(i + 1, self.match[i])
                i = self.match[i] + 1
                self_dims = 1
            else:
                raise Bad
            if self_dims == 1 and s[i] == "[" and s[i + 1] == "]":
                return self.dims(i)
        if self_dims == -1:
            if s[i] != "{":
                raise Bad
            return self.initialiser(i)
        if not self_dims:
            raise Bad
        return i

    def initialiser(self, i: int) -> int:
        end = self.match[i]
        for a, b in self.parts(i + 1, end, True):
            self.variable_init(a, b)
        return end + 1

    def variable_init(self, i: int, end: int) -> None:
        if self.s[i] == "{":
            if self.initialiser(i) != end:
                raise Bad
        else:
            self.expression(i, end)

    # --- statements

    def block(self, i: int, end: int) -> None:
        s, good = self.s, self.good_statements
        while i < end:
            j = s.find(";", i, min(end, i + KEPT)) + 1
            if j and s[i:j] in good:
                i = j
            else:
                i = self.statement(i, end, True)

    def stop(self, i: int, end: int) -> int:
        """The first ';' outside brackets."""
        s = self.s
        while i < end:
            c = s[i]
            if c == ";":
                return i
            i = self.match[i] + 1 if c in "([{" else i + 1
        raise Bad

    def statement(self, i: int, end: int, in_block: bool = False) -> int:
        s, match = self.s, self.match
        if i >= end:
            raise Bad
        c = s[i]
        if c == "{":
            self.block(i + 1, match[i])
            return match[i] + 1
        if c == ";":
            return i + 1
        if c == "F" or c == "W" or c == "w":
            self.need(i + 1, "(")
            close = match[i + 1]
            self.expression(i + 2, close)
            if c == "w":
                self.need(close + 1, "{")
                self.cases(close + 2, match[close + 1])
                return match[close + 1] + 1
            j = self.statement(close + 1, end)
            while c == "F" and j < end and s[j] == "E":
                if s[j + 1] != "F":
                    return self.statement(j + 1, end)
                self.need(j + 2, "(")
                close = match[j + 2]
                self.expression(j + 3, close)
                j = self.statement(close + 1, end)
            return j
        if c == "R":
            self.need(i + 1, "(")
            close = match[i + 1]
            key = s[i : close + 1] if close - i < KEPT else None
            if key is None or key not in self.good_statements:
                self.for_header(i + 2, close)
                if key is not None:
                    self.keep(key)
            return self.statement(close + 1, end)
        if c == "D":
            j = self.need(self.statement(i + 1, end), "W")
            self.need(j, "(")
            self.expression(j + 1, match[j])
            return self.need(match[j] + 1, ";")
        if c == "Y":
            return self.attempt(i)
        if c == "y" and s[i + 1] == "(":
            self.expression(i + 2, match[i + 1])
            j = self.need(match[i + 1] + 1, "{") - 1
            self.block(j + 1, match[j])
            return match[j] + 1
        if c == "i" and s[i + 1] == ":":
            return self.statement(i + 2, end)
        if in_block:
            j = self.modifiers(i)
            if s[j] in "ce" or s[j] == "C":
                if s[j] != "c":
                    raise Bad
                return self.declaration(i, end)
        j = self.stop(i, end)
        self.simple(i, j, in_block)
        if in_block and j - i < KEPT:
            key = s[i : j + 1]
            if "{" not in key and key.count(";") == 1:
                self.keep(key)
        return j + 1

    def keep(self, key: str) -> None:
        self.good_statements.add(key)

    def simple(self, i: int, end: int, in_block: bool) -> None:
        s, c = self.s, self.s[i]
        if c in "rH":
            if i + 1 < end:
                self.expression(i + 1, end)
            elif c == "H":
                raise Bad
        elif c in "bB":
            if end - i > 2 or end - i == 2 and s[i + 1] != "i":
                raise Bad
        elif c == "A":
            j = self.assignment(i + 1, end)[0]
            if j < end:
                self.expression(self.need(j, ":"), end)
        elif in_block and self.is_variable(i, end):
            self.variables(i, end)
        elif self.expression(i, end) != "s":
            raise Bad

    def is_variable(self, i: int, end: int) -> bool:
        """Whether a declaration of a local variable starts here."""
        s = self.s
        if s[i] in "f@":
            return True
        if s[i] not in "ti":
            return False
        try:
            j = self.type(i)
        except Bad:
            return False
        return j < end and s[j] == "i"

    def variables(self, i: int, end: int) -> None:
        """[modifiers] type name [= init], ..."""
        i = self.type(self.modifiers(i))
        self.declarators(i, end)

    def declarators(self, i: int, end: int) -> None:
        while True:
            i = self.dims(self.need(i, "i"))
            if i < end and self.s[i] == "=":
                if self.s[i + 1] == "{":
                    i = self.initialiser(i + 1)
                else:
                    i = self.assignment(i + 1, end)[0]
            if i == end:
                return
            i = self.need(i, ",")

    def for_header(self, i: int, end: int) -> None:
        s = self.s
        if self.is_variable(i, end):
            j = self.type(self.modifiers(i))
            if s[j] == "i" and s[self.dims(j + 1)] == ":":
                self.expression(self.dims(j + 1) + 1, end)
                return
            j = self.stop(i, end)
            self.variables(i, j)
        else:
            j = self.stop(i, end)
            for a, b in self.parts(i, j):
                if self.expression(a, b) != "s":
                    raise Bad
        k = self.stop(j + 1, end)
        if k > j + 1:
            self.expression(j + 1, k)
        for a, b in self.parts(k + 1, end):
            if self.expression(a, b) != "s":
                raise Bad

    def cases(self, i: int, end: int) -> None:
        s = self.s
        if i < end and s[i] not in "ad":
            raise Bad
        while i < end:
            if s[i] == "a":
                j = self.ternary(i + 1, end)[0]
                i = self.need(j, ":")
            elif s[i] == "d" and s[i + 1] == ":":
                i += 2
            else:
                j = s.find(";", i, min(end, i + KEPT)) + 1
                i = j if j and s[i:j] in self.good_statements else self.statement(i, end, True)

    def attempt(self, i: int) -> int:
        s, match = self.s, self.match
        i, bare = i + 1, True
        if s[i] == "(":
            j, close, bare = i + 1, match[i], False
            while True:
                k = self.type(self.modifiers(j))
                k = self.need(self.need(k, "i"), "=")
                j = self.assignment(k, close)[0]
                if j == close:
                    break
                j = self.need(j, ";")
                if j == close:
                    break
            i = close + 1
        self.need(i, "{")
        self.block(i + 1, match[i])
        i = match[i] + 1
        while s[i] == "K":
            j = self.need(i + 1, "(")
            close = match[i + 1]
            j = self.type(self.modifiers(j))
            while s[j] == "|":
                j = self.type(j + 1)
            if self.dims(self.need(j, "i")) != close:
                raise Bad
            j = self.need(close + 1, "{") - 1
            self.block(j + 1, match[j])
            i, bare = match[j] + 1, False
        if s[i] == "L":
            j = self.need(i + 1, "{") - 1
            self.block(j + 1, match[j])
            return match[j] + 1
        if bare:
            raise Bad
        return i

    # --- declarations

    def unit(self, i: int, end: int) -> None:
        s = self.s
        j = i
        while s[j] == "@" and s[j + 1] != "C":
            j = self.annotation(j)
        if s[j] == "P":
            i = self.need(self.qualified(j + 1), ";")
        while i < end and s[i] in "M;":
            if s[i] == ";":
                i += 1
                continue
            i += 2 if s[i + 1] == "S" else 1
            i = self.qualified(i)
            if s[i] == "." and s[i + 1] == "*":
                i += 2
            i = self.need(i, ";")
        while i < end:
            i = i + 1 if s[i] == ";" else self.declaration(i, end)

    def declaration(self, i: int, end: int) -> int:
        """A class, interface, enum or annotation type."""
        s = self.s
        i = self.modifiers(i)
        kind = s[i]
        if kind == "@" and s[i + 1] == "C":
            kind, i = "@", i + 1
        elif kind not in "cCe":
            raise Bad
        i = self.need(i + 1, "i")
        if s[i] == "<" and kind in "cC":
            i = self.parameters(i)
        if s[i] == "x" and kind in "cC":
            i = self.type(i + 1)
            while kind == "C" and s[i] == ",":
                i = self.type(i + 1)
        if s[i] == "X" and kind in "ce":
            i = self.type(i + 1)
            while s[i] == ",":
                i = self.type(i + 1)
        self.need(i, "{")
        close = self.match[i]
        if close >= end:
            raise Bad
        if kind == "e":
            self.enum_body(i + 1, close)
        else:
            self.members(i + 1, close, kind)
        return close + 1

    def enum_body(self, i: int, end: int) -> None:
        s = self.s
        while i < end and s[i] in "i@":
            while s[i] == "@":
                i = self.annotation(i)
            i = self.need(i, "i")
            if s[i] == "(":
                i = self.call(i)
            if s[i] == "{":
                self.members(i + 1, self.match[i], "c")
                i = self.match[i] + 1
            if i < end and s[i] == ",":
                i += 1
            else:
                break
        else:
            if i < end and s[i] == "," :
                i += 1
        if i < end:
            self.members(self.need(i, ";"), end, "c")

    def members(self, i: int, end: int, kind: str) -> None:
        s, match = self.s, self.match
        while i < end:
            if s[i] == ";":
                i += 1
                continue
            if s[i] == "{" or s[i] == "S" and s[i + 1] == "{":
                i += s[i] == "S"
                self.block(i + 1, match[i])
                i = match[i] + 1
                continue
            brace, semi = s.find("{", i, end), s.find(";", i, end)
            stop = min(x for x in (brace, semi, end) if x >= 0)
            key = kind + s[i : stop + 1]
            known = self.good_headers.get(key)
            if known == "{":
                self.block(stop + 1, match[stop])
                i = match[stop] + 1
                continue
            if known == ";":
                i = stop + 1
                continue
            i = self.member(i, end, kind, key, stop)

    def member(self, i: int, end: int, kind: str, key: str, stop: int) -> int:
        s, match = self.s, self.match
        j = self.modifiers(i)
        if s[j] in "cCe" or s[j] == "@" and s[j + 1] == "C":
            return self.declaration(i, end)
        if s[j] == "<":
            j = self.parameters(j)
        if s[j] == "i" and s[j + 1] == "(":
            if kind not in "c":
                raise Bad
            j += 1
            void = True
        else:
            void = s[j] == "v"
            j = j + 1 if void else self.type(j)
            j = self.need(j, "i")
            if s[j] != "(":
                if void:
                    raise Bad
                j -= 1
                k = self.stop(j, end)
                self.declarators(j, k)
                if k == stop and len(key) < 300:
                    self.good_headers[key] = ";"
                return k + 1
        self.formals(j + 1, match[j])
        j = self.dims(match[j] + 1)
        if s[j] == "h":
            j = self.type(j + 1)
            while s[j] == ",":
                j = self.type(j + 1)
        if s[j] == "d" and kind == "@":
            k = self.stop(j, end)
            self.element(j + 1, k)
            return k + 1
        if s[j] == ";":
            if j == stop and len(key) < 300:
                self.good_headers[key] = ";"
            return j + 1
        self.need(j, "{")
        if j == stop and len(key) < 300:
            self.good_headers[key] = "{"
        self.block(j + 1, match[j])
        return match[j] + 1

    def formals(self, i: int, end: int) -> None:
        if i == end:
            return
        s = self.s
        while True:
            i = self.type(self.modifiers(i))
            last = s[i] == "z"
            i = self.dims(self.need(i + 1 if last else i, "i"))
            if i == end:
                return
            if last:
                raise Bad
            i = self.need(i, ",")
