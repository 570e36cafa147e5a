"""Syntax of JSON: tokens by class, containers reduced from the inside, an explicit stack for the rest."""

import re

TOKEN = re.compile(r'[ \t\n\r]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|[\[\]{},:]|[^ \t\n\r])')
#: A container of strings and other values.
INNER = re.compile(r"\[(?:[sv](?:,[sv])*+)?\]|\{(?:s:[sv](?:,s:[sv])*+)?\}")
PASSES = 16


def lex(text: str) -> str:
    """Classes: s for strings, v for other values, brackets, comma and colon for themselves, # for what is no token."""
    return "".join(c if (c := t[0]) in "[]{},:" else "s" if c == '"' and len(t) > 1 else "v" if c in "-0123456789" and t != "-" or t in ("true", "false", "null") else "#" for t in TOKEN.findall(text))


def reduced(s: str) -> str:
    """Classes with sound containers of few levels replaced by a value."""
    for _ in range(PASSES):
        s, n = INNER.subn("v", s)
        if not n:
            break
    return s


def check(s: str) -> bool:
    """Whether the classes are one value."""
    stack, state = [], "value"  # value, first (value or end), key, firstkey, colon, next, done
    for c in s:
        if state in ("value", "first"):
            if c in "sv":
                state = "next"
            elif c == "[":
                stack.append(c)
                state = "first"
            elif c == "{":
                stack.append(c)
                state = "firstkey"
            elif c == "]" and state == "first":
                stack.pop()
                state = "next"
            else:
                return False
        elif state in ("key", "firstkey"):
            if c == "s":
                state = "colon"
            elif c == "}" and state == "firstkey":
                stack.pop()
                state = "next"
            else:
                return False
        elif state == "colon":
            if c != ":":
                return False
            state = "value"
        elif not stack:
            return False
        elif c == ",":
            state = "value" if stack[-1] == "[" else "key"
        elif c == ("]" if stack[-1] == "[" else "}"):
            stack.pop()
        else:
            return False
    return state == "next" and not stack
