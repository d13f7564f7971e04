"""Regular expressions of the rule format (ECMAScript's, without flags but case) as patterns of Spark's engine.

A pattern is read once, left to right; what is no valid pattern of the format gives an error, and what Spark's engine reads
differently is spelled so that it means the same.  A back reference to a group that took no part matches nothing here.
"""

from __future__ import annotations

import re

_QUANTIFIER = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_NAME = re.compile(r"<([A-Za-z_$][A-Za-z0-9_$]*)>")
#: What \s and . stand for in the format.
_WHITE = r"\t\n\x0B\f\r    -     　﻿"
_ANY = r"[^\n\r  ]"
_SAME = set("dDwWbBnrtf")


class PatternError(ValueError):
    """Why a pattern isn't one of the format."""


class _Reader:
    def __init__(self, pattern: str):
        self.p, self.at, self.out = pattern, 0, []
        self.names: list[str] = []
        self.refs: list[str] = []
        self.named = bool(re.search(r"\(\?<[A-Za-z_$]", pattern))

    def read(self) -> str:
        self.alternatives(0)
        if self.at < len(self.p):
            raise PatternError("unmatched )")
        if self.named and any(r not in self.names for r in self.refs):
            raise PatternError("reference to no group")
        return "".join(self.out)

    def alternatives(self, depth: int) -> None:
        while self.at < len(self.p):
            c = self.p[self.at]
            if c == ")":
                if not depth:
                    raise PatternError("unmatched )")
                return
            if c == "|":
                self.put("|")
                continue
            start, fixed = len(self.out), self.term(depth)
            self.quantifier(start, fixed)

    def put(self, text: str, step: int = 1) -> None:
        self.out.append(text)
        self.at += step

    def term(self, depth: int) -> bool:
        """One assertion or atom; true if nothing may repeat it."""
        c = self.p[self.at]
        if c in "*+?" or (c == "{" and _QUANTIFIER.match(self.p, self.at)):
            raise PatternError("nothing to repeat")
        if c == "^":
            self.put("^")
            return True
        if c == "$":
            self.put(r"\z")
            return True
        if c == ".":
            self.put(_ANY)
        elif c in "{}]":
            self.put("\\" + c)
        elif c == "[":
            self.bracket()
        elif c == "\\":
            return self.escape()
        elif c == "(":
            return self.group(depth)
        else:
            self.put(c)
        return False

    def quantifier(self, start: int, fixed: bool) -> None:
        if self.at >= len(self.p):
            return
        found = _QUANTIFIER.match(self.p, self.at)
        if found:
            if found[2] and int(found[2]) < int(found[1]):
                raise PatternError("numbers out of order in a quantifier")
            text = found[0]
        elif self.p[self.at] in "*+?":
            text = self.p[self.at]
        else:
            return
        if fixed:
            raise PatternError("nothing to repeat")
        self.put(text, len(text))
        if self.p[self.at : self.at + 1] == "?":
            self.put("?")

    def group(self, depth: int) -> bool:
        head, fixed = "(", False
        rest = self.p[self.at + 1 : self.at + 4]
        step = 1
        if rest.startswith("?"):
            kind = next((k for k in ("?:", "?=", "?!", "?<=", "?<!") if rest.startswith(k)), None)
            if kind:
                head, step, fixed = "(" + kind, 1 + len(kind), kind.startswith("?<")
            else:
                found = _NAME.match(self.p, self.at + 2)
                if not found:
                    raise PatternError("invalid group")
                if found[1] in self.names:
                    raise PatternError("a group's name comes twice")
                self.names.append(found[1])
                head, step = f"(?<n{len(self.names)}x>", 2 + len(found[0])
        self.put(head, step)
        self.alternatives(depth + 1)
        if self.p[self.at : self.at + 1] != ")":
            raise PatternError("unterminated group")
        self.put(")")
        return fixed

    def escape(self) -> bool:
        c = self.p[self.at + 1 : self.at + 2]
        if not c:
            raise PatternError("\\ at the end of the pattern")
        if c == "k" and self.named:
            found = _NAME.match(self.p, self.at + 2)
            if not found:
                raise PatternError("invalid reference")
            self.refs.append(found[1])
            known = [m[1] for m in re.finditer(r"\(\?" + _NAME.pattern, self.p)]
            number = known.index(found[1]) + 1 if found[1] in known else 0
            self.put(rf"\k<n{number}x>", 2 + len(found[0]))
        elif c in "123456789":
            digits = re.match(r"\d+", self.p[self.at + 1 :])[0]
            self.put(rf"(?:\{digits})", 1 + len(digits))
        else:
            self.put(*self.character(False))
        return c in "bB"

    def character(self, inside: bool) -> tuple[str, int]:
        """An escape that stands for a character or a class, and its length."""
        c, rest = self.p[self.at + 1], self.p[self.at + 1 :]
        if c == "b" and inside:
            return r"\x08", 2
        if c in _SAME and not (inside and c == "B"):
            return "\\" + c, 2
        if c == "s":
            return (_WHITE if inside else f"[{_WHITE}]"), 2
        if c == "S":
            return f"[^{_WHITE}]", 2
        if c == "v":
            return r"\x0B", 2
        if c == "0":
            return r"\x00", 2
        for shape in (r"x[0-9A-Fa-f]{2}", r"u[0-9A-Fa-f]{4}"):
            if found := re.match(shape, rest):
                return "\\" + found[0], 1 + len(found[0])
        if c == "c" and len(rest) > 1 and rest[1].isascii() and rest[1].isalpha():
            return rf"\x{ord(rest[1]) % 32:02x}", 3
        return (c if c.isalnum() else "\\" + c if c.isascii() else c), 2

    def bracket(self) -> None:
        self.at += 1
        no = self.p[self.at : self.at + 1] == "^"
        self.at += no
        if self.p[self.at : self.at + 1] == "]":
            self.put(r"[\x{0}-\x{10FFFF}]" if no else "(?!)")
            return
        parts, low, ranged = [], None, False
        while True:
            if self.at >= len(self.p):
                raise PatternError("unterminated character class")
            c = self.p[self.at]
            if c == "]":
                break
            if c == "\\":
                if self.at + 1 >= len(self.p):
                    raise PatternError("\\ at the end of the pattern")
                text, step = self.character(True)
                one = len(text) != 2 or text[1] not in "dDwWsS"
                one = one and not text.startswith((r"\t\n", "[^"))
                self.at += step
            elif c == "-" and low is not None and not ranged and self.p[self.at + 1 : self.at + 2] not in ("]", ""):
                ranged = True
                self.at += 1
                continue
            else:
                text, one = ("\\" + c if c in "[&-^~" else c), True
                self.at += 1
            value = _value(text) if one else None
            if ranged:
                ranged = False
                if low[1] is not None and value is not None:
                    if value < low[1]:
                        raise PatternError("range out of order in a character class")
                    parts[-1] = f"{low[0]}-{text}"
                    low = None
                    continue
                parts.append(r"\-")
            parts.append(text)
            low = (text, value)
        if ranged:
            parts.append(r"\-")
        self.put(("[^" if no else "[") + "".join(parts) + "]")


def _value(text: str) -> int:
    if text[0] != "\\" or len(text) == 1:
        return ord(text[0])
    plain = {"n": 10, "r": 13, "t": 9, "f": 12}
    return int(text[2:], 16) if text[1] in "xu" and len(text) > 2 else plain.get(text[1], ord(text[1]))


def engine_pattern(pattern: str) -> str:
    """The pattern for Spark's engine, letters of any script in either case; PatternError if it is none of the format."""
    return "(?iu)" + _Reader(pattern).read()


def fault(pattern: str) -> str | None:
    """Why a pattern isn't valid, None if it is."""
    try:
        _Reader(pattern).read()
        return None
    except PatternError as e:
        return str(e)
