r"""Regular expressions of the RE2 dialect for Java's engine, which Spark uses.

The two dialects differ in what they accept and, silently, in what some texts mean: ``[[:alpha:]]``, ``[a&&b]``, ``\v``, ``\s``, ``$``, ``(?U)`` and
others.  A pattern is read once, left to right; what RE2 knows is written as Java's form of the same meaning, what it does not know is
refused: look-around, back-references, possessive and nested repetition, unknown escapes and flags.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: POSIX classes inside brackets and their Java forms.
POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower",
    "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}
#: General categories; any other name of \p{...} is a script.
CATEGORIES = frozenset("C Cc Cf Co Cs L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps S Sc Sk Sm So Z Zl Zp Zs".split())
MAX_REPEAT = 1000
_REPEAT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")
_GROUP = re.compile(r"\?(?:P?<([A-Za-z_]\w*)>|([a-zA-Z-]*)([:)]))")
_SPACE = r"\t\n\f\r "


class RegexError(ValueError):
    """The pattern is not one of the RE2 dialect."""


@dataclass
class _Flags:
    multi: bool = False
    lazy: bool = False


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at, self.out = pattern, 0, []
        self.names: set[str] = set()

    def fail(self, why: str) -> RegexError:
        return RegexError(f"unsupported regular expression {self.text!r}: {why}")

    def translate(self) -> str:
        flags, outer = _Flags(), []
        operand = False  # something stands here that can be repeated
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "(":
                outer.append(flags)
                flags, closed = self.opened(flags)
                if closed:  # flags for the rest of the group around it
                    outer.pop()
                operand = False
                continue
            if c in "*+?" or (c == "{" and _REPEAT.match(self.text, self.at)):
                if not operand:
                    raise self.fail("nothing to repeat")
                self.repetition(flags)
                operand = False  # a second one would be nested or possessive
                continue
            self.at += 1
            operand = True
            if c == ")":
                if not outer:
                    raise self.fail("unexpected )")
                flags = outer.pop()
                self.out.append(")")
            elif c == "|":
                self.out.append("|")
                operand = False
            elif c == "[":
                self.out.append(self.bracket())
            elif c == "\\":
                self.out.append(self.escape(False))
            elif c == "^":
                self.out.append(r"(?:\A|(?<=\n))" if flags.multi else r"\A")
            elif c == "$":
                self.out.append(r"(?:\z|(?=\n))" if flags.multi else r"\z")
            else:
                self.out.append("\\" + c if c in "{}]" else c)
        if outer:
            raise self.fail("missing )")
        return "".join(self.out)

    def opened(self, flags: _Flags) -> tuple[_Flags, bool]:
        """Read what opens a group, or flags alone; the flags that hold behind it and whether it was flags alone."""
        self.at += 1
        if self.text[self.at : self.at + 1] != "?":
            self.out.append("(")
            return _Flags(flags.multi, flags.lazy), False
        m = _GROUP.match(self.text, self.at)
        if not m:
            raise self.fail("no look-around and no such group")
        self.at = m.end()
        name, letters, end = m.groups()
        if name is not None:
            if name in self.names:
                raise self.fail("a group name twice")
            self.names.add(name)
            self.out.append(f"(?<{name}>" if name.isalnum() and name.isascii() else "(")
            return _Flags(flags.multi, flags.lazy), False
        if not re.fullmatch(r"[imsU]*(?:-[imsU]+)?", letters) or (end == ")" and not letters):
            raise self.fail("unknown flags")
        on, _, off = letters.partition("-")
        now = _Flags(flags.multi, flags.lazy)
        for own, value in ((on, True), (off, False)):
            now.multi = value if "m" in own else now.multi
            now.lazy = value if "U" in own else now.lazy
        java = "".join(f for f in on if f in "is").replace("i", "iu") + ("-" + "".join(f for f in off if f in "is") if set(off) & set("is") else "")
        self.out.append(f"(?{java}{end}" if java or end == ":" else "")
        return now, end == ")"

    def repetition(self, flags: _Flags) -> None:
        m = _REPEAT.match(self.text, self.at)
        mark = m[0] if m else self.text[self.at]
        if m:
            low, high = int(m[1]), int(m[3] or m[1])
            if low > MAX_REPEAT or high > MAX_REPEAT or (m[3] and low > high):
                raise self.fail("repetition count")
        self.at += len(mark)
        lazy = self.text[self.at : self.at + 1] == "?"
        self.at += lazy
        if self.text[self.at : self.at + 1] in ("*", "+", "?") or _REPEAT.match(self.text, self.at):
            raise self.fail("nested or possessive repetition")
        self.out.append(mark + "?" * (lazy != flags.lazy))

    def escape(self, inside: bool) -> str:
        """What follows a backslash, outside or inside brackets."""
        if self.at >= len(self.text):
            raise self.fail("trailing backslash")
        c = self.text[self.at]
        self.at += 1
        if c in "pP":
            return self.category(c)
        if c == "x" and (m := re.compile(r"\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2}").match(self.text, self.at)):
            self.at = m.end()
            if int(m[0].strip("{}"), 16) > 0x10FFFF:
                raise self.fail("no such character")
            return rf"\x{{{m[0].strip('{}')}}}"
        if c in "01234567" and (m := re.compile(r"[0-7]{1,2}" if c != "0" else r"[0-7]{0,2}").match(self.text, self.at)):
            self.at = m.end()
            return rf"\x{{{int(c + m[0], 8):x}}}"
        if c == "Q" and not inside:
            stop = self.text.find(r"\E", self.at)
            said = self.text[self.at : stop if stop >= 0 else len(self.text)]
            self.at = stop + 2 if stop >= 0 else len(self.text)
            return "".join("\\" + x if not x.isalnum() and x.isascii() and x.isprintable() else x for x in said)
        if c in "dDwW" or c in "afnrt":
            return "\\" + c
        if c == "v":
            return r"\x0B"
        if c == "s":
            return _SPACE if inside else f"[{_SPACE}]"
        if c == "S":
            return r"\S\x0B" if inside else f"[^{_SPACE}]"
        if not inside and c in "Az":
            return "\\" + c
        if not inside and c == "b":
            return r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
        if not inside and c == "B":
            return r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
        if c.isascii() and not c.isalnum():
            return "\\" + c
        raise self.fail(f"no back-references and no escape \\{c}")

    def category(self, letter: str) -> str:
        m = re.compile(r"\{(\^?)(\w+)\}|([A-Z])").match(self.text, self.at)
        if not m:
            raise self.fail("character class")
        self.at = m.end()
        name = m[2] or m[3]
        if m[1]:
            letter = "P" if letter == "p" else "p"
        if name == "Any":
            return r"\x{0}-\x{10FFFF}" if letter == "p" else self._refuse_none()
        return rf"\{letter}{{{name if name in CATEGORIES else 'Is' + name}}}"

    def _refuse_none(self) -> str:
        raise self.fail("a class without characters")

    def bracket(self) -> str:
        """A class behind its opening bracket; inside, only what Java reads alike is left bare."""
        out, first = "[", True
        if self.text[self.at : self.at + 1] == "^":
            out += "^"
            self.at += 1
        while True:
            if self.at >= len(self.text):
                raise self.fail("missing ]")
            c = self.text[self.at]
            if c == "]" and not first:
                self.at += 1
                return out + "]"
            first = False
            if m := re.compile(r"\[:(\^?)(\w+):\]").match(self.text, self.at):
                self.at = m.end()
                if m[2] != "word" and m[2] not in POSIX:
                    raise self.fail("character class")
                out += (r"\W" if m[1] else r"\w") if m[2] == "word" else rf"\{'P' if m[1] else 'p'}{{{POSIX[m[2]]}}}"
                continue
            low, single = self.member()
            if self.text[self.at : self.at + 1] == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                if not single:
                    raise self.fail("character class range")
                self.at += 1
                high, single = self.member()
                if not single or _code(low) > _code(high):
                    raise self.fail("character class range")
                out += f"{low}-{high}"
            else:
                out += low

    def member(self) -> tuple[str, bool]:
        """One member of a class and whether it is a single character."""
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            said = self.escape(True)
            return said, not (re.match(r"\\[dDwWSpP]", said) or said == _SPACE or "-" in said[1:])
        return ("\\" + c if c in "[]&-^~" else c), True


def _code(member: str) -> int:
    if m := re.fullmatch(r"\\x\{?([0-9A-Fa-f]+)\}?", member):
        return int(m[1], 16)
    return {"\\a": 7, "\\f": 12, "\\n": 10, "\\r": 13, "\\t": 9}.get(member, ord(member[-1]))


def java_regex(pattern: str) -> str:
    """The pattern for Java, anchored at both ends, where only a line feed ends a line."""
    return rf"(?d)\A(?:{_Reader(pattern).translate()})\z"
