"""Regex dialect and small expression helpers.

Patterns in this package are written for java.util.regex and spelled out in
ASCII terms: ``\\b``, ``\\s``, ``.`` and ``$`` mean something else in Java than
in the rule language users write, so they never reach the engine directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the rule language defines it.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS_CHARS = "\t\n\x0b\f\r " + "".join(
    chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
)
# The line terminators, everything "." matches, and the ASCII word characters.
LINE_ENDS = r"\n\r\x{2028}\x{2029}"
DOT = f"[^{LINE_ENDS}]"
WORD = "0-9A-Za-z_"

NOT_AFTER_WORD = f"(?<![{WORD}])"
NOT_BEFORE_WORD = f"(?![{WORD}])"
WORD_EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
NOT_WORD_EDGE = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Higher-order function bodies get no common-subexpression elimination, so a
    value that feeds twenty conditions has to be bound explicitly.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(value: Column) -> Column:
    return F.btrim(value, F.lit(WS_CHARS))


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units, the unit every length threshold is stated in."""
    return (F.octet_length(F.encode(value, "UTF-16LE")) / 2).cast("int")


def count_matches(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern))


def strip_chars(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, pattern, "")


def sql_string(text: str) -> str:
    """``text`` as a SQL string literal, safe from variable substitution."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


class PatternError(ValueError):
    """The text is not a pattern the scanner can run."""


_CLASS_ESCAPES = {"d": "0-9", "w": WORD, "s": WS}
_CONTROL = {"n": r"\n", "r": r"\r", "t": r"\t", "v": r"\x0B", "f": r"\f"}
# Repeats of a group that the Java engine may nest on its stack.
_SHALLOW_REPEATS = 200
# The largest repeat count that the Java engine can hold.
_MAX_REPEAT = (1 << 31) - 1


def _literal(code: int) -> str:
    ch = chr(code)
    if ch.isascii() and ch.isalnum():
        return ch
    return f"\\x{{{code:x}}}"


class _Translator:
    """One pass over an ECMAScript pattern, emitting the Java or RE2 spelling."""

    def __init__(self, pattern: str, flags: str, re2: bool = False) -> None:
        self.src = pattern
        self.re2 = re2
        self.pos = 0
        self.unicode = "u" in flags
        self.multiline = "m" in flags
        self.dot_all = "s" in flags
        self.groups = self._count_groups()
        self.repeats = 1  # of groups, multiplied as if each held the next; 0 for no bound

    def _count_groups(self) -> int:
        n, i, in_class = 0, 0, False
        while i < len(self.src):
            ch = self.src[i]
            if ch == "\\":
                i += 1
            elif in_class:
                in_class = ch != "]"
            elif ch == "[":
                in_class = True
            elif ch == "(" and (
                self.src[i + 1 : i + 2] != "?"
                or (self.src[i + 1 : i + 3] == "?<" and self.src[i + 3 : i + 4] not in ("=", "!"))
            ):
                n += 1
            i += 1
        return n

    def run(self) -> str:
        out = self._alternatives(depth=0)
        if self.pos < len(self.src):
            raise PatternError("unmatched )")
        return out

    def _no_re2(self, construct: str) -> None:
        if self.re2:
            raise PatternError(f"{construct} has no RE2 spelling")

    def _peek(self) -> str:
        return self.src[self.pos : self.pos + 1]

    def _alternatives(self, depth: int) -> str:
        if depth > 100:
            raise PatternError("groups nest too deeply")
        out = []
        while self.pos < len(self.src) and self._peek() != ")":
            if self._peek() == "|":
                self.pos += 1
                out.append("|")
                continue
            group = self._peek() == "("
            atom, repeatable = self._atom(depth)
            quantifier = self._quantifier(repeatable)
            if group and quantifier:
                self.repeats *= self._most(quantifier)
            out.append(atom + quantifier)
        return "".join(out)

    @staticmethod
    def _most(quantifier: str) -> int:
        """The most repeats that a quantifier allows; 0 for no bound."""
        if quantifier[0] != "{":
            return 1 if quantifier[0] == "?" else 0
        low, comma, high = quantifier.rstrip("?").strip("{}").partition(",")
        return max(1, int(high)) if high else 0 if comma else max(1, int(low))

    def _atom(self, depth: int) -> tuple[str, bool]:
        ch = self._peek()
        self.pos += 1
        if ch == "(":
            return self._group(depth)
        if ch == "[":
            return self._char_class(), True
        if ch == "\\":
            return self._escape()
        if ch == ".":
            return (r"[\x{0}-\x{10FFFF}]" if self.dot_all else DOT), True
        if ch in "^$" and self.multiline:
            self._no_re2("multi-line anchor")
        if self.re2 and ch in "^$":
            # A hint is also run over whole texts, where lines start and end inside.
            return ("(?m:^)" if ch == "^" else r"\r?(?m:$)"), False
        if ch == "^":
            return (f"(?:^|(?<=[{LINE_ENDS}]))" if self.multiline else "^"), False
        if ch == "$":
            return (f"(?=[{LINE_ENDS}]|\\z)" if self.multiline else r"\z"), False
        if ch in "*+?":
            raise PatternError("nothing to repeat")
        if ch == "{" and self._braces(self.pos - 1) is not None:
            raise PatternError("nothing to repeat")
        if ch in "{}]" and self.unicode:
            raise PatternError("lone bracket")
        return _literal(ord(ch)), True

    def _group(self, depth: int) -> tuple[str, bool]:
        head, look = "(", False
        behind_from = None
        for mark in ("?:", "?=", "?!", "?<=", "?<!"):
            if self.src.startswith(mark, self.pos):
                head, look = "(" + mark, mark != "?:"
                if look:
                    self._no_re2("look-around")
                self.pos += len(mark)
                behind_from = self.pos if mark in ("?<=", "?<!") else None
                break
        else:
            if self._peek() == "?":
                end = self.src.find(">", self.pos)
                name = self.src[self.pos + 2 : end] if end > 0 else ""
                if not self.src.startswith("?<", self.pos) or not (
                    name.isascii() and name.isalnum() and name[0].isalpha()
                ):
                    raise PatternError("invalid group")
                head, self.pos = "(" if self.re2 else f"(?<{name}>", end + 1
        body = self._alternatives(depth + 1)
        if self._peek() != ")":
            raise PatternError("unterminated group")
        if behind_from is not None and any(c in "+*{" for c in self.src[behind_from : self.pos]):
            raise PatternError("look-behind without a fixed length")
        self.pos += 1
        return f"{head}{body})", behind_from is None and (not look or not self.unicode)

    def _braces(self, at: int) -> tuple[int, int | None, int] | None:
        """``{n}``, ``{n,}`` or ``{n,m}`` at ``at`` as (low, high, end), else None."""
        end = self.src.find("}", at)
        if end < 0:
            return None
        low, comma, high = self.src[at + 1 : end].partition(",")
        if not (low.isascii() and low.isdigit()) or (high and not (high.isascii() and high.isdigit())):
            return None
        top = int(low) if not comma else (int(high) if high else None)
        return int(low), top, end + 1

    def _quantifier(self, repeatable: bool) -> str:
        ch = self._peek()
        if ch and ch in "*+?":
            text = ch
            self.pos += 1
        elif ch == "{" and (found := self._braces(self.pos)):
            low, high, self.pos = found
            if (high is not None and low > high) or max(low, high or 0) > (500 if self.re2 else _MAX_REPEAT):
                raise PatternError("repeat count out of range")
            text = f"{{{low}}}" if high == low else f"{{{low},{'' if high is None else high}}}"
        else:
            return ""
        if not repeatable:
            raise PatternError("nothing to repeat")
        if self._peek() == "?":
            self.pos += 1
            text += "?"
        return text

    def _escape(self) -> tuple[str, bool]:
        ch = self._peek()
        if not ch:
            raise PatternError("trailing backslash")
        self.pos += 1
        if ch == "b":
            return r"\b" if self.re2 else WORD_EDGE, False
        if ch == "B":
            return r"\B" if self.re2 else NOT_WORD_EDGE, False
        if ch in "dws":
            return f"[{_CLASS_ESCAPES[ch]}]", True
        if ch in "DWS":
            return f"[^{_CLASS_ESCAPES[ch.lower()]}]", True
        if ch in "123456789" or ch == "k":
            self._no_re2("back-reference")
        if ch in "123456789":
            digits = ch
            while self._peek() and self._peek() in "0123456789":
                digits += self._peek()
                self.pos += 1
            if int(digits) > self.groups:
                raise PatternError("reference to a group that does not exist")
            return f"(?:\\{digits})", True
        if ch == "k" and self._peek() == "<":
            end = self.src.find(">", self.pos)
            name = self.src[self.pos + 1 : end] if end > 0 else ""
            if f"(?<{name}>" not in self.src:
                raise PatternError("reference to a group that does not exist")
            self.pos = end + 1
            return f"\\k<{name}>", True
        if ch in "pP" and self.unicode:
            return self._property(ch), True
        return _literal(self._escaped_char(ch)), True

    def _property(self, kind: str) -> str:
        end = self.src.find("}", self.pos)
        name = self.src[self.pos + 1 : end] if self._peek() == "{" and end > 0 else ""
        key, eq, value = name.partition("=")
        if eq and key in ("Script", "sc") and value.isalpha():
            name = value if self.re2 else f"Is{value}"
        elif not eq and len(name) <= 2 and name.isalpha():
            pass
        else:
            raise PatternError("unsupported property")
        self.pos = end + 1
        return f"\\{kind}{{{name}}}"

    def _escaped_char(self, ch: str) -> int:
        if ch in _CONTROL:
            return {"n": 10, "r": 13, "t": 9, "v": 11, "f": 12}[ch]
        if ch == "0":
            return 0
        if ch == "c" and self._peek().isascii() and self._peek().isalpha():
            self.pos += 1
            return ord(self.src[self.pos - 1]) % 32
        if ch == "u" and self.unicode and self._peek() == "{":
            end = self.src.find("}", self.pos)
            code = self._hex(self.src[self.pos + 1 : end]) if end > 0 else None
            if code is None or code > 0x10FFFF:
                raise PatternError("invalid code point")
            self.pos = end + 1
            return code
        width = {"x": 2, "u": 4}.get(ch)
        if width:
            code = self._hex(self.src[self.pos : self.pos + width], width)
            if code is not None:
                self.pos += width
                return code
        if self.unicode and ch not in "^$\\.*+?()[]{}|/-":
            raise PatternError("invalid escape")
        return ord(ch)

    @staticmethod
    def _hex(text: str, width: int | None = None) -> int | None:
        if not text or (width and len(text) != width) or any(c not in "0123456789abcdefABCDEF" for c in text):
            return None
        return int(text, 16)

    def _char_class(self) -> str:
        negated = self._peek() == "^"
        if negated:
            self.pos += 1
        items: list[str | int] = []  # ready-made sets, or single code points
        ranges: list[str] = []
        not_space = False
        while True:
            ch = self._peek()
            if not ch:
                raise PatternError("unterminated character class")
            self.pos += 1
            if ch == "]":
                break
            item = self._class_item(ch)
            if item == "S":
                not_space = True
                continue
            if (
                isinstance(item, int)
                and self._peek() == "-"
                and self.src[self.pos + 1 : self.pos + 2] not in ("", "]")
            ):
                mark = self.pos
                self.pos += 2
                high = self._class_item(self.src[self.pos - 1])
                if isinstance(high, int):
                    if high < item:
                        raise PatternError("range out of order")
                    ranges.append(f"{_literal(item)}-{_literal(high)}")
                    continue
                self.pos = mark
            items.append(item)
        body = "".join(_literal(i) if isinstance(i, int) else i for i in items) + "".join(ranges)
        if not_space:
            self._no_re2("non-space class")
            if negated:
                return f"(?:(?![{body}])[{WS}])" if body else f"[{WS}]"
            return f"[{body}[^{WS}]]"
        if not body:
            return r"[\x{0}-\x{10FFFF}]" if negated else r"[^\x{0}-\x{10FFFF}]"
        return f"[{'^' if negated else ''}{body}]"

    def _class_item(self, ch: str) -> str | int:
        if ch != "\\":
            return ord(ch)
        esc = self._peek()
        if not esc:
            raise PatternError("trailing backslash")
        self.pos += 1
        if esc in "dws":
            return _CLASS_ESCAPES[esc]
        if esc == "D":
            return r"\x{0}-\x{2F}\x{3A}-\x{10FFFF}"
        if esc == "W":
            return r"\x{0}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{5E}\x{60}\x{7B}-\x{10FFFF}"
        if esc == "S":
            return "S"
        if esc == "b":
            return 8
        if esc in "pP" and self.unicode:
            return self._property(esc)
        return self._escaped_char(esc)


def to_java_pattern(pattern: str, flags: str = "") -> str:
    """Spell a user-written (ECMAScript) pattern for java.util.regex.

    Raises ``PatternError`` when the text is not a valid pattern or uses a
    construct that has no Java equivalent.
    """
    body = _Translator(pattern, flags).run()
    if "i" in flags:
        folding = "(?i)" if pattern.isascii() and "u" not in flags else "(?iu)"
        return folding + body
    return body


def repeats_deeply(pattern: str, flags: str = "") -> bool:
    """Whether a group repeats without a small bound.

    The Java engine takes a stack frame for every such repeat, so a long line
    would end the whole process, which no rule may do.
    """
    translator = _Translator(pattern, flags)
    translator.run()
    return not 0 < translator.repeats <= _SHALLOW_REPEATS


def to_re2_hint(pattern: str, flags: str = "") -> str:
    """An RE2 pattern that finds at least what ``pattern`` finds.

    Used to skip lines quickly; the empty pattern (which finds everything)
    stands for patterns RE2 cannot express.
    """
    try:
        body = _Translator(pattern, flags, re2=True).run()
    except PatternError:
        return ""
    return f"(?i:{body})" if "i" in flags else f"(?:{body})"
