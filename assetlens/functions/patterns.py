"""Python's regular expressions as Java's, from the parsed pattern, so that searches find the same rows."""

from __future__ import annotations

import re
from re import _constants as codes
from re import _parser as parser

from assetlens.errors import SearchPatternError

# What Python's classes of characters mean in text, in Java's terms.
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ASCII = {"WORD": "a-zA-Z0-9_", "DIGIT": "0-9", "SPACE": r"\t-\r\x20"}
WIDE = {"WORD": WORD, "DIGIT": DIGIT, "SPACE": SPACE}


def java_pattern(pattern: str) -> str:
    """A pattern with which Java, ignoring case, finds what Python's `re` finds with `pattern`.

    Groups are numbered, whatever they are called; ends of text and line, `.`, and classes of characters are
    written out, as the engines differ in them. A pattern that is none, or that Java cannot express
    (a choice by whether a group took part), raises `SearchPatternError`.
    """
    try:
        re.compile(pattern, re.IGNORECASE)  # refuses some that can be parsed
        tree = parser.parse(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError) as error:
        raise SearchPatternError(f"{pattern!r}: {error}") from error
    return Translation(pattern).sequence(tree, tree.state.flags)


class Translation:
    """The parts of one pattern, each as Java's."""

    def __init__(self, pattern: str) -> None:
        self.pattern = pattern

    def sequence(self, items, flags: int) -> str:
        return "".join(self.item(op, value, flags) for op, value in items)

    def refused(self, what: str) -> SearchPatternError:
        return SearchPatternError(f"{self.pattern!r}: {what} cannot be searched for")

    def item(self, op, value, flags: int) -> str:
        name = str(op)
        method = getattr(self, f"on_{name.lower()}", None)
        if method is None:
            raise self.refused(name.lower())
        return method(value, flags)

    def on_literal(self, value: int, flags: int) -> str:
        return character(value)

    def on_not_literal(self, value: int, flags: int) -> str:
        return f"[^{character(value)}]"

    def on_any(self, value, flags: int) -> str:
        return r"[\x{0}-\x{10FFFF}]" if flags & re.DOTALL else r"[^\n]"

    def on_in(self, items, flags: int) -> str:
        negated = bool(items) and items[0][0] is codes.NEGATE
        parts = [self.member(op, value, flags) for op, value in items if op is not codes.NEGATE]
        # One class of classes: a negated member must not reach the others.
        union = "".join(f"[{part}]" for part in parts)
        return f"[^{union}]" if negated else f"[{union}]"

    def member(self, op, value, flags: int) -> str:
        if op is codes.LITERAL:
            return character(value)
        if op is codes.RANGE:
            return f"{character(value[0])}-{character(value[1])}"
        return self.category(value, flags)

    def category(self, value, flags: int) -> str:
        name = str(value).removeprefix("CATEGORY_")
        table = ASCII if flags & re.ASCII else WIDE
        return f"^{table[name.removeprefix('NOT_')]}" if name.startswith("NOT_") else table[name]

    def on_category(self, value, flags: int) -> str:
        return f"[{self.category(value, flags)}]"

    def on_at(self, value, flags: int) -> str:
        word = f"[{(ASCII if flags & re.ASCII else WIDE)['WORD']}]"
        many = flags & re.MULTILINE
        places = {
            "AT_BEGINNING": r"(?:\A|(?<=\n))" if many else r"\A",
            "AT_BEGINNING_STRING": r"\A",
            "AT_END": r"(?=\n|\z)" if many else r"(?=\n?\z)",
            "AT_END_STRING": r"\z",
            "AT_BOUNDARY": f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))",
            "AT_NON_BOUNDARY": f"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))",
        }
        return places[str(value)]

    def on_branch(self, value, flags: int) -> str:
        return "(?:" + "|".join(self.sequence(branch, flags) for branch in value[1]) + ")"

    def on_subpattern(self, value, flags: int) -> str:
        number, added, removed, items = value
        inner = (flags | added) & ~removed
        case = "" if not (removed & re.IGNORECASE) else "(?-iu)"
        text = case + self.sequence(items, inner)
        return f"({text})" if number is not None else f"(?:{text})"

    def on_groupref(self, value: int, flags: int) -> str:
        return rf"(?:\{value})"

    def on_atomic_group(self, value, flags: int) -> str:
        return f"(?>{self.sequence(value, flags)})"

    def on_assert(self, value, flags: int) -> str:
        direction, items = value
        return f"(?{'=' if direction > 0 else '<='}{self.sequence(items, flags)})"

    def on_assert_not(self, value, flags: int) -> str:
        direction, items = value
        return f"(?{'!' if direction > 0 else '<!'}{self.sequence(items, flags)})"

    def on_failure(self, value, flags: int) -> str:
        return "(?!)"

    def repeated(self, value, flags: int, kind: str) -> str:
        least, most, items = value
        most = "" if most is codes.MAXREPEAT else str(int(most))
        return f"(?:{self.sequence(items, flags)}){{{int(least)},{most}}}{kind}"

    def on_max_repeat(self, value, flags: int) -> str:
        return self.repeated(value, flags, "")

    def on_min_repeat(self, value, flags: int) -> str:
        return self.repeated(value, flags, "?")

    def on_possessive_repeat(self, value, flags: int) -> str:
        return self.repeated(value, flags, "+")


def character(value: int) -> str:
    """A character that means itself, in a class or outside."""
    one = chr(value)
    return one if one.isascii() and one.isalnum() else f"\\x{{{value:X}}}"
