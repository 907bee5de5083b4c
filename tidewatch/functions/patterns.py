"""Python's regular expressions as Java's: patterns of the same meaning for rlike and the regexp functions.

`java` walks the syntax tree that Python has of a pattern and prints a Java pattern that finds the same matches. White space,
digits, word characters and their boundaries are Unicode's; a letter under (?i) becomes the class of all characters that
Python takes for it; ^, $, . and line ends have Python's sense. Groups keep their numbers and lose their names. What has no
counterpart (conditional groups, references without regard to case) is a ValueError and never an approximation. Letters and
digits that are newer than the JVM's Unicode version are none there.

`factors` takes from the same tree texts of which any match must hold one, so a test for them on a whole file is a superset
of tests of its lines, whatever the pattern's anchors and lookarounds.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

#: Characters as ranges; they are Python's \s, and ASCII's.
_SPACE = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_ASCII_SPACE = ((0x09, 0x0D), (0x20, 0x20))
#: Characters that have more than one case.
_CASED = "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x1F000)]) if c.lower() != c or c.upper() != c or c.title() != c)
#: Any character.
_ANY = r"[\x{0}-\x{10ffff}]"


class Untranslatable(ValueError):
    """A pattern holds what Java can't say in the same sense."""


def _escaped(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and (c.isalnum() or c in "_ ") else f"\\{c}" if 33 <= code < 127 else f"\\x{{{code:x}}}"


def _ranges(ranges: Iterable[tuple[int, int]]) -> str:
    return "".join(_escaped(a) if a == b else f"{_escaped(a)}-{_escaped(b)}" for a, b in ranges)


_WORD = {False: r"\p{L}\p{N}_", True: "A-Za-z0-9_"}
_CLASSES = {
    "SPACE": {False: _ranges(_SPACE), True: _ranges(_ASCII_SPACE)},
    "DIGIT": {False: r"\p{Nd}", True: "0-9"},
    "WORD": _WORD,
}


@lru_cache(None)
def _variants(source: str, flags: int) -> tuple[int, ...]:
    """Characters that a pattern for one character takes only without regard to case."""
    with_, without = (set(re.findall(source, _CASED, f)) for f in (flags | re.IGNORECASE, flags))
    return tuple(sorted(map(ord, with_ - without)))


def _joined_ranges(codes: Iterable[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in sorted(codes):
        if out and c == out[-1][1] + 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def _literal(code: int, flags: int) -> str:
    if not flags & re.IGNORECASE:
        return _escaped(code)
    others = _variants(re.escape(chr(code)), flags & re.ASCII)
    return f"[{_ranges(_joined_ranges({code, *others}))}]" if others else _escaped(code)


def _source(items: list) -> str:
    """The members of a class as Python's source."""
    letters = {"DIGIT": "d", "SPACE": "s", "WORD": "w"}
    out = []
    for op, arg in items:
        match str(op):
            case "LITERAL":
                out.append(f"\\U{arg:08x}")
            case "RANGE":
                out.append(f"\\U{arg[0]:08x}-\\U{arg[1]:08x}")
            case "CATEGORY":
                kind = str(arg).removeprefix("CATEGORY_")
                out.append("\\" + (letters[kind[4:]].upper() if kind.startswith("NOT_") else letters[kind]))
    return f"[{''.join(out)}]"


def _class(items: list, flags: int) -> str:
    negated = str(items[0][0]) == "NEGATE"
    members = items[1:] if negated else items
    inner, complements = [], []
    for op, arg in members:
        match str(op):
            case "LITERAL":
                inner.append(_escaped(arg))
            case "RANGE":
                inner.append(_ranges([arg]))
            case "CATEGORY":
                kind = str(arg).removeprefix("CATEGORY_")
                if kind.startswith("NOT_"):
                    complements.append(f"[^{_CLASSES[kind[4:]][bool(flags & re.ASCII)]}]")
                else:
                    inner.append(_CLASSES[kind][bool(flags & re.ASCII)])
            case other:
                raise Untranslatable(f"class member {other}")
    if flags & re.IGNORECASE:
        inner.append(_ranges(_joined_ranges(_variants(_source(members), flags & re.ASCII))))
    body = "".join(inner)
    if not complements:
        return f"[{'^' if negated else ''}{body}]"
    either = "|".join([*complements, *([f"[{body}]"] if body else [])])
    # Java takes a complement inside a negated class differently from version to version.
    return f"(?:(?!{either}){_ANY})" if negated else f"(?:{either})"


def _members_are(items: list, flags: int, word: bool) -> bool:
    """Whether all members of a class are word characters, or none is."""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            good = _is_word(arg, flags) == word
        elif name == "RANGE":
            good = arg[1] < 128 and all(_is_word(c, flags) == word for c in range(arg[0], arg[1] + 1))
        elif name == "CATEGORY":
            good = str(arg).removeprefix("CATEGORY_") in (("DIGIT", "WORD") if word else ("SPACE", "NOT_WORD"))
        else:
            good = False
        if not good:
            return False
    return True


def _is_word(code: int, flags: int) -> bool:
    c = chr(code)
    return (c.isalnum() or c == "_") and (c.isascii() or not flags & re.ASCII)


def _edge(sequence: list, flags: int, last: bool, word: bool) -> bool:
    """Whether the first (or last) character of every match of the sequence is a word character (or is none)."""
    if not len(sequence):
        return False
    op, arg = sequence[-1 if last else 0]
    match str(op):
        case "LITERAL":
            return _is_word(arg, flags) == word
        case "IN":
            return _members_are(list(arg), flags, word)
        case "SUBPATTERN":
            return _edge(arg[3], _flags(flags, arg), last, word)
        case "ATOMIC_GROUP":
            return _edge(arg, flags, last, word)
        case "BRANCH":
            return all(_edge(s, flags, last, word) for s in arg[1])
        case "MAX_REPEAT" | "MIN_REPEAT" | "POSSESSIVE_REPEAT":
            return arg[0] > 0 and _edge(arg[2], flags, last, word)
    return False


def _flags(flags: int, group: tuple) -> int:
    return (flags | group[1]) & ~group[2]


def _at(where: str, before: list, after: list, flags: int) -> str:
    w = f"[{_WORD[bool(flags & re.ASCII)]}]"
    match where:
        case "AT_BEGINNING":
            return r"(?<![^\n])" if flags & re.MULTILINE else r"\A"
        case "AT_BEGINNING_STRING":
            return r"\A"
        case "AT_END":
            return r"(?![^\n])" if flags & re.MULTILINE else r"(?=\n?\z)"
        case "AT_END_STRING":
            return r"\z"
        case "AT_BOUNDARY":
            # What stands beside it decides most boundaries by one look.
            if _edge(after, flags, False, True):
                return f"(?<!{w})"
            if _edge(after, flags, False, False):
                return f"(?<={w})"
            if _edge(before, flags, True, True):
                return f"(?!{w})"
            if _edge(before, flags, True, False):
                return f"(?={w})"
            return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
        case "AT_NON_BOUNDARY":
            return rf"(?:(?<={w})(?={w})|(?<!{w})(?!{w})(?!\A\z))"
    raise Untranslatable(where)


def _printed(sequence, flags: int) -> str:
    nodes = list(sequence)
    out = []
    for i, (op, arg) in enumerate(nodes):
        match str(op):
            case "LITERAL":
                out.append(_literal(arg, flags))
            case "NOT_LITERAL":
                out.append(_class([("NEGATE", None), ("LITERAL", arg)], flags))
            case "IN":
                out.append(_class(list(arg), flags))
            case "ANY":
                out.append(_ANY if flags & re.DOTALL else r"[^\n]")
            case "AT":
                out.append(_at(str(arg), nodes[:i], nodes[i + 1 :], flags))
            case "BRANCH":
                out.append("(?:" + "|".join(_printed(s, flags) for s in arg[1]) + ")")
            case "SUBPATTERN":
                out.append(("(?:" if arg[0] is None else "(") + _printed(arg[3], _flags(flags, arg)) + ")")
            case "ATOMIC_GROUP":
                out.append(f"(?>{_printed(arg, flags)})")
            case "MAX_REPEAT" | "MIN_REPEAT" | "POSSESSIVE_REPEAT" as kind:
                low, high, body = arg
                most = "" if high is re._constants.MAXREPEAT else high
                if most != "" and most > 0x7FFFFFFF or low > 0x7FFFFFFF:
                    raise Untranslatable("a repetition beyond the JVM's numbers")
                times = {(0, ""): "*", (1, ""): "+", (0, 1): "?"}.get((low, most), f"{{{low}}}" if low == most else f"{{{low},{most}}}")
                inner = _printed(body, flags)
                if len(body) > 1 or str(body[0][0]) not in ("LITERAL", "NOT_LITERAL", "IN", "ANY") or inner.startswith("("):
                    inner = f"(?:{inner})"
                out.append(inner + times + {"MAX_REPEAT": "", "MIN_REPEAT": "?", "POSSESSIVE_REPEAT": "+"}[kind])
            case "ASSERT" | "ASSERT_NOT" as kind:
                out.append("(?" + ("<" if arg[0] < 0 else "") + ("=" if kind == "ASSERT" else "!") + _printed(arg[1], flags) + ")")
            case "FAILURE":
                out.append("(?!)")
            case "GROUPREF" if not flags & re.IGNORECASE:
                out.append(f"(?:\\{arg})")
            case other:
                raise Untranslatable(other)
    return "".join(out)


def _parsed(pattern: str):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return re._parser.parse(pattern)


@lru_cache(4096)
def java(pattern: str) -> str:
    """The Java pattern that matches where Python's `re` matches; re.error or Untranslatable if there is none."""
    tree = _parsed(pattern)
    return _printed(tree, tree.state.flags)


@dataclass(frozen=True)
class _Text:
    """A text that a match must hold: characters with the flags under which each is matched."""

    letters: tuple[tuple[int, int], ...]

    def printed(self) -> str:
        return "".join(_literal(code, flags) for code, flags in self.letters)

    def plain(self) -> str | None:
        """The text itself, if its case counts."""
        return None if any(flags & re.IGNORECASE for _, flags in self.letters) else "".join(chr(code) for code, _ in self.letters)


def _flat(sequence, flags: int) -> Iterator[tuple[str, object, int]]:
    """The nodes of a sequence in order, groups resolved."""
    for op, arg in sequence:
        if str(op) == "SUBPATTERN":
            yield from _flat(arg[3], _flags(flags, arg))
        elif str(op) == "ATOMIC_GROUP":
            yield from _flat(arg, flags)
        else:
            yield str(op), arg, flags


def _all_required(sequence, flags: int) -> list[tuple[_Text, ...]]:
    """Sets of texts: every match of the sequence holds one of each set."""
    options: list[tuple[_Text, ...]] = []
    run: list[tuple[int, int]] = []
    for name, arg, own in [*_flat(sequence, flags), ("END", None, 0)]:
        if name == "LITERAL":
            run.append((arg, own))
            continue
        if name == "AT":
            continue  # stands between characters and takes none
        if run:
            options.append((_Text(tuple(run)),))
            run = []
        if name == "BRANCH":
            parts = [_required(s, own) for s in arg[1]]
            if all(parts):
                options.append(tuple(dict.fromkeys(t for p in parts for t in p)))
        elif name.endswith("_REPEAT") and arg[0] > 0:
            options += _all_required(arg[2], own)
        elif name == "ASSERT":
            options += _all_required(arg[1], own)
    return options


def _required(sequence, flags: int) -> tuple[_Text, ...] | None:
    """Of all sets of which every match holds a text the one whose shortest text is longest."""
    return max(_all_required(sequence, flags), key=lambda o: (min(len(t.letters) for t in o), -len(o)), default=None)


@lru_cache(4096)
def factors(pattern: str) -> tuple[str, ...] | None:
    """Java patterns of plain texts of which every match holds one, or None where the pattern has no such texts."""
    tree = _parsed(pattern)
    found = _required(tree, tree.state.flags)
    return None if found is None else tuple(t.printed() for t in found)


@lru_cache(4096)
def needs(pattern: str) -> tuple[str, ...]:
    """Java patterns of plain texts, each of which is found wherever the pattern matches."""
    tree = _parsed(pattern)
    return tuple(dict.fromkeys("|".join(t.printed() for t in option) for option in _all_required(tree, tree.state.flags)))


def plain_texts(pattern: str) -> tuple[str, ...] | None:
    """Texts of which every match holds one as they stand, or None where the pattern has no such texts."""
    tree = _parsed(pattern)
    found = _required(tree, tree.state.flags)
    texts = found and tuple(t.plain() for t in found)
    return texts if texts and all(texts) else None


def _one_of(texts: Iterable[str]) -> str:
    """A pattern for one of the texts, told apart a character at a time: most places of a text fail at the first."""
    tails: dict[str, set[str]] = {}
    for t in texts:
        if not t:
            return ""
        tails.setdefault(t[0], set()).add(t[1:])
    return "(?:" + "|".join(_escaped(ord(c)) + (_one_of(rest) if len(rest) > 1 else "".join(_escaped(ord(x)) for x in rest.pop())) for c, rest in sorted(tails.items())) + ")"


@lru_cache(4096)
def low_prefilter(patterns: tuple[str, ...]) -> tuple[str, str] | None:
    """A Java pattern for the lower case of a text, and characters: where one of the patterns matches a part of the text, its lower
    case has the pattern, or one of the characters, which lower case leaves apart from the ASCII letter whose other case they
    are. None: the patterns need no ASCII texts.

    The pattern has one case of each letter, which a matcher reads faster than all of them.
    """
    texts, others = set(), set()
    for pattern in patterns:
        tree = _parsed(pattern)
        found = _required(tree, tree.state.flags)
        if not found or not all(code < 128 for t in found for code, _ in t.letters):
            return None
        texts |= {"".join(chr(code) for code, _ in t.letters).lower() for t in found}
        others |= {c for t in found for code, flags in t.letters if flags & re.IGNORECASE for c in _variants(re.escape(chr(code)), flags & re.ASCII)}
    others = {c for code in others for c in chr(code).lower() if not c.isascii()}
    first = "".join(_escaped(ord(c)) for c in sorted({t[0] for t in texts}))
    return (f"(?=[{first}]){_one_of(texts)}", "".join(sorted(others))) if texts else None


def prefilter(patterns: Iterable[str]) -> str | None:
    """A Java pattern that is found in every text in which one of the patterns matches a part, or None: nothing is ruled out."""
    known = [factors(p) for p in patterns]
    return None if not known or not all(known) else "|".join(dict.fromkeys(f for own in known for f in own))
