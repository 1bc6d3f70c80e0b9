"""The pattern language of conditions: plain string functions, Java regular expressions, or automata over Arrow batches.

Patterns match whole values, any character includes newlines, `%` is the escape character and a backslash is an
ordinary one, sets may hold ranges in either order, and there are no captures, anchors or look-arounds. So the language
is regular, and matching must take linear time. Java's matcher backtracks and recurses: it only gets patterns that leave
it next to no choice. Prefixes, suffixes and contained texts become string functions, which reach the scan; everything
else is matched by Arrow's regular expressions, whose automata are linear in the value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the classes of the pattern language
LATIN_UPPER, LATIN_LOWER = "À-ÖØ-Þ", "ß-öø-ÿ"
CLASSES = {
    "a": f"A-Za-z{LATIN_UPPER}{LATIN_LOWER}",
    "c": r"\x00-\x1F\x7F-\x9F",
    "d": "0-9",
    "g": r"\x21-\x7E",
    "l": f"a-z{LATIN_LOWER}",
    "p": ".,;:?!'\"()¡¿\\-",
    "s": r"\x09-\x0D\x20",
    "u": f"A-Z{LATIN_UPPER}",
    "w": "A-Za-z0-9",
    "x": "0-9A-Fa-f",
}
MOST = 100


class PatternError(ValueError):
    """A pattern that is not valid."""


def literal(c: str, inside: bool = False) -> str:
    return f"\\{c}" if c in ("[]^\\-&" if inside else "\\.[]{}()*+?^$|") else c


#: pieces of a translated pattern: escaped characters, sets, groups, repeats, others
TOKEN = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?:|\{[\d,]+\}|.", re.S)


def choices(body: str) -> tuple[int, int, bool]:
    """Of a translated pattern: repeats with a choice, those of them without an upper bound, and whether any group repeats."""
    some = endless = 0
    grouped = False
    last = ""
    for t in TOKEN.findall(body):
        if t in ("*", "+", "?") or t[0] == "{" and len(t) > 1:
            low, comma, high = t[1:-1].partition(",") if t[0] == "{" else ("", ",", "")
            grouped = grouped or last == ")"
            if comma and low != high or t in ("*", "+", "?"):
                some += 1
                endless += t in ("*", "+") or t[0] == "{" and bool(comma) and not high
        last = t
    return some, endless, grouped


def plain(pattern: str) -> tuple[str, str, str] | None:
    """(before, text, after) of a pattern that is a literal text with `.*` at its ends, each end empty or `.*`."""
    before, after = (".*" if pattern.startswith(".*") else ""), ""
    rest = pattern[len(before) :]
    if rest.endswith(".*") and not rest.endswith("%.*"):
        rest, after = rest[:-2], ".*"
    out, k = [], 0
    while k < len(rest):
        if rest[k] == "%" and k + 1 < len(rest) and rest[k + 1] not in CLASSES:
            out.append(rest[k + 1])
            k += 2
        elif rest[k] in "%.[]{}()*+?|":
            return None
        else:
            out.append(rest[k])
            k += 1
    return (before, "".join(out), after) if out else None


def matched(text: Column, pattern: str, ignore_case: bool, in_item: bool = False) -> Column:
    """Whether the pattern matches the whole text, in time linear in it; NULL for NULL.

    in_item: inside a condition on items of an array, where Spark runs no Python. There a pattern that repeats groups,
    or repeats more than twice, is refused.
    """
    java = java_pattern(pattern, ignore_case)  # checks the pattern too
    simple = None if ignore_case else plain(pattern)
    if simple:
        before, literal_text, after = simple
        x = F.lit(literal_text)
        return F.contains(text, x) if before and after else F.startswith(text, x) if after else F.endswith(text, x) if before else text == x
    some, endless, grouped = choices(java)
    if not grouped and some <= 2 and endless <= 1:
        return text.rlike(java)
    if in_item:
        raise PatternError(f"{pattern}: repeats too much for a condition on items")
    arrow = java.replace("(?siu)", "(?si)")

    @F.arrow_udf("boolean")
    def linear(values):
        import pyarrow.compute as pc

        return pc.match_substring_regex(values, arrow)

    return linear(text)


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A Java regular expression that matches the same whole values."""
    out, k, n = [], 0, len(pattern)
    atom = False  # whether something stands before that a quantifier may follow
    depth = 0
    while k < n:
        c = pattern[k]
        if c == "%":
            if k + 1 == n:
                raise PatternError("ends in an escape")
            e = pattern[k + 1]
            out.append(f"[{CLASSES[e]}]" if e in CLASSES else literal(e))
            k, atom = k + 2, True
        elif c == "[":
            piece, k = char_set(pattern, k)
            out.append(piece)
            atom = True
        elif c in "*+?":
            if not atom:
                raise PatternError(f"{c} follows nothing that repeats")
            out.append(c)
            k, atom = k + 1, False
        elif c == "{":
            if not atom:
                raise PatternError("{ follows nothing that repeats")
            piece, k = interval(pattern, k)
            out.append(piece)
            atom = False
        elif c == "(":
            out.append("(?:")
            k, depth, atom = k + 1, depth + 1, False
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise PatternError("a group is not opened")
            out.append(")")
            k, atom = k + 1, True
        elif c == "|":
            out.append("|")
            k, atom = k + 1, False
        else:
            out.append("." if c == "." else literal(c))
            k, atom = k + 1, True
    if depth:
        raise PatternError("a group is not closed")
    return f"(?s{'iu' if ignore_case else ''})\\A(?:{''.join(out)})\\z"


def char_set(pattern: str, k: int) -> tuple[str, int]:
    k += 1
    negated = pattern[k : k + 1] == "^"
    k += negated
    items: list[str] = []
    while True:
        if k >= len(pattern):
            raise PatternError("a set is not closed")
        c = pattern[k]
        if c == "]" and items:
            break
        if c == "%" and k + 1 < len(pattern):
            e = pattern[k + 1]
            items.append(CLASSES[e] if e in CLASSES else literal(e, True))
            k += 2
            continue
        if pattern[k + 1 : k + 2] == "-" and pattern[k + 2 : k + 3] not in ("", "]"):
            a, b = sorted((c, pattern[k + 2]))
            items.append(f"{literal(a, True)}-{literal(b, True)}")
            k += 3
            continue
        items.append(literal(c, True))
        k += 1
    return f"[{'^' * negated}{''.join(items)}]", k + 1


def interval(pattern: str, k: int) -> tuple[str, int]:
    end = pattern.find("}", k)
    body = pattern[k + 1 : end] if end > 0 else ""
    low, comma, high = body.partition(",")
    if not low.isdigit() or high and not high.isdigit():
        raise PatternError("an interval needs numbers")
    if int(low) > MOST or high and (int(high) > MOST or int(high) < int(low)):
        raise PatternError(f"an interval goes up to {MOST}, the lower number first")
    return "{" + low + comma + high + "}", end + 1
