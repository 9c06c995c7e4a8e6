"""Repair of recognised LaTeX. What needs a stack or a fixed point runs in Python, a batch of
strings at a time; null counts as empty."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Delimiters that may follow \left and \right.
DELIMITERS = ["(", ")", "[", "]", "{", "}", "/", "|", "\\{", "\\}", "\\lceil", "\\rceil", "\\lfloor", "\\rfloor", "\\backslash", "\\uparrow", "\\downarrow", "\\Uparrow", "\\Downarrow", "\\|", "\\."]
#: Environments that are closed if they are not.
ENVIRONMENTS = ["array", "matrix", "pmatrix", "bmatrix", "vmatrix", "Bmatrix", "Vmatrix", "cases", "aligned", "gathered"]
#: Commands that go, and commands that stand for others, in this order.
GONE = ["lefteqn", "boldmath", "ensuremath", "centering", "textsubscript", "sides", "textsl", "textcent", "emph", "protect", "null"]
SWAPS = [
    ("\\underbar", "\\underline"), ("\\Bar", "\\hat"), ("\\Hat", "\\hat"), ("\\Tilde", "\\tilde"), ("\\slash", "/"), ("\\textperthousand", "‰"),
    ("\\sun", "☉"), ("\\textunderscore", "\\_"), ("\\fint", "⨏"), ("\\up ", "\\ "), ("\\vline = ", "\\models "), ("\\vDash ", "\\models "),
    ("\\sq \\sqcup ", "\\square "), ("\\copyright", "©"),
]
#: Names after \up that are commands of their own, and what may follow a backslash.
UP_NAMES = {"arrow", "downarrow", "lus", "silon"}
AFTER_BACKSLASH = set("#$%&~_^|\\{} \t\n\r\v\f")
_MARKS = re.compile(r"\\left.|\\right.|\\.|[{}]", re.S)


def balance_braces(s: str) -> str:
    """Without the braces that have no partner; a brace behind a backslash is a symbol."""
    open_, drop = [], set()
    for m in re.finditer(r"\\.|[{}]", s, re.S):
        if m[0] == "{":
            open_.append(m.start())
        elif m[0] == "}" and open_:
            open_.pop()
        elif m[0] == "}":
            drop.add(m.start())
    drop.update(open_)
    return "".join(c for i, c in enumerate(s) if i not in drop)


def _same_group(s: str) -> str:
    """Each \\right that stands in another group than its \\left moves to the end of the \\left's."""
    depth, lefts, ends, moves = 0, [], [], []
    for m in _MARKS.finditer(s):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= depth > 0
            for left in lefts:  # a group that a \left stands in ends here
                if left[1] > depth and left[2] is None:
                    left[2] = m.start()
            for move in moves:
                if move[2] is None and move[3] > depth:
                    move[2] = m.start()
        elif m[0].startswith("\\left") and len(m[0]) == 6:
            lefts.append([m.start(), depth, None])
        elif m[0].startswith("\\right") and len(m[0]) == 7 and lefts:
            start, at, end = lefts.pop()
            if at != depth:
                moves.append([m.start(), m.end(), end, at])
    for start, end, to, _ in sorted((m for m in moves if m[2] is not None), reverse=True):
        part = s[start:end]
        s = s[:start] + s[end:]
        s = s[:to] + part + s[to:]
    return s


def pair_delimiters(s: str) -> str:
    """\\left and \\right with a delimiter each; all of them go if their numbers differ."""
    ok = "|".join(map(re.escape, DELIMITERS))
    s = re.sub(rf"\\(left|right)(?!(?:{ok})(?!\S))\S*", r"\\\1.", s)
    if len(re.findall(r"\\left(?![a-zA-Z])", s)) != len(re.findall(r"\\right(?![a-zA-Z])", s)):
        return re.sub(r"\\(?:left|right)\.?", "", s)
    return _same_group(s)


def close_environments(s: str) -> str:
    for name in ENVIRONMENTS:
        begin, end = f"\\begin{{{name}}}", f"\\end{{{name}}}"
        missing = s.count(end) - s.count(begin)
        if missing > 0:
            form = re.search(re.escape(begin) + r"\{([^}]*)\}", s)
            s = (begin + (f"{{{form[1]}}}" if form else "{c}" if name == "array" else "") + " ") * missing + s
        elif missing < 0:
            s += f" {end}" * -missing
    return s


def _backslash(m: re.Match) -> str:
    c, after = m[1], m.string[m.start() + 2 : m.start() + 3]
    letter = lambda x: x.isascii() and x.isalpha()
    return m[0] if c in AFTER_BACKSLASH or letter(c) and letter(after) else f"\\ {c}"


def clean(s: str) -> str:
    """Braces, delimiters and environments in pairs, unknown commands gone, one-letter commands
    apart from their backslash."""
    s = close_environments(pair_delimiters(balance_braces(s)))
    s = re.sub(r"\\up([a-zA-Z]+)", lambda m: m[0] if m[1] in UP_NAMES else f"\\{m[1]}", s)
    s = re.sub(r"\\(?:" + "|".join(GONE) + ")", "", s)
    for old, new in SWAPS:
        s = s.replace(old, new)
    s = re.sub(r"\\(.)", _backslash, s)
    return re.sub(r"\\qquad(?!\s)", r"\\qquad ", s).rstrip("\\")


#: Commands within whose braces words keep their spaces.
_WORDS = re.compile(r"\\(?:operatorname|mathrm|text|mathbf)\s?\*? \{.*?\}")
_OTHER = r"[\W_^\d]"


def normal_spaces(s: str) -> str:
    """Decoder output without needless spaces: none beside what is no letter, but after a backslash;
    a command within \\text and its like keeps the one behind it. \\text round Chinese goes."""
    def guarded(m: re.Match) -> str:
        return re.sub(r"(\\(?!operatorname\b|mathrm\b|text\b|mathbf\b)[a-zA-Z]+)\s(?=\w)", "\\1\u0001", m[0])

    s = _WORDS.sub(guarded, s)
    while True:
        new = re.sub(rf"(?!\\ )({_OTHER})\s+?({_OTHER})", r"\1\2", s)
        new = re.sub(rf"(?!\\ )({_OTHER})\s+?([a-zA-Z])", r"\1\2", new)
        new = re.sub(rf"([a-zA-Z])\s+?({_OTHER})", r"\1\2", new)
        if new == s:
            break
        s = new
    s = re.sub(r"\\text\s*{\s*([^}]*?[\u4e00-\u9fff]+[^}]*?)\s*}", r"\1", s)
    return s.replace("\u0001", " ")


def column(f: Callable[[str], str], s: Column) -> Column:
    """A string function over a column, a batch at a time."""
    @F.pandas_udf(StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(f)

    return run(F.coalesce(s, F.lit("")))
