"""Literals that any match of a regular expression must hold."""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shorter literals say too little about where a pattern can match.
LEAST_LITERAL = 3
#: What changes the meaning of the characters of a pattern: free spacing, Unicode case, quoting, escapes with arguments.
_UNREAD = re.compile(r"\(\?[a-zA-Z-]*[xuU]|\\[QEXxucpPkN0-9]")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _behind_group(regex: str, at: int) -> int:
    """The place behind the group that opens at ``at``; -1 if it can't be told."""
    depth = 0
    while at < len(regex):
        c = regex[at]
        if c == "\\":
            at += 1
        elif c == "[":
            at = _behind_class(regex, at) - 1
            if at < 0:
                return -1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return -1


def _behind_class(regex: str, at: int) -> int:
    """The place behind the character class that opens at ``at``; -1 if it can't be told."""
    start = at + 1 + (regex[at + 1:at + 2] == "^")
    if regex[start:start + 1] in ("]", ""):
        return -1
    depth = 0
    while at < len(regex):
        c = regex[at]
        if c == "\\":
            at += 1
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return -1


def literals_of(regex: str) -> list[str]:
    """For each top-level alternative the longest text that its matches hold, A to Z in lower case; none if one
    alternative has no text of ``LEAST_LITERAL`` characters, or the pattern has parts that aren't read here.

    Groups, classes, escapes and quantified characters only end a text; what they match isn't looked at.
    """
    if _UNREAD.search(regex):
        return []
    longest, run, at = [""], "", 0

    def close(kept: str) -> str:
        longest[-1] = max(longest[-1], kept, key=len)
        return ""

    while at < len(regex):
        c = regex[at]
        if c in "*?{":  # what stands before may be absent
            run = close(run[:-1])
            at = regex.find("}", at) + 1 if c == "{" else at + 1
            if not at:
                return []
            continue
        if c in "([":
            run = close(run)
            at = _behind_group(regex, at) if c == "(" else _behind_class(regex, at)
            if at < 0:
                return []
            continue
        if c == "|":
            run = close(run)
            longest.append("")
        elif c in ".^$+":
            run = close(run)
        elif c == "\\":
            at += 1
            run = run + regex[at:at + 1] if regex[at:at + 1] and not regex[at].isalnum() else close(run)
        else:
            run += c
        at += 1
    close(run)
    found = list(dict.fromkeys(x.translate(_LOWER) for x in longest))
    return found if all(len(x) >= LEAST_LITERAL for x in found) else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def required_literals(regexes: pd.Series) -> pd.Series:
    """``literals_of`` each pattern of a column."""
    return regexes.map(lambda r: [] if r is None else literals_of(r))
