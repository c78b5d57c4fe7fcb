"""Texts that are to be one JSON document and nothing else, and the JSON objects inside longer texts."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reading JSON as it is defined: no single quotes, no raw control characters inside strings.
STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowUnquotedControlChars": "false"}
#: A text that no document holds: where it is read, what stands before it was read whole.
END_MARK = f"end-{uuid.uuid4().hex}"


def is_json(text: Column) -> Column:
    """Whether the text is one JSON value, strictly. Put before a mark in an array, the text is one value if
    the array has two elements, the second of them the mark. NaN and Infinity are numbers, as many writers of
    JSON have it. Null text is none."""
    whole = F.from_json(F.concat(F.lit("["), text, F.lit(f',"{END_MARK}"]')), "array<string>", STRICT)
    return F.coalesce((F.size(whole) == 2) & (F.get(whole, F.lit(1)) == END_MARK), F.lit(False))


def with_end_mark(text: Column) -> Column:
    """The text of an object with a last field ``END_MARK``. Read into a struct that has this field, it is
    null if the object ended early or words follow it. Null for texts that can't be an object."""
    text = F.btrim(text, F.lit(" \t\r\n"))
    body = F.substring(text, F.lit(1), F.char_length(text) - 1)
    glue = F.when(text.rlike(r"^\{\s*\}"), F.lit("")).otherwise(F.lit(","))
    return F.when(text.startswith("{") & text.endswith("}"), F.concat(body, glue, F.lit(f'"{END_MARK}":1}}')))


_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|("[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")'
    r"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|NaN|-?Infinity))")
#: Objects that open inside one another, up to the value of the last one's first key, without a brace in a key; a brace that may open an object.
_OPENINGS = re.compile(r'(?:[ \t\n\r]*+\{[ \t\n\r]*+"[^"\\\x00-\x1f{]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f{]*+)*+"[ \t\n\r]*+:)++')
_BRACE = re.compile(r'\{(?=[ \t\n\r]*["}])')
#: What may follow: the states of the automaton.
_KEY_OR_END, _KEY, _COLON, _VALUE, _VALUE_OR_END, _NEXT = range(6)


def _read(text: str, start: int, done: dict[int, int], failed: dict[int, int]) -> None:
    """Read the object that opens at ``start`` as far as it is JSON, each token once.

    Objects inside it that are complete go to ``done`` (start to end), open ones to ``failed`` (the first of a run that opens
    inside one another, to behind the last). What makes the outer object fail makes the open inner ones fail as well, so none of
    them is read again.
    """
    stack: list[list] = []  # brackets and runs of braces: kind, first, behind the last
    state, at = _VALUE, start
    while True:
        if state in (_VALUE, _VALUE_OR_END) and (run := _OPENINGS.match(text, at)):
            stack.append(["{", text.index("{", at), run.end()])
            at, state = run.end(), _VALUE
        token = _TOKEN.match(text, at)
        if token is None:
            break
        at = token.end()
        mark = token[1]
        if mark == "{" and state in (_VALUE, _VALUE_OR_END):
            stack.append(["{", at - 1, at])
            state = _KEY_OR_END
        elif mark == "[" and state in (_VALUE, _VALUE_OR_END):
            stack.append(["[", at - 1, at])
            state = _VALUE_OR_END
        elif mark == "}" and stack[-1][0] == "{" and state in (_KEY_OR_END, _NEXT):
            run = stack[-1]
            opened = text.rindex("{", run[1], run[2])
            done[opened] = at
            run[2] = opened
            if opened == run[1]:
                stack.pop()
                if not stack:
                    return
            state = _NEXT
        elif mark == "]" and stack[-1][0] == "[" and state in (_VALUE_OR_END, _NEXT):
            stack.pop()
            state = _NEXT
        elif mark == "," and state == _NEXT:
            state = _KEY if stack[-1][0] == "{" else _VALUE
        elif mark == ":" and state == _COLON:
            state = _VALUE
        elif token[2] and state in (_KEY_OR_END, _KEY):
            state = _COLON
        elif mark is None and state in (_VALUE, _VALUE_OR_END):
            state = _NEXT
        else:
            break
    failed.update((first, behind) for kind, first, behind in stack if kind == "{")


def objects_in(text: str) -> list[str]:
    """The JSON objects in a text, one after the other, each the outermost that is complete.

    One pass: the automaton reads from a brace to where the text stops being JSON. Braces it has read on the way are
    settled; only those it took for part of a string are tried again, where quotes open and close the other way round. A brace that
    neither a key nor the closing brace follows opens no object and is passed over.
    """
    done: dict[int, int] = {}
    failed: dict[int, int] = {}
    found, brace = [], _BRACE.search(text)
    while brace:
        at = brace.start()
        if at not in done and at not in failed:
            _read(text, at, done, failed)
        if at in done:
            found.append(text[at:done[at]])
        brace = _BRACE.search(text, done[at] if at in done else failed[at])
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_objects(texts: pd.Series) -> pd.Series:
    """The JSON objects in each text, in time linear in its length. Null texts have none."""
    return texts.map(lambda t: [] if t is None else objects_in(t))
