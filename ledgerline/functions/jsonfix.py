"""JSON out of answers that hold it in some broken form."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORDS = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null", "NaN": "null", "undefined": "null"}
_NUMBER = re.compile(r"[-+]?(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_BARE = re.compile(r"[^\s,:{}\[\]\"']+")
_CLOSES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
_ENDS = {"{": "}", "[": "]"}


def _string(text: str, at: int) -> tuple[str, int]:
    """A quoted string from its opening quote on, and where it ends. A quote that
    is not followed by what may follow a string belongs to it."""
    close, out, i = _CLOSES[text[at]], [], at + 1
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            try:
                size = 6 if text[i + 1] == "u" else 2
                out.append(json.loads(f'"{text[i : i + size]}"'))
            except ValueError:
                out.append(text[i + 1])
                size = 2
            i += size
        elif c == close and (close != "'" or re.match(r"\s*(?:[,:}\]]|$)", text[i + 1 :])):
            return "".join(out), i + 1
        else:
            out.append(c)
            i += 1
    return "".join(out), i


def mend(text: str | None) -> str | None:
    """The first object or list in ``text`` as valid JSON; null without one.

    Brackets that are open are kept on a stack: what is cut off is closed in
    its order, and a bracket that closes an outer one closes the inner ones too.
    Also mended: talk and code fences around it, comments, trailing or missing
    commas, single and curly quotes, names without quotes, words of Python,
    numbers with a plus sign, underscores or no digit before the point, a name
    without a value (null).
    """
    if not text:
        return None
    start = re.search(r"[{\[]", text)
    if not start:
        return None
    out: list[str] = []
    stack: list[list] = []  # [bracket, what comes next: key, colon, value or comma]
    i, n = start.start(), len(text)

    def value(piece: str) -> None:
        if stack[-1][1] == "comma":
            out.append(",")
            stack[-1][1] = "key" if stack[-1][0] == "{" else "value"
        if stack[-1][1] == "key":
            out.append(piece if piece.startswith('"') else json.dumps(piece))
            stack[-1][1] = "colon"
            return
        if stack[-1][1] == "colon":
            out.append(":")
        out.append(piece)
        stack[-1][1] = "comma"

    def close() -> None:
        bracket, wants = stack.pop()
        if bracket == "{" and wants in ("colon", "value"):
            out.append(":null" if wants == "colon" else "null")
        out.append(_ENDS[bracket])

    while i < n:
        c = text[i]
        if c in "{[":
            if stack and stack[-1][1] == "key":  # an object where a name should be
                i += 1
                continue
            if stack:
                if stack[-1][1] == "comma":
                    out.append(",")
                    if stack[-1][0] == "{":
                        stack[-1][1] = "key"
                        i += 1
                        continue
                elif stack[-1][1] == "colon":
                    out.append(":")
                stack[-1][1] = "comma"
            out.append(c)
            stack.append([c, "key" if c == "{" else "value"])
            i += 1
        elif c in "}]":
            if any(_ENDS[b] == c for b, _ in stack):
                while _ENDS[stack[-1][0]] != c:
                    close()
                close()
                if not stack:
                    return "".join(out)
            i += 1
        elif c == ":":
            if stack[-1] == ["{", "colon"]:
                out.append(":")
                stack[-1][1] = "value"
            i += 1
        elif c in _CLOSES:
            said, i = _string(text, i)
            value(json.dumps(said, ensure_ascii=False))
        elif text.startswith("//", i) or c == "#":
            i = n if (end := text.find("\n", i)) < 0 else end
        elif text.startswith("/*", i):
            i = n if (end := text.find("*/", i)) < 0 else end + 2
        elif c == "," or c.isspace():
            if c == "," and stack[-1] in (["{", "colon"], ["{", "value"]):
                out.append(":null" if stack[-1][1] == "colon" else "null")
                stack[-1][1] = "comma"
            i += 1
        else:
            bare = _BARE.match(text, i)
            word = bare[0] if bare else c
            number = _NUMBER.fullmatch(word)
            if stack[-1][1] == "key" or (stack[-1] == ["{", "comma"]):
                value(json.dumps(word, ensure_ascii=False))
            elif number:
                plain = word.replace("_", "").lstrip("+")
                plain = re.sub(r"^(-?)\.", r"\g<1>0.", plain)
                plain = re.sub(r"^(-?)0+(?=\d)", r"\1", plain)
                value(re.sub(r"\.(?=$|[eE])", ".0", plain))
            else:
                value(_WORDS.get(word) or json.dumps(word, ensure_ascii=False))
            i += len(word)
    while stack:
        close()
    return "".join(out)


@F.pandas_udf(T.StringType())
def mended_json(raw: pd.Series) -> pd.Series:
    """``mend`` of each text."""
    return raw.map(mend)
