"""Repair of broken JSON, line by line, with the place of each fault, and a quarantine for what can't be mended.

A pushdown parser reads on behind a fault: strings that are open to the end, or in single quotes; bare words; comments;
missing and surplus commas, colons and values; brackets that are missing, cut off or of the other kind. A line is
quarantined if it holds no object or list, if text is left behind it, or if it has more than `most` faults. Only
lines that Spark's own parser refuses come here.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.])")
_BARE = re.compile(r"[^\s,:{}\[\]\"']+")
_SPACE = re.compile(r"\s+")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.DOTALL)
_CONSTANTS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None, "NaN": None, "undefined": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_OTHER = {"}": "{", "]": "["}
FAULTS = "array<struct<place:int,kind:string>>"


class Unmendable(ValueError):
    pass


def _string(text: str, at: int, faults: list) -> tuple[str, int]:
    quote, i, out = text[at], at + 1, []
    if quote == "'":
        faults.append((at, "single quotes"))
    while i < len(text):
        c = text[i]
        if c == quote:
            return "".join(out), i + 1
        if c == "\\" and i + 1 < len(text):
            code = text[i + 2 : i + 6]
            if text[i + 1] == "u" and re.fullmatch("[0-9a-fA-F]{4}", code):
                out.append(chr(int(code, 16)))
                i += 6
                continue
            out.append(_ESCAPES.get(text[i + 1], text[i + 1]))
            i += 2
            continue
        if c < " ":
            faults.append((i, "control sign"))
        out.append(c)
        i += 1
    faults.append((at, "open string"))
    return "".join(out), i


def _tokens(text: str, faults: list):
    """(place, kind, value); kind is a bracket, a comma, a colon or v for a value."""
    at = 0
    while at < len(text):
        c = text[at]
        if m := _SPACE.match(text, at):
            at = m.end()
        elif m := _COMMENT.match(text, at):
            faults.append((at, "comment"))
            at = m.end()
        elif c in "{}[],:":
            yield at, c, None
            at += 1
        elif c in "\"'":
            value, end = _string(text, at, faults)
            yield at, "v", value
            at = end
        elif m := _NUMBER.match(text, at):
            yield at, "v", json.loads(m[0])
            at = m.end()
        else:
            m = _BARE.match(text, at)
            if m[0] not in ("true", "false", "null"):
                faults.append((at, "bare word"))
            yield at, "v", _CONSTANTS.get(m[0], m[0])
            at = m.end()


def mend(text: str, most: int = 8) -> tuple[object, list[tuple[int, str]]]:
    """The value, and the faults by place; Unmendable says why there is none."""
    faults: list[tuple[int, str]] = []
    stack: list[list] = []  # kind of bracket, what it holds, the open key, whether a comma may come or must
    top: list = []

    def put(value, at):
        kind, held, key, want = stack[-1]
        if want == "comma":
            faults.append((at, "missing comma"))
        if kind == "[":
            held.append(value)
            stack[-1][3] = "comma"
        elif want in ("key", "comma"):
            if not isinstance(value, str):
                faults.append((at, "key without quotes"))
                value = json.dumps(value)
            stack[-1][2:] = [value, "colon"]
        else:
            if want == "colon":
                faults.append((at, "missing colon"))
            held[key] = value
            stack[-1][2:] = [None, "comma"]

    def close(at, known=True):
        kind, held, key, want = stack.pop()
        if want in ("colon", "value") and kind == "{":
            faults.append((at, "missing value"))
            held[key] = None
        elif want == "after" and known:
            faults.append((at, "surplus comma"))
        if stack:
            put(held, at)
        else:
            top.append(held)

    for at, c, value in _tokens(text, faults):
        if top:
            raise Unmendable(f"text behind the value at {at}")
        if c in "{[":
            if stack and stack[-1][0] == "{" and stack[-1][3] in ("key", "comma", "after"):
                raise Unmendable(f"a bracket in place of a key at {at}")
            stack.append([c, {} if c == "{" else [], None, "key" if c == "{" else "item"])
        elif not stack:
            raise Unmendable(f"no object or list at {at}")
        elif c in "}]":
            if stack[-1][0] != _OTHER[c]:
                faults.append((at, "other bracket"))
                if _OTHER[c] not in (s[0] for s in stack):
                    continue
                while stack[-1][0] != _OTHER[c]:
                    close(at)
            close(at)
        elif c == ",":
            if stack[-1][3] == "comma":
                stack[-1][3] = "after"
            elif stack[-1][3] in ("colon", "value"):
                faults.append((at, "missing value"))
                stack[-1][1][stack[-1][2]] = None
                stack[-1][2:] = [None, "after"]
            else:
                faults.append((at, "surplus comma"))
        elif c == ":":
            if stack[-1][3] == "colon":
                stack[-1][3] = "value"
            else:
                faults.append((at, "surplus colon"))
        else:
            if stack[-1][3] == "after":
                stack[-1][3] = "key" if stack[-1][0] == "{" else "item"
            put(value, at)
    if not top and not stack:
        raise Unmendable("empty")
    while stack:
        faults.append((len(text), "missing bracket"))
        close(len(text))
    faults.sort()
    if len(faults) > most:
        raise Unmendable(f"{len(faults)} faults")
    return top[0], faults


def _mended(most: int):
    @F.pandas_udf(f"json string, faults {FAULTS}, reason string")
    def run(lines: pd.Series) -> pd.DataFrame:
        def one(line):
            if line is None:
                return None, None, None
            try:
                value, faults = mend(line, most)
                return json.dumps(value), [{"place": p, "kind": k} for p, k in faults], None
            except (Unmendable, RecursionError) as e:
                return None, None, str(e)

        return pd.DataFrame([one(x) for x in lines], columns=["json", "faults", "reason"])

    return run


def repaired(df: DataFrame, column: str, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Two tables with the columns of df: lines with `value` (variant) and `faults` (place from 0, kind; empty if the line is
    whole), and the quarantine: lines with `reason`. A null line is quarantined. Columns of these names are replaced."""
    line = F.col(f"`{column}`")
    # Spark's parser passes over what is behind a value; between brackets, and before another item, it doesn't
    closed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), line, F.lit(",0]"))), "$", "array<variant>")
    whole = F.when(F.size(closed) == 2, F.get(closed, F.lit(0)))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("value", "faults", "reason") or c == column]
    tried = df.select(F.struct(*kept).alias("row"), whole.alias("whole"), _mended(most)(F.when(whole.isNull(), line)).alias("m"))
    value = F.coalesce("whole", F.try_parse_json("m.json"))
    parts = tried.select("row", value.alias("value"), F.coalesce("m.faults", F.array().cast(FAULTS)).alias("faults"), F.coalesce("m.reason", F.lit("null")).alias("reason"))
    return parts.where("value is not null").select("row.*", "value", "faults"), parts.where("value is null").select("row.*", "reason")
