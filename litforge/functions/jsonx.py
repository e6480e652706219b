"""Reading JSON that models and web services give."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from litforge.functions.text import strip

FENCE = r"(?s)```(?:json)?\s*\n?(.*?)```"


def first_braces(text: str) -> str | None:
    """The first {...} whose braces balance; braces in strings count as well. The depth runs over the bytes at once."""
    raw = np.frombuffer(text[max(text.find("{"), 0) :].encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw) or raw[0] != ord("{"):
        return None
    closed = np.flatnonzero(np.cumsum((raw == ord("{")).astype(np.int64) - (raw == ord("}"))) == 0)
    return raw[: closed[0] + 1].tobytes().decode("utf-8", "surrogatepass") if len(closed) else None


def _plain(value):
    """A parsed value without numbers that JSON can't hold: they become null."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def reread(text: str | None) -> str | None:
    """JSON text for what a stricter parser refuses: of a key that comes twice the last value stays, NaN and infinities
    are read; of text that is no JSON, the first balanced braces are tried."""
    for cut in (lambda: text, lambda: first_braces(text)):
        part = cut() if text is not None else None
        if part is None:
            return None
        try:
            return json.dumps(_plain(json.loads(part)))
        except (ValueError, RecursionError):
            continue
    return None


@F.pandas_udf(StringType())
def _reread(raw: pd.Series) -> pd.Series:
    return raw.map(reread)


def tolerant(raw: Column) -> Column:
    """The JSON in an answer, as a variant: of the content of its first fenced block (of the whole answer, if there is
    none) all of it, else its first balanced braces; null if neither parses. Only what the first try refuses is read again
    outside the JVM."""
    text = strip(raw)
    block = F.when(text.rlike(FENCE), strip(F.regexp_extract(text, FENCE, 1))).otherwise(text)
    return F.coalesce(F.try_parse_json(block), F.try_parse_json(_reread(F.when(F.try_parse_json(block).isNull(), block))))


def parsed(raw: Column) -> Column:
    """A JSON document as a variant; of a key that comes twice the last value stays, NaN and infinities become null. Null
    if it is no JSON."""
    whole = F.try_parse_json(raw)
    again = F.try_parse_json(_strictly(F.when(whole.isNull(), raw)))
    return F.coalesce(whole, again)


@F.pandas_udf(StringType())
def _strictly(raw: pd.Series) -> pd.Series:
    def one(text):
        try:
            return None if text is None else json.dumps(_plain(json.loads(text)))
        except (ValueError, RecursionError):
            return None

    return raw.map(one)


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def n_items(v: Column, field: str = "bacteria_relationships") -> Column:
    """The length of a list; 0 if it is missing, null where it is no list."""
    return F.when(F.try_variant_get(v, f"$.{field}", "variant").isNull(), 0).otherwise(F.size(F.try_variant_get(v, f"$.{field}", "array<variant>")))


def extraction(raw: Column) -> Column:
    """status, n, error, raw: faults become data."""
    v = tolerant(raw)
    n = n_items(v)
    ok = v.isNotNull() & is_object(v) & n.isNotNull()
    return F.struct(
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(ok, n).alias("n"),
        F.when(v.isNull(), "JSON parse failed").when(~ok, "unexpected shape").alias("error"),
        F.when(v.isNull(), F.substring(raw, 1, 500)).alias("raw"),
    )


#: Where providers put an answer's text.
PATHS = ("$.content[0].text", "$.choices[0].message.content", "$.candidates[0].content.parts[0].text")


def provider_text(body: Column) -> Column:
    v = F.try_parse_json(body)
    return F.coalesce(*(F.try_variant_get(v, p, "string") for p in PATHS))


def default_if_missing(v: Column, path: str, default: str) -> Column:
    """The string at a path; the default only where the key is missing, not where it is null or empty."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(found.isNull(), default).otherwise(F.try_variant_get(v, path, "string"))


def repaired(line: Column) -> Column:
    """Ours: the JSON of a line; if it is broken, without trailing commas, with double quotes, or with a brace at its
    end, whichever parses first; else null."""
    tidy = F.regexp_replace(line, r",[ \t\r\n]*([}\]])", "$1")
    quoted = F.replace(tidy, F.lit("'"), F.lit('"'))
    return F.coalesce(*map(F.try_parse_json, (line, tidy, quoted, F.concat(tidy, F.lit("}")))))


def ascii_only(text: Column) -> Column:
    """JSON text with each sign beyond ASCII as \\uXXXX (two of them beyond the first plane)."""
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.octet_length(c) > 1, units(c)).otherwise(c)), "")


@F.pandas_udf(StringType())
def with_cell(notebook: pd.Series, index: pd.Series, source: pd.Series) -> pd.Series:
    """A notebook's JSON with the source of a code cell replaced, its outputs and its execution count cleared."""

    def one(raw, i, code):
        book = json.loads(raw)
        book["cells"][i] |= {"source": code.splitlines(keepends=True), "outputs": [], "execution_count": None}
        return json.dumps(book, indent=1, ensure_ascii=False)

    return pd.Series([one(*x) for x in zip(notebook, index, source, strict=True)])
