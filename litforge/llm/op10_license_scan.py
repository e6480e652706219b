"""Operator 10: licence scan by the Dice coefficient over word bigrams [native: column expressions only].

A text is lower-cased and cut into words of ASCII letters and digits. Its windows are runs of consecutive words, across
lines and within them, so a notice is found in a line of its own, wrapped over lines or inside a longer line, and a whole
licence in a longer text. A window's set of word bigrams is compared with that of each template: short notices and the full
texts in `licenses/`. A window begins at a bigram of the template that follows no other one of it, or at the template's
first, since bigrams of the template to its left could only raise Dice; of its ends the one of greatest Dice counts, then
the nearest; and it has at most (2 - t) / t times the template's words. A window that reaches the threshold t is a
hit, unless one that overlaps it is better: of greater Dice, then of more words, then earlier, then by name.

A template of n bigrams can reach t only against windows that share t / (2 - t) * n of them, so a window begins only where
so many lie within its width. Before that, a text must hold one of a few key words of the template, without which too few
of its bigrams are left. Both prunings are exact.

All is one projection: no shuffle, no join, no Python. Time is in proportion to the text, and for each begin of a window
to its width; overlaps are settled in one pass that holds the windows over one place. Rows: a null or empty text has
no hit; rows that repeat are scanned each; other columns are left aside.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short notices and headers of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def full_texts() -> dict[str, str]:
    """The licences whose whole texts are compared too."""
    return {f"{p.stem}-full": p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).strip().split(" ")
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """How many of n bigrams must be shared to reach the threshold, and how many a set has at most that reaches it."""
    return max(1, math.ceil(n * threshold / (2 - threshold) - 1e-9)), math.floor(n * (2 - threshold) / threshold + 1e-9)


def limits(text: str, threshold: float) -> tuple[int, int]:
    """How many bigrams of a template a window holds at least, and how many bigrams it has at most."""
    return bounds(len(bigrams(text)), threshold)[0], bounds(len(re.findall("[a-z0-9]+", text.lower())) - 1, threshold)[1]


def key_words(text: str, threshold: float, known: set[str] = frozenset()) -> list[str]:
    """Words of which a window holds one if it reaches the threshold: all bigrams without any of them are too few. Words
    that are known come first, then long ones that many bigrams hold."""
    grams = bigrams(text)
    held = Counter(w for g in grams for w in set(g.split(" ")))
    spare, chosen = bounds(len(grams), threshold)[0], set()
    for w in sorted(held, key=lambda w: (w not in known, len(w) < 7, -held[w], w)):
        if sum(not chosen & set(g.split(" ")) for g in grams) < spare:
            break
        chosen.add(w)
    return sorted(chosen)


def _normal(section: Column) -> Column:
    """The words, each between two blanks."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(section), "[^a-z0-9]+", " ")), F.lit(" "))


def _once(value: Column, use) -> Column:
    """use(value), where value is worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


HITS = "array<struct<dice:double,line:int,n_lines:int,license:string,word:int,words:int>>"
FOUND = "struct<d:double,back:int,at:int,license:string,to:int,line:int,end:int>"
STATE = f"struct<live:array<struct<w:{FOUND},beaten:boolean>>,out:array<{FOUND}>>"


def _placed(text: Column) -> Column:
    """Each bigram of the text with the lines of its first and its last word."""
    words = lambda s, i: F.transform(F.filter(F.split(_normal(s), " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), (i + 1).cast("int").alias("line")))
    rest = lambda w, at: F.slice(w, at, F.greatest(F.size(w) - 1, F.lit(0)))
    pairs = lambda w: F.zip_with(rest(w, 1), rest(w, 2), lambda a, b: F.struct(F.concat_ws(" ", a["w"], b["w"]).alias("g"), a["line"].alias("line"), b["line"].alias("end")))
    return _once(F.flatten(F.transform(F.split(text, "\n", -1), words)), pairs)


def _windows(placed: Column, name: str, text: str, threshold: float) -> Column:
    """The windows of a text's bigrams that reach the threshold against one template, from each begin the best."""
    own = bigrams(text)
    least, widest = limits(text, threshold)
    ours = lambda g: g.isin(*own)

    def ends(firsts: Column, at: Column) -> Column:
        """The best window from a begin, by the places where each of its different bigrams stands first."""
        seen = F.filter(F.transform(F.array_sort(firsts), lambda x, j: F.struct(x["i"].alias("i"), x["own"].alias("own"), (j + 1).alias("d"))), lambda x: x["own"])
        dice = F.transform(seen, lambda x, j: F.struct((2.0 * (j + 1) / (x["d"] + len(own))).alias("dice"), (-x["i"]).alias("back")))
        place = lambda b: F.struct((-b["dice"]).alias("d"), (b["back"] - 2).alias("back"), at.alias("at"), F.lit(name).alias("license"), (at - b["back"]).alias("to"), F.get(placed, at)["line"].alias("line"), F.get(placed, at - b["back"])["end"].alias("end"))
        return _once(F.array_max(dice), place)

    def window(at: Column) -> Column:
        order = F.array_sort(F.transform(F.slice(placed, at + 1, widest), lambda x, i: F.struct(x["g"].alias("g"), i.alias("i"))))
        fresh = lambda o: F.filter(F.transform(o, lambda x, j: F.when((j == 0) | (F.get(o, j - 1)["g"] != x["g"]), F.struct(x["i"].alias("i"), ours(x["g"]).alias("own")))), lambda x: x.isNotNull())
        return ends(_once(order, fresh), at)

    def begins(p: Column) -> Column:
        fresh = lambda at, j: (j == 0) | (F.get(p, j - 1) < at - 1) | (F.get(placed, at)["g"] == own[0])
        return F.filter(F.transform(p, lambda at, j: F.when(fresh(at, j) & (F.get(p, j + (least - 1)) - at < widest), at)), lambda i: i.isNotNull())

    places = F.filter(F.transform(placed, lambda x, i: F.when(ours(x["g"]), i)), lambda i: i.isNotNull())
    return F.filter(F.transform(_once(places, begins), window), lambda w: w["d"] <= -threshold + 1e-9).cast(f"array<{FOUND}>")


def _apart(found: Column) -> Column:
    """Without the windows that a better one overlaps. found is in the order of places; a window is done with once one
    begins behind its end."""
    rank = lambda w: F.struct(w["d"], w["back"], w["at"], w["license"])

    def step(state: Column, x: Column) -> Column:
        live = F.filter(state["live"], lambda y: y["w"]["to"] >= x["at"])
        done = F.transform(F.filter(state["live"], lambda y: (y["w"]["to"] < x["at"]) & ~y["beaten"]), lambda y: y["w"])
        held = F.transform(live, lambda y: F.struct(y["w"].alias("w"), (y["beaten"] | (rank(x) < rank(y["w"]))).alias("beaten")))
        own = F.struct(x.alias("w"), F.exists(live, lambda y: rank(y["w"]) < rank(x)).alias("beaten"))
        grown = lambda d: F.when(F.size(d) > 0, F.concat(state["out"], d)).otherwise(state["out"])
        return F.struct(F.array_append(held, own).alias("live"), _once(done, grown).alias("out")).cast(STATE)

    none = F.struct(F.array().cast(f"array<struct<w:{FOUND},beaten:boolean>>").alias("live"), F.array().cast(f"array<{FOUND}>").alias("out")).cast(STATE)
    last = lambda s: F.concat(s["out"], F.transform(F.filter(s["live"], lambda y: ~y["beaten"]), lambda y: y["w"]))
    return F.aggregate(found, none, step, last)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """id and hits array<struct<dice, line, n_lines, license, word, words>>, best first: the line (from 1) and the word of
    the text (from 0) where a passage begins, and how many lines and words it has."""
    templates = TEMPLATES | full_texts() if templates is None else templates
    templates = {k: v for k, v in sorted(templates.items()) if " " in " ".join(bigrams(v))}
    empty = F.array().cast(HITS)
    if not templates:
        return df.select(id_col, empty.alias("hits"))
    keys, known = {}, set()
    for k, v in templates.items():
        keys[k] = key_words(v, threshold, known)
        known |= set(keys[k])
    normal = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(_normal(F.col(text_col)), F.lit("")).alias("normal"))
    some = F.lit(False)
    for w in sorted(known):
        some = some | F.contains(F.col("normal"), F.lit(f" {w} "))
    held = normal.select("id", F.when(some, F.col("text")).alias("text"), F.when(some, F.split("normal", " ")).alias("words"))
    may = lambda k: F.arrays_overlap("words", F.array(*map(F.lit, keys[k])))
    none = F.array().cast(f"array<{FOUND}>")
    every = lambda placed: F.concat(*(F.when(may(k), _windows(placed, k, v, threshold)).otherwise(none) for k, v in templates.items()))
    in_order = lambda f: F.transform(F.array_sort(F.transform(f, lambda w: F.struct(w["at"].alias("at"), w.alias("w")))), lambda x: x["w"])
    best = F.array_sort(_apart(in_order(_once(_placed(F.col("text")), every))))
    hits = F.transform(best, lambda w: F.struct((-w["d"]).alias("dice"), w["line"].alias("line"), (w["end"] - w["line"] + 1).alias("n_lines"), w["license"].alias("license"), w["at"].alias("word"), (-w["back"]).alias("words"))).cast(HITS)
    # generated from an array of one, the hits are worked out once for all that is read of them
    return held.select(F.col("id").alias(id_col), F.explode(F.array(F.when(F.col("text").isNotNull(), hits).otherwise(empty))).alias("hits"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.get("hits", F.lit(0))
    return found.select("doc_id", F.size("hits").cast("long").alias("n_hits"), first["license"].alias("license"), first["line"].alias("line"), first["n_lines"].alias("n_lines"), F.round(first["dice"], 6).alias("dice"))


def _sql() -> str:
    every = sorted((TEMPLATES | full_texts()).items())
    rows = ", ".join("('{}', [{}], {}, {})".format(k, ", ".join(f"'{g}'" for g in bigrams(v)), *limits(v, 0.8)) for k, v in every)
    return f"""
WITH template(license, grams, least, widest) AS (VALUES {rows}),
template_gram AS (SELECT license, len(grams) AS size, least, widest, grams[1] AS first, unnest(grams) AS g FROM template),
line AS (
  SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS s FROM documents
), cut AS (
  SELECT doc_id, line, list_filter(string_split(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM line
), word AS (
  SELECT doc_id, line, unnest(w) AS w, unnest(range(len(w))) AS k FROM cut
), placed AS (
  SELECT doc_id, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) AS p FROM word
), gram AS (
  SELECT x.doc_id, x.p, x.w || ' ' || y.w AS g, x.line AS line, y.line AS fin FROM placed x JOIN placed y ON x.doc_id = y.doc_id AND y.p = x.p + 1
), own AS (
  SELECT doc_id, license, p, line, g = first AS first, size, least, widest, row_number() OVER (PARTITION BY doc_id, license ORDER BY p) AS nth FROM gram JOIN template_gram USING (g)
), start AS (
  SELECT x.* FROM own x JOIN own y ON y.doc_id = x.doc_id AND y.license = x.license AND y.nth = x.nth + x.least - 1 AND y.p - x.p < x.widest
  WHERE x.first OR NOT EXISTS (SELECT 1 FROM own z WHERE z.doc_id = x.doc_id AND z.license = x.license AND z.p = x.p - 1)
), held AS (
  SELECT s.doc_id, s.license, s.p AS a, s.line, s.size, g.g, min(g.p) AS q, arg_min(g.fin, g.p) AS fin FROM start s JOIN gram g ON g.doc_id = s.doc_id AND g.p >= s.p AND g.p < s.p + s.widest GROUP BY ALL
), counted AS (
  SELECT h.*, t.g IS NOT NULL AS own, count(*) OVER x AS d, count(t.g) OVER x AS m FROM held h LEFT JOIN template_gram t ON t.g = h.g AND t.license = h.license
  WINDOW x AS (PARTITION BY doc_id, h.license, a ORDER BY q)
), best AS (
  SELECT doc_id, license, a, q, line, fin, 2.0::DOUBLE * m / (d + size) AS dice FROM counted WHERE own AND 2.0::DOUBLE * m / (d + size) >= 0.8 - 1e-9
  QUALIFY row_number() OVER (PARTITION BY doc_id, license, a ORDER BY 2.0::DOUBLE * m / (d + size) DESC, q) = 1
), apart AS (
  SELECT * FROM best x WHERE NOT EXISTS (SELECT 1 FROM best y WHERE y.doc_id = x.doc_id AND y.a <= x.q AND x.a <= y.q
    AND (y.dice > x.dice OR (y.dice = x.dice AND (y.q - y.a > x.q - x.a OR (y.q - y.a = x.q - x.a AND (y.a < x.a OR (y.a = x.a AND y.license < x.license)))))))
), hits AS (
  SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS n_hits, license, line, fin, dice FROM apart
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, q - a DESC, a, license) = 1
)
SELECT d.doc_id, coalesce(n_hits, 0) AS n_hits, license, CAST(line AS INTEGER) AS line, CAST(fin - line + 1 AS INTEGER) AS n_lines, round(CAST(dice AS DOUBLE), 6) AS dice FROM documents d LEFT JOIN hits USING (doc_id)
"""


OP10_SQL = _sql()
