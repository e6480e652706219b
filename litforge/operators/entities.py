"""Entities by dictionary, and which of them are negated.

Terms come from a table of any size. They are held as a trie over hashed words, in blocks of up to `block_words` words:
a block's edges are one sorted array, sent to the tasks as a broadcast. A task follows all places of a batch through the trie
at once, a word a step, so it takes as many steps as the longest term has words, however many terms there are. The blocks
pass over the rows one behind the other, without a shuffle, each adding the longest term that begins at a place. At last
matches are taken from the left, the longest first, none overlapping another.

Words are runs of letters, digits and marks within words, in lower case; equality of words is that of 64-bit hashes.

Rows: a null or empty text has no match; a null term, or one without words, is none; terms of the same words go by the
smaller id. Rows that repeat are matched each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
#: A word is letters and digits, and marks that stand between them.
WORD = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _mixed(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (state.astype(U) + U(1)) * U(0x9E3779B97F4A7C15) ^ word.astype(U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(27))


class Trie:
    """Edges from a state by a word to the next state, as sorted keys; a state may hold a term."""

    def __init__(self, terms: list[tuple[int, list[int]]]):
        keys, to, states, ends = {}, [], 1, {}
        for term, path in terms:
            at = 0
            for w in path:
                key = (at, w)
                if key not in keys:
                    keys[key] = states
                    states += 1
                at = keys[key]
            ends[at] = min(term, ends.get(at, term))
        pairs = np.array(list(keys), dtype=np.int64).reshape(-1, 2)
        mixed, to = _mixed(pairs[:, 0], pairs[:, 1]), np.array(list(keys.values()), dtype=np.int64)
        order = np.argsort(mixed, kind="stable")
        self.keys, self.to = mixed[order], to[order]
        self.end = np.full(states, -1, dtype=np.int64)  # number of a term, by state
        self.terms = np.array(sorted(set(ends.values())), dtype=np.int64)
        for state, term in ends.items():
            self.end[state] = np.searchsorted(self.terms, term)

    def longest(self, sequence: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where a term begins, the length of the longest one, and its id; end tells where each place's text ends."""
        place, state = np.arange(len(sequence)), np.zeros(len(sequence), dtype=np.int64)
        size, found = np.zeros(len(sequence), dtype=np.int64), np.zeros(len(sequence), dtype=np.int64)
        step = 0
        while len(place) and len(self.keys):
            key = _mixed(state, sequence[place + step])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            own = self.keys[at] == key
            place, state = place[own], self.to[at[own]]
            step += 1
            hit = self.end[state] >= 0
            size[place[hit]], found[place[hit]] = step, self.terms[self.end[state[hit]]]
            inside = place + step < end[place]
            place, state = place[inside], state[inside]
        some = np.flatnonzero(size)
        return some, size[some], found[some]


#: Words of a batch that are followed at once; a row of more is one piece.
WORDS = 1 << 17


def _pieces(batches, column: str):
    """Batches cut into pieces of up to WORDS words."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + WORDS, side="right")))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])


_HITS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "size", "term")]))


def _followed(trie, names: list[str], last: bool):
    """Adds a block's matches to each row's, the longest at each place; with last, takes them from the left."""

    def run(batches):
        for batch in _pieces(batches, "_words"):
            column = batch.column("_words")
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            begin = np.concatenate(([0], np.cumsum(sizes)))
            sequence = column.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at, n, term = trie.value.longest(sequence, begin[1:][row])
            old = batch.column("_hits")
            of = np.repeat(np.arange(len(sizes)), old.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = old.flatten()
            start, size, which = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            of, start = np.concatenate((of, row[at])), np.concatenate((start, at - begin[:-1][row[at]]))
            size, which = np.concatenate((size, n)), np.concatenate((which, term))
            order = np.lexsort((which, -size, start, of))
            of, start, size, which = (x[order] for x in (of, start, size, which))
            keep = np.concatenate(([True], (of[1:] != of[:-1]) | (start[1:] != start[:-1])))[: len(of)]
            if last:
                free, text = 0, -1
                for i in np.flatnonzero(keep).tolist():
                    if of[i] != text:
                        free, text = 0, of[i]
                    keep[i] = start[i] >= free
                    free = max(free, start[i] + size[i]) if keep[i] else free
            bounds = pa.array(np.searchsorted(of[keep], np.arange(len(sizes) + 1)).astype(np.int32))
            hits = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(x[keep].astype(np.int64)) for x in (start, size, which)], names=["start", "size", "term"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), hits], names=[*names, "_hits"])

    return run


def matched(df: DataFrame, terms: DataFrame, text_col: str = "text", id_col: str = "term_id", term_col: str = "term", block_words: int = 1_000_000, out: str = "entities") -> DataFrame:
    """df with a list of start, size (in words) and term (id), in place of a column of that name. The driver holds one block
    of terms and a partition of their table at a time."""
    spark = df.sparkSession
    hashed = lambda c: F.transform(words(c), lambda w: F.xxhash64(w))
    listed = terms.select(F.col(id_col).cast("long").alias("i"), hashed(F.col(term_col)).alias("w")).where("i is not null and size(w) > 0")
    kept = [c for c in df.columns if c.lower() != out.lower()]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.coalesce(hashed(F.col(f"`{text_col}`")), F.array().cast("array<bigint>")).alias("_words"), F.array().cast("array<struct<start:bigint,size:bigint,term:bigint>>").alias("_hits"))

    def passed(rows: DataFrame, block: list, last: bool) -> DataFrame:
        names = ["row"] if last else ["row", "_words"]
        schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("_hits", _HITS)])
        return rows.mapInArrow(_followed(spark.sparkContext.broadcast(Trie(block)), names, last), schema)

    block, held = [], 0
    for r in listed.toLocalIterator():
        if held and held + len(r["w"]) > block_words:
            rows, block, held = passed(rows, block, False), [], 0
        block.append((r["i"], r["w"]))
        held += len(r["w"])
    return passed(rows, block, True).select("row.*", F.col("_hits").alias(out))


#: Triggers of a denial, by words; what looks like one and isn't; and what ends the scope of one. The words are ours.
TRIGGERS = ("no", "not", "without", "never", "nor", "absence of", "lack of", "failed to", "ruled out")
PSEUDO = ("not only", "no increase in doubt", "not necessarily", "without doubt", "no longer than")
TERMINATORS = ("but", "however", "although", "though", "except", "because", "while", "whereas", "which")
SCOPE = 6


def _found(ws: Column, phrases: tuple[str, ...]) -> Column:
    """Places (from 0) and sizes of phrases in a list of words."""
    here = lambda i: F.array(*(F.when(F.array_join(F.slice(ws, i + 1, len(p.split())), " ") == p, len(p.split())) for p in phrases))
    firsts = sorted({p.split()[0] for p in phrases})
    found = F.transform(ws, lambda w, i: F.when(w.isin(*firsts), F.struct(i.alias("at"), F.array_max(here(i)).alias("size"))))
    return F.filter(found, lambda x: x["size"].isNotNull())


def _once(value: Column, use) -> Column:
    """use(value), where value is worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def negated(df: DataFrame, text_col: str = "text", entities: str = "entities", out: str = "negated") -> DataFrame:
    """df with a boolean for each entity (start and size in words): whether it lies in the scope of a denial. A scope begins
    behind a trigger that is no part of a pseudo-trigger, and goes on for SCOPE words, but not past a terminator or the
    end of a sentence. Scopes go forward only; an entity lies in one if its first word does."""
    # ends of sentences become a word of their own, at which no scope goes on
    marked = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(rf"{WORD}|[.!?;](?=\s|$)"), F.lit(0))

    def scopes(ws: Column) -> Column:
        stop = lambda w: w.rlike(r"^[.!?;]$")
        # a place among all marks, as a place among words
        plain = lambda i: i - F.size(F.filter(F.slice(ws, 1, i), stop))
        real = lambda pseudo: F.filter(_found(ws, TRIGGERS), lambda t: ~F.exists(pseudo, lambda p: (p["at"] <= t["at"]) & (t["at"] < p["at"] + p["size"])))
        ends = lambda t: F.filter(F.transform(F.slice(ws, t["at"] + t["size"] + 1, SCOPE), lambda w, j: F.when(stop(w) | w.isin(*TERMINATORS), j)), lambda j: j.isNotNull())
        wide = lambda t: F.coalesce(F.get(ends(t), F.lit(0)), F.lit(SCOPE))
        return F.transform(_once(_found(ws, PSEUDO), real), lambda t: F.struct(plain(t["at"] + t["size"]).alias("low"), wide(t).alias("n")))

    none = F.array().cast("array<string>")
    held = _once(F.when(F.size(entities) > 0, F.coalesce(marked, none)).otherwise(none), scopes)
    inside = lambda s: F.transform(entities, lambda e: F.exists(s, lambda x: (x["low"] <= e["start"]) & (e["start"] < x["low"] + x["n"])))
    return df.withColumn(out, _once(held, inside))
