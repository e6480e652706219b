"""A model of word n-grams that the corpus trains, and texts that it goes on with: by the likeliest word, or drawn with a
temperature, a nucleus and a penalty on repeats.

Training counts, over all texts, how often each word follows each run of up to order - 1 words (the empty run too). A
model keeps the `contexts` runs that occur most often and the `width` words that follow each most often: these two are its
size, as hashing bits are elsewhere, and bound what is broadcast.

Runs are counted by length. A run occurs at most as often as the run that it begins with, which also comes first in order;
so only words behind runs that are among the best so far can end a longer run that is kept, and no other run is counted.

A step takes the longest run at the text's end that the model knows. The end of a text is a word of its own, at which
generation stops. Words are parted by white space, and joined by blanks. Ties go to the word first in order.

Rows: texts that are null or have no words train nothing; a null prompt has a null answer; a model of no texts, which
knows no run, says nothing ("")."""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The end of a text; no word can be it, since it is white space.
END = "\n"
#: Bytes of text that a task counts at once; times a run occurs for each part that the words behind it are dealt to, and
#: the most parts of a run.
HELD, PART, PARTS = 1 << 25, 1 << 16, 1 << 20


class Runs(NamedTuple):
    """Runs of one length, as steps of a tree: a step holds, sorted, the numbers that a run's beginning and its next word
    make together, and their places are the numbers of the beginnings longer by that word."""

    words: pa.Array
    steps: list[np.ndarray]
    c: np.ndarray  # number of the run at each place of the last step
    parts: np.ndarray


def _runs(rows: pa.Table) -> Runs:
    """Of context, c and total."""
    lists = pc.split_pattern(rows.column("context").combine_chunks(), " ")
    known = lists.flatten().unique()
    ids = pc.index_in(lists.flatten(), value_set=known).to_numpy().astype(np.int64).reshape(len(rows), -1)
    at, steps = np.zeros(len(rows), np.int64), []
    for i in ids.T:
        step, at = np.unique(at * len(known) + i, return_inverse=True)
        steps.append(step)
    back = np.argsort(at)  # runs differ, so each has a place of its own
    return Runs(known.cast(pa.large_string()), steps, rows.column("c").to_numpy()[back].astype(np.int64), np.minimum(1 + rows.column("total").to_numpy()[back] // PART, PARTS))


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words, the end first, and the places among them of the words of all texts, with the end of each text that has words."""
    lists = pc.ascii_split_whitespace(texts)  # the white space that \\s stands for in Java
    flat = lists.flatten()
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(there)))[lists.offsets.to_numpy()]
    coded = flat.filter(pa.array(there)).dictionary_encode()
    ends = upto[1:][upto[1:] > upto[:-1]]
    return pa.concat_arrays([pa.array([END], pa.large_string()), coded.dictionary]), np.insert(coded.indices.to_numpy().astype(np.int64) + 1, ends, 0)


def _counted(runs: Runs, texts: pa.Array) -> pa.RecordBatch:
    """c, parts, word, n: how often each word follows each of the runs. No run goes over an end, which is in none."""
    known, code = _coded(texts)
    ids, at = pc.fill_null(pc.index_in(known, value_set=runs.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code], np.arange(len(runs.steps), len(code))
    place = np.zeros(len(at), np.int64)
    for k, step in enumerate(runs.steps):
        i = ids[at - len(runs.steps) + k]
        at, place, i = at[i >= 0], place[i >= 0], i[i >= 0]
        key = place * len(runs.words) + i
        place = np.minimum(np.searchsorted(step, key), len(step) - 1)
        there = step[place] == key
        at, place = at[there], place[there]
    pairs, n = np.unique(place * len(known) + code[at], return_counts=True)
    place, word = np.divmod(pairs, len(known))
    return pa.RecordBatch.from_arrays([pa.array(runs.c[place]), pa.array(runs.parts[place]), known.take(pa.array(word)).cast(pa.string()), pa.array(n.astype(np.int64))], names=["c", "parts", "word", "n"])


def _summed(rows: pa.Table, width: int, least: int) -> pa.Table:
    """part, word, n: the counts of each word summed up; the words that follow most often in each part, and those that do
    `least` times."""
    coded = rows.column("word").cast(pa.large_string()).combine_chunks().dictionary_encode()
    order = np.empty(len(coded.dictionary), np.int64)
    order[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(order))  # by bytes, as Spark sorts
    known = coded.dictionary.take(pa.array(np.argsort(order)))
    parts, place = np.unique(rows.column("part").to_numpy(), return_inverse=True)
    pair = place * len(known) + order[coded.indices.to_numpy()]
    by = np.argsort(pair)
    pair = pair[by]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.add.reduceat(rows.column("n").to_numpy()[by], first)
    place, word = np.divmod(pair[first], len(known))
    by = np.lexsort((-n, place))  # stable: equal counts stay by word
    place, word, n = place[by], word[by], n[by]
    rank = np.arange(len(place)) - np.flatnonzero(np.diff(place, prepend=-1))[place]
    kept = (rank < width) | (n >= least)
    return pa.table({"part": parts[place[kept]], "word": known.take(pa.array(word[kept])).cast(pa.string()), "n": n[kept]})


def followed(texts: DataFrame, runs: Runs, width: int, least: int) -> DataFrame:
    """c, part, word, n: how often words follow each of the runs in all texts, a column of strings. The words behind a run that
    occurs often are dealt to several parts; of each part there are the `width` words that follow most often, and all that
    do `least` times. A task holds the counts of its parts, a row for each that a task made."""
    sent = texts.sparkSession.sparkContext.broadcast(runs)

    def run(batches):
        held = []
        for batch in batches:
            held.append(batch.column(0).cast(pa.large_string()))
            if sum(x.nbytes for x in held) >= HELD:
                yield _counted(sent.value, pa.concat_arrays(held))
                held = []
        if held:
            yield _counted(sent.value, pa.concat_arrays(held))

    def put_together(batches):
        if held := [b for b in batches if len(b)]:
            yield from _summed(pa.Table.from_batches(held), width, least).to_batches()

    found = texts.mapInArrow(run, "c long, parts long, word string, n long")
    dealt = found.select((F.col("c") * PARTS + F.pmod(F.xxhash64("word"), F.col("parts"))).alias("part"), "word", "n").repartition("part")
    return dealt.mapInArrow(put_together, "part long, word string, n long").select(F.expr(f"part div {PARTS}").alias("c"), "part", "word", "n")


def _best(runs: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The runs that occur most often, and how often the last occurs (1, if there are fewer). Only those that occur as often are
    put in order."""
    least, n = 1, 0
    for total, count in sorted((tuple(r) for r in runs.groupBy("total").count().collect()), reverse=True):
        n += count
        if n >= most:
            least = total
            break
    return runs.where(F.col("total") >= least).orderBy(F.desc("total"), "context").limit(most), least


def train(docs: DataFrame, folder: str, text_col: str = "text", order: int = 3, width: int = 32, contexts: int = 1 << 17) -> DataFrame:
    """context, total, words, n: a model, as a table to be written. folder is a place of its own that driver and executors
    share, for what was counted so far. The runs of a length that are among the best so far, at most `contexts`, go through
    the driver to be broadcast."""
    spark, texts = docs.sparkSession, docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    empty = Runs(pa.array([], pa.large_string()), [], np.zeros(1, np.int64), np.full(1, PARTS))
    behind = stored(followed(texts, empty, width, 1), "behind-0")
    known = behind.groupBy("c").agg(F.sum("n").alias("total")).select(F.lit("").alias("context"), "total", F.lit(0).alias("size"), "c")
    levels = [(known, behind.orderBy(F.desc("n"), "word").limit(width))]
    longer = behind.where(F.col("word") != END).select(F.col("word").alias("context"), F.col("n").alias("total"))
    for size in range(1, order):
        best, least = _best(known.drop("c").unionByName(longer.withColumn("size", F.lit(size))), contexts)
        known = stored(best.withColumn("c", F.row_number().over(Window.orderBy(F.desc("total"), "context"))), f"known-{size}")
        own = known.where(F.col("size") == size)
        rows = own.select("context", "c", "total").toArrow()
        if not len(rows):
            break
        # words behind are kept for the model, or since they may end a run that is kept
        behind = stored(followed(texts, _runs(rows), width, least if size < order - 1 else 1 << 62), f"behind-{size}")
        levels.append((own, behind))
        longer = behind.where((F.col("n") >= least) & (F.col("word") != END)).join(own, "c").select(F.concat_ws(" ", "context", "word").alias("context"), F.col("n").alias("total"))
    kept, models = known.select("context", "total"), []
    for own, some in levels:
        first = some.groupBy("c").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))), 1, width).alias("b"))
        models.append(own.select("context", "c").join(first, "c").join(kept, "context").select("context", "total", F.col("b.word").alias("words"), F.transform("b.m", lambda m: -m).alias("n")))
    return functools.reduce(DataFrame.unionByName, models)


class Model(NamedTuple):
    order: int
    row: dict  # run -> number
    begin: np.ndarray
    known: np.ndarray  # words, each once
    words: np.ndarray  # the places in known of the words behind the runs
    logs: np.ndarray  # logarithm of the share of a run's words


def loaded(table: DataFrame, most: int = 1 << 22) -> Model:
    """A model as train() gave it, on the driver, to be broadcast; a fault beyond `most` words behind runs."""
    size = table.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"the model holds {size} words behind runs, over {most}")
    rows = table.orderBy("context").toArrow()
    found = rows.column("context").to_pylist()
    lists = {c: rows.column(c).combine_chunks() for c in ("words", "n")}
    sizes = lists["n"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.repeat(rows.column("total").to_numpy().astype(np.float64), sizes)
    coded = lists["words"].flatten().dictionary_encode()
    order = 1 + max((len(c.split(" ")) for c in found if c), default=0)
    return Model(order, {c: i for i, c in enumerate(found)}, np.concatenate(([0], np.cumsum(sizes))), coded.dictionary.to_numpy(zero_copy_only=False).astype(object), coded.indices.to_numpy(), np.log(lists["n"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)) - np.log(total))


def behind(model: Model, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words that may follow, by falling share, with the logarithms of their shares."""
    for k in range(min(model.order - 1, len(text)), -1, -1):
        at = model.row.get(" ".join(text[len(text) - k :]))
        if at is not None:
            return model.known[model.words[model.begin[at] : model.begin[at + 1]]], model.logs[model.begin[at] : model.begin[at + 1]]
    return model.known[:0], model.logs[:0]


def _drawn(*of) -> float:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, of)).encode(), digest_size=7).digest(), "big") / (1 << 56)


def continued(model: Model, prompt: str, most: int = 64, temperature: float = 0.0, top_p: float = 1.0, penalty: float = 1.0, seed: int = 0) -> str:
    """What the model goes on with, up to `most` words. Logarithms of words that the prompt or the answer hold already are
    multiplied by the penalty. Temperature 0 takes the likeliest word; else one is drawn of the likeliest words whose
    shares reach top_p, by a hash of seed, prompt and step, so that a task that is run again says the same."""
    text, n = prompt.split(), 0
    said, out = set(text), []
    while n < most:
        found, logs = behind(model, text)
        if not len(found):
            break
        if penalty != 1.0:
            logs = np.where([w in said for w in found], logs * penalty, logs)
        order = np.argsort(-logs, kind="stable")
        if temperature > 0:
            share = np.exp((logs[order] - logs[order[0]]) / temperature)
            share = np.cumsum(share / share.sum())
            last = min(int(np.searchsorted(share, top_p - 1e-12)), len(share) - 1)
            word = found[order[min(int(np.searchsorted(share[: last + 1], _drawn(seed, prompt, n) * share[last], side="right")), last)]]
        else:
            word = found[order[0]]
        if word == END:
            break
        text = [*text[len(text) - model.order + 2 :], word] if len(text) > model.order else [*text, word]
        said.add(word)
        out.append(word)
        n += 1
    return " ".join(out)


def generated(df: DataFrame, prompt: str, model: Model, out: str = "answer", **how) -> DataFrame:
    """df with an answer to each prompt, in place of a column of that name; how as in continued()."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in df.columns if c.lower() != out.lower()]
    hidden = "_prompt"
    while hidden in rest:
        hidden += "_"

    def run(batches):
        for batch in batches:
            said = [None if p is None else continued(sent.value, p, **how) for p in batch.column(hidden).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(said, type=pa.string())], names=[*rest, out])

    kept = df.select(*(F.col(f"`{c}`") for c in rest))
    return df.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{prompt}`").alias(hidden)).mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))
