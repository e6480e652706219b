"""A sequence tagger: a linear-chain conditional random field over hashed token features, trained, stored and applied in Spark.

Features are column expressions: of each token its word, first and last letters and shape, and the words before and after,
hashed into 2**bits places. The table of features is written once. Every step of the training is a job in which each
task sums the gradient of its sentences and gives the places that are not zero; they are summed by place, so the
driver gets one number a place and label, whatever the number of sentences. The driver takes L-BFGS steps on the mean
log likelihood with an L2 penalty, which is convex: the result depends on the data, not on their partitions.

A model is stored as rows of weights with a version, its own hash. Applying it broadcasts the weights (2**bits places a
label, 8 bytes each), once an executor, and decodes by Viterbi over Arrow batches.

Rows: a null list of tokens counts as empty and gets an empty list of tags; sentences without tokens, or whose tags are
null or not as many, or hold a null, are left out of the training. Null tokens are a word of their own. Of equal paths the
one with the earlier labels in order wins.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PER_TOKEN = 7
#: Tokens of sentences that are padded to one length and worked on together.
TOKENS = 1 << 15


class Tagger(NamedTuple):
    labels: tuple[str, ...]
    bits: int
    emit: np.ndarray  # places by labels
    step: np.ndarray  # from label to label; the last row is for the first token

    @property
    def version(self) -> str:
        parts = "\n".join((*self.labels, str(self.bits))).encode()
        return hashlib.sha256(parts + self.emit.tobytes() + self.step.tobytes()).hexdigest()[:16]


def features(tokens: Column, bits: int = 16) -> Column:
    """PER_TOKEN places for each token."""
    word = lambda c: F.coalesce(F.lower(c), F.lit("<null>"))
    near = lambda i, edge: F.when((i < 0) | (i >= F.size(tokens)), edge).otherwise(word(F.get(tokens, i)))
    kind = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("<null>")), r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), r"\p{Nd}+", "0")
    place = lambda name, value: F.pmod(F.xxhash64(F.lit(name), value), F.lit(1 << bits)).cast("int")
    # a list of one list: the kinds are worked out once, not again for each token behind
    each = lambda kinds: F.transform(
        tokens,
        lambda c, i: F.array(
            place("bias", F.lit("")), place("word", word(c)), place("head", F.substring(word(c), 1, 3)), place("tail", F.right(word(c), F.lit(3))),
            place("kind", F.get(kinds, i)), place("before", F.concat(near(i - 1, F.lit("<s>")), F.lit(" "), F.get(kinds, F.greatest(i - 1, F.lit(0))))), place("after", near(i + 1, F.lit("</s>"))),
        ),
    )
    return F.get(F.transform(F.array(F.transform(tokens, kind)), each), F.lit(0))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _packed(column) -> tuple[np.ndarray, np.ndarray]:
    """The places of all tokens of a column of sentences, and how many tokens each has."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, PER_TOKEN), sizes


def _chunks(sizes: np.ndarray):
    """Sentences of like length, as rows of token numbers (-1 beyond the end)."""
    begin = np.concatenate(([0], np.cumsum(sizes)))
    order = [i for i in np.argsort(sizes, kind="stable") if sizes[i]]
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * sizes[order[b]] <= TOKENS:
            b += 1
        rows = np.array(order[a:b])
        t = np.arange(sizes[rows[-1]])
        yield rows, np.where(t < sizes[rows][:, None], begin[rows][:, None] + t, -1)
        a = b


def gradient(places: np.ndarray, sizes: np.ndarray, gold: np.ndarray, emit: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log likelihood of the gold labels, and its derivatives by the weights."""
    n = emit.shape[1]
    total, of_emit, of_step = 0.0, np.zeros_like(emit), np.zeros_like(step)
    for rows, where in _chunks(sizes):
        inside = where >= 0
        x, y = places[where.clip(0)], gold[where.clip(0)]
        scores = emit[x].sum(axis=2)
        ahead = np.empty_like(scores)
        ahead[:, 0] = scores[:, 0] + step[n]
        for t in range(1, where.shape[1]):
            ahead[:, t] = np.where(inside[:, t, None], scores[:, t] + _logsum(ahead[:, t - 1, :, None] + step[None, :n], 1), ahead[:, t - 1])
        z = _logsum(ahead[:, -1], 1)
        back = np.zeros_like(scores)
        for t in range(where.shape[1] - 2, -1, -1):
            onward = _logsum(step[None, :n] + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(inside[:, t + 1, None], onward, 0.0)
            pair = np.exp(ahead[:, t, :, None] + step[None, :n] + (scores[:, t + 1] + back[:, t + 1])[:, None, :] - z[:, None, None])
            of_step[:n] -= pair[inside[:, t + 1]].sum(axis=0)
        chance = np.exp(ahead + back - z[:, None, None])
        own = np.eye(n)[y]
        of_step[n] += (own[:, 0] - chance[:, 0]).sum(axis=0)
        both = inside[:, 1:]
        np.add.at(of_step, (y[:, :-1][both], y[:, 1:][both]), 1.0)
        flat, apart = x[inside].ravel(), np.repeat((own - chance)[inside], PER_TOKEN, axis=0)
        for k in range(n):
            of_emit[:, k] += np.bincount(flat, weights=apart[:, k], minlength=len(emit))
        total += float((scores * own).sum(axis=2)[inside].sum() + step[n][y[:, 0]].sum() + step[y[:, :-1][both], y[:, 1:][both]].sum() - z.sum())
    return total, of_emit, of_step


def decode(places: np.ndarray, sizes: np.ndarray, emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best label of each token, by Viterbi."""
    n, out = emit.shape[1], np.zeros(int(sizes.sum()), dtype=np.int64)
    for rows, where in _chunks(sizes):
        inside = where >= 0
        scores = emit[places[where.clip(0)]].sum(axis=2)
        best, came = scores[:, 0] + step[n], np.zeros(scores.shape, dtype=np.int64)
        for t in range(1, where.shape[1]):
            through = best[:, :, None] + step[None, :n]
            came[:, t] = np.where(inside[:, t, None], through.argmax(axis=1), np.arange(n))
            best = np.where(inside[:, t, None], through.max(axis=1) + scores[:, t], best)
        label = best.argmax(axis=1)
        for t in range(where.shape[1] - 1, -1, -1):
            out[where[inside[:, t], t]] = label[inside[:, t]]
            label = came[np.arange(len(rows)), t, label]
    return out


def _gradients(emit, step):
    """A task's sums: place -1 has the log likelihood and the number of sentences, places from 2**bits on are steps."""

    def run(batches):
        weights, steps = emit.value, step.value
        total, n, of_emit, of_step = 0.0, 0, np.zeros_like(weights), np.zeros_like(steps)
        for batch in batches:
            places, sizes = _packed(batch.column("places"))
            some = gradient(places, sizes, batch.column("gold").flatten().to_numpy(zero_copy_only=False), weights, steps)
            total, of_emit, of_step, n = total + some[0], of_emit + some[1], of_step + some[2], n + int((sizes > 0).sum())
        every = np.concatenate((of_emit, of_step)).ravel()
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2], some))), pa.array(np.concatenate(([total, n], every[some])))], names=["place", "value"])

    return run


def _descend(value_of, size: int, steps: int, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """The least of a convex function by L-BFGS with halved steps; value_of gives value and derivatives."""
    x, pairs = np.zeros(size), []
    value, slope = value_of(x)
    for _ in range(steps):
        way, kept = -slope, []
        for s, y in reversed(pairs):
            a = s @ way / (s @ y)
            kept.append(a)
            way = way - a * y
        if pairs:
            way *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            way = way + (a - y @ way / (s @ y)) * s
        length = 1.0 if pairs else min(1.0, 1.0 / max(1e-12, np.abs(slope).sum())) * 10
        for _ in range(12):
            new_value, new_slope = value_of(x + length * way)
            if new_value <= value + 1e-4 * length * (slope @ way):
                break
            length /= 2
        else:
            return x
        s, y = length * way, new_slope - slope
        done = abs(value - new_value) <= tolerance * max(1.0, abs(value))
        x, value, slope = x + s, new_value, new_slope
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        if done:
            break
    return x


def train(df: DataFrame, tokens: str, tags: str, folder: str, bits: int = 16, penalty: float = 1e-4, steps: int = 30, sentences: int | None = None) -> Tagger | None:
    """A tagger of a table of sentences: lists of tokens, and as many tags. folder is a place of its own that driver and
    executors share, for the table of features. With `sentences` it is fitted on at most so many, those of least hash, which
    the driver holds once; labels come from all. None if there is no sentence with tags."""
    spark = df.sparkSession
    whole = (F.size(tokens) > 0) & (F.size(tokens) == F.size(tags)) & F.forall(tags, lambda t: t.isNotNull())
    # behind a generator the lists are worked out once; a filter that is pushed below them would do so for each token
    own = df.select(F.explode(F.array(F.struct(F.col(tokens).alias(tokens), F.col(tags).alias(tags)))).alias("r")).select("r.*").where(whole)
    labels = tuple(sorted(r["t"] for r in own.select(F.explode(tags).alias("t")).distinct().collect()))  # a row for each label
    if not labels:
        return None
    number = F.create_map(*[F.lit(x) for i, k in enumerate(labels) for x in (k, i)])
    if sentences is not None:
        own = own.orderBy(F.xxhash64(F.lit(21), tokens, tags)).limit(sentences).repartition(spark.sparkContext.defaultParallelism)
    own.select(features(F.col(tokens), bits).alias("places"), F.transform(tags, lambda t: number[t]).alias("gold")).write.mode("overwrite").parquet(folder)
    table = spark.read.parquet(folder)
    shape, n = (1 << bits, len(labels)), len(labels)

    def value_of(x: np.ndarray):
        emit, step = x[: shape[0] * n].reshape(shape), x[shape[0] * n :].reshape(n + 1, n)
        sent = spark.sparkContext.broadcast(emit), spark.sparkContext.broadcast(step)
        sums = table.mapInArrow(_gradients(*sent), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        for s in sent:
            s.destroy()
        place, value = (sums.column(c).to_numpy() for c in ("place", "value"))
        total, count = value[place == -1][0], max(1.0, value[place == -2][0])
        slope = np.zeros(len(x))
        slope[place[place >= 0]] = value[place >= 0]
        return -total / count + penalty / 2 * (x @ x), -slope / count + penalty * x

    x = _descend(value_of, shape[0] * n + (n + 1) * n, steps)
    return Tagger(labels, bits, x[: shape[0] * n].reshape(shape), x[shape[0] * n :].reshape(n + 1, n))


def tagged(df: DataFrame, tokens: str, model: Tagger, out: str = "tags") -> DataFrame:
    """df with a list of tags for its list of tokens, in place of a column of that name."""
    emit, step = (df.sparkSession.sparkContext.broadcast(w) for w in (model.emit, model.step))
    names = np.array(model.labels, dtype=object)
    rest = [c for c in df.columns if c.lower() != out.lower()]
    hidden = "_places"
    while hidden in rest:
        hidden += "_"

    def run(batches):
        for batch in batches:
            places, sizes = _packed(batch.column(hidden))
            label = decode(places, sizes, emit.value, step.value)
            tags = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(names[label], type=pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), tags], names=[*rest, out])

    listed = F.coalesce(F.col(f"`{tokens}`"), F.array().cast("array<string>"))
    return df.select(*(F.col(f"`{c}`") for c in rest), features(listed, model.bits).alias(hidden)).mapInArrow(run, df.select(*(F.col(f"`{c}`") for c in rest)).schema.add(out, T.ArrayType(T.StringType())))


def save(spark: SparkSession, model: Tagger, path: str) -> str:
    """Writes the weights that are not zero, a row each, with the version, which it returns."""
    every = np.concatenate((model.emit, model.step))
    place, label = np.nonzero(every)
    rows = pa.table({"place": pa.array(place), "label": pa.array(label.astype(np.int32)), "weight": pa.array(every[place, label])})
    about = [(model.version, model.bits, list(model.labels))]
    spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame(about, "version string, bits int, labels array<string>").write.mode("overwrite").parquet(f"{path}/about")
    return model.version


def load(spark: SparkSession, path: str) -> Tagger:
    """A stored model; a fault if its weights are not those of its version."""
    about = spark.read.parquet(f"{path}/about").first()
    rows = spark.read.parquet(f"{path}/weights").toArrow()  # as many rows as the model has weights
    n = len(about["labels"])
    every = np.zeros(((1 << about["bits"]) + n + 1, n))
    every[rows.column("place").to_numpy(), rows.column("label").to_numpy()] = rows.column("weight").to_numpy()
    model = Tagger(tuple(about["labels"]), about["bits"], every[: 1 << about["bits"]].copy(), every[1 << about["bits"] :].copy())
    if model.version != about["version"]:
        raise ValueError(f"the weights in {path} are not those of version {about['version']}")
    return model
