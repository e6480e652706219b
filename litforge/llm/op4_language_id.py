"""Operator 4: language identification in two steps: the family by one-against-rest linear SVMs, then the language
within it by a vote of one-against-one linear SVMs.

Features are hashed trigrams of the lower-cased letters' UTF-8 bytes (any other ASCII byte counts as a blank), counted
over the whole text, their square roots scaled to length one. The machines (squared hinge loss, L2) are fitted on the
driver on a bounded sample of the labelled rows: `train_rows` texts in all, the same number for each language but one at
least, chosen by a hash of id and text. Every language that some row has is learned, and a row for each is on the
driver and broadcast. Prediction is one pass over the texts without a shuffle; a task holds the counts of at most 256 texts.

Rows: a null text or one without a letter is `und` with score 0, and so is every text if nothing can be learned. A null
id counts as the empty text in the split, and rows without an id, or of one id, are chosen by their texts. Rows that
repeat are predicted alike, and are one row of the sample; other columns are left aside.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litforge.llm import _hashing as H

BITS = 12
ROWS = 256
#: The families of some ISO 639-1 codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "indic": "hi bn mr ne pa gu ur",
    "turkic": "tr az kk uz ky",
}
_LETTER = np.full(256, 32, dtype=np.uint32)
_LETTER[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes.split()), lang)


def features(column) -> "np.ndarray":
    """Gives (first row, matrix) for runs of rows."""
    data, offsets = H.utf8(H.lowered(column))
    for i, j in H.pieces(offsets):
        for a in range(i, j, ROWS):
            b = min(a + ROWS, j)
            begin = offsets[a : b + 1] - offsets[a]
            x = _LETTER[data[offsets[a] : offsets[b]]]
            out = np.zeros((b - a, 1 << BITS), dtype=np.float32)
            if len(x) > 2:
                grams = ((x[:-2] | (x[1:-1] << 8) | (x[2:] << 16)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
                row = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(begin))[:-2]
                own = np.arange(len(grams)) + 2 < begin[1:][row]
                cell = (row.astype(np.int64) << BITS) | grams
                out = np.bincount(cell[own], minlength=(b - a) << BITS).astype(np.float32).reshape(b - a, -1)
            out[:, _BLANK] = 0
            np.sqrt(out, out=out)
            yield a, out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


_BLANK = int((np.array([32 | 32 << 8 | 32 << 16], dtype=np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS))[0])


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights and offset of a linear SVM with squared hinge loss, by accelerated gradient descent; y is 1 or -1."""
    x = np.hstack((x, np.ones((len(x), 1), dtype=np.float32)))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = 1.0 / (1.0 / cost + 4.0)
    w = last = np.zeros(x.shape[1], dtype=np.float32)
    for t in range(steps):
        v = w + (t / (t + 3)) * (w - last)
        short = np.maximum(0, 1 - y * (x @ v))
        last, w = w, v - rate * (v / cost - 2 * x.T @ (share * y * short)).astype(np.float32)
    return w


class Model:
    """The fitted machines."""

    def __init__(self, x: np.ndarray, langs: list[str], cost: float = 10.0):
        self.langs = sorted(set(langs))
        y = np.array(langs, dtype=object)
        fam = np.array([family_of(k) for k in langs], dtype=object)
        self.families = sorted(set(fam))
        self.members = {f: [k for k in self.langs if family_of(k) == f] for f in self.families}
        self.first = np.array([fit_svm(x, np.where(fam == f, 1, -1).astype(np.float32), cost) for f in self.families]) if len(self.families) > 1 else None
        self.duels = {}
        for ks in self.members.values():
            for i, a in enumerate(ks):
                for b in ks[i + 1 :]:
                    own = (y == a) | (y == b)
                    self.duels[a, b] = fit_svm(x[own], np.where(y[own] == a, 1, -1).astype(np.float32), cost)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of each row and a score from 0 to 1: how clearly the family, then the language won."""
        sure = lambda m: 1 / (1 + np.exp(-np.clip(2.5 * m, -30, 30)))
        chosen, score = np.zeros(len(x), dtype=int), np.ones(len(x))
        if self.first is not None:
            margins = x @ self.first[:, :-1].T + self.first[:, -1]
            chosen = margins.argmax(axis=1)
            two = np.sort(margins, axis=1)[:, -2:]
            score = sure(two[:, 1] - two[:, 0])
        out = np.empty(len(x), dtype=object)
        for f, name in enumerate(self.families):
            rows, ks = np.flatnonzero(chosen == f), self.members[name]
            if not len(rows):
                continue
            votes, close = np.zeros((len(rows), len(ks))), np.zeros((len(rows), len(ks)))
            for i, a in enumerate(ks):
                for j in range(i + 1, len(ks)):
                    w = self.duels[a, ks[j]]
                    m = sure(x[rows] @ w[:-1] + w[-1])
                    votes[:, i] += m >= 0.5
                    votes[:, j] += m < 0.5
                    close[:, i] += m
                    close[:, j] += 1 - m
            best = (votes + close / (10 * max(1, len(ks)))).argmax(axis=1)
            out[rows] = np.array(ks, dtype=object)[best]
            if len(ks) > 1:
                score[rows] *= close[np.arange(len(rows)), best] / (len(ks) - 1)
        return out, np.clip(score, 0, 1)


def sampled(df: DataFrame, id_col: str, text_col: str, lang_col: str, train_rows: int) -> DataFrame:
    """lang, r and x (features) of up to train_rows rows that have a language and a letter: as many of each language, those
    of least r, a hash of id and text."""
    some = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    r = F.xxhash64(F.lit(4), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    own = some.select(F.col(lang_col).cast("string").alias("lang"), r.alias("r"), F.col(text_col).alias("text"))
    counts = own.groupBy("lang").agg(F.approx_count_distinct("r", 0.02).alias("n")).collect()  # a row for each language
    cap = max(1, train_rows // max(1, len(counts)))
    # rows that lie over a language's share can't be among its least; the share leaves room for six standard deviations
    share = (F.lit(cap + 6 * math.sqrt(cap) + 30) / F.col("n") * F.lit(1.15)).alias("share")
    shares = df.sparkSession.createDataFrame(counts, "of_lang string, n long").select("of_lang", share)
    few = own.join(F.broadcast(shares), F.col("lang") == F.col("of_lang"))
    few = few.where(F.shiftrightunsigned("r", 24) / F.lit(float(1 << 40)) < F.col("share")).dropDuplicates(["lang", "r"]).select("lang", "r", "text")

    def run(batches):
        for batch in batches:
            for a, x in features(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, len(x)), batch.column("r").slice(a, len(x)), pa.array([row.astype(np.float16).tobytes() for row in x], type=pa.binary())], names=["lang", "r", "x"])

    least = Window.partitionBy("lang").orderBy("u", "text")
    taken = few.withColumn("u", F.shiftrightunsigned("r", 24)).withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= cap)
    return taken.select("lang", "r", "text").mapInArrow(run, "lang string, r long, x binary")


def train(df: DataFrame, id_col: str, text_col: str, lang_col: str, train_rows: int = 2000) -> Model | None:
    """Fits on the sample: the driver holds at most train_rows rows of it, or one for each language if these are more. None
    if no row has a language and a letter."""
    kept = sorted(sampled(df, id_col, text_col, lang_col, train_rows).collect(), key=lambda r: (r["lang"], r["r"]))
    if not kept:
        return None
    return Model(np.array([np.frombuffer(r["x"], dtype=np.float16) for r in kept]).astype(np.float32), [r["lang"] for r in kept])


def predict(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """df's id columns (all but text) with lang_pred and score, which replace columns of these names."""
    rest = [c for c in df.columns if c not in (text_col, "lang_pred", "score")]

    def run(batches):
        for batch in batches:
            column = batch.column(text_col)
            langs, scores = [np.array([], dtype=object)], [np.array([])]
            for _, x in features(column) if model else ():
                k, s = model.predict(x)
                langs.append(k)
                scores.append(s)
            k, s = (np.concatenate(langs), np.concatenate(scores)) if model else (np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows))
            letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(np.where(letter, k, "und"), type=pa.string()), pa.array(np.where(letter, s, 0.0))], names=[*rest, "lang_pred", "score"])

    schema = df.select(*rest).schema
    return df.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = train(docs.where(~held), "doc_id", "text", "lang")
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
