"""What cleaning has taken out of texts, by alignment of the words before and after.

The words that both texts have once are anchors; the longest run of anchors that rises in both is kept, and the parts between
them are aligned in the same way. A part without anchors is matched at its ends and by a longest common subsequence, however
long it is; what is left of it counts as lost. The texts of a row meet in one task; rows are independent.

Rows: a null text counts as empty; of rows that repeat each is aligned. Words are what white space separates.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the table of common subsequences that are held at once, a level; the others are worked out again.
KEPT = 128
#: Bytes of the places of words that are held at once beside them; those of other words are set anew.
PLACES = 1 << 24
#: Rows of a batch whose words are held as Python's strings at once.
ROWS = 64


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, in the order of the first, that rises in the second."""
    tails, last, before = [], [], []
    for n, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        tails[k : k + 1] = [b]
        last[k : k + 1] = [n]
        before.append(last[k - 1] if k else -1)
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The pairs of a longest common subsequence; of several the one that first leaves out words of a.

    Row j of the table, for b[j:], is a number with a bit for each word of a that b has, the last one's first; it is off
    where the length grows with that word. Rows come out of the row behind them; those that lie step apart are held until
    the way through the table, from its first row, has come to them."""
    there = set(b)
    at = [i for i, w in enumerate(a) if w in there]
    places, size, full = defaultdict(list), len(at) // 8 + 1, (1 << len(at)) - 1
    for p, i in enumerate(reversed(at)):
        places[a[i]].append(p)

    @lru_cache(max(KEPT, PLACES // size))
    def bits(word):
        out = bytearray(size)
        for p in places.get(word, ()):
            out[p >> 3] |= 1 << (p & 7)
        return int.from_bytes(out, "little")

    def held(low, high, row, step):
        """The rows low, low + step, ... before high, whose row is given."""
        rows = []
        for j in range(high - 1, low - 1, -1):
            grows = row & bits(b[j])
            row = (row + grows | row - grows) & full
            if (j - low) % step == 0:
                rows.append(row)
        return rows[::-1]

    out, k, parts = [], 0, [(0, len(b), full)]
    while parts and k < len(at):
        low, high, row = parts.pop()
        step = 1
        while high - low > step * KEPT:
            step *= KEPT
        if step > 1:
            starts = range(low, high, step)
            parts += reversed([*zip(starts, [*starts[1:], high], [*held(starts[1], high, row, step), row], strict=True)])
            continue
        for j, row in zip(range(low, high), held(low, high, row, 1), strict=True):
            same = row.to_bytes(size, "little")
            while k < len(at) and a[at[k]] != b[j] and same[(p := len(at) - 1 - k) >> 3] >> (p & 7) & 1:
                k += 1
            if k < len(at) and a[at[k]] == b[j]:
                out.append((at[k], j))
                k += 1
    return out


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of words that both lists have, rising in both."""
    out, parts = [], [(0, len(a), 0, len(b))]
    while parts:
        i, m, j, n = parts.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once, other = Counter(a[i:m]), Counter(b[j:n])
        place = {w: k for k, w in enumerate(b[j:n], j) if other[w] == 1}
        anchors = _rising([(k, place[w]) for k, w in enumerate(a[i:m], i) if once[w] == 1 and w in place])
        if not anchors:
            out += [(i + x, j + y) for x, y in _common(a[i:m], b[j:n])]
            continue
        ends = [(i - 1, j - 1), *anchors, (m, n)]
        out += anchors
        parts += [(p + 1, q, s + 1, t) for (p, s), (q, t) in zip(ends[:-1], ends[1:], strict=True)]
    return sorted(out)


def _pieces(batches):
    for batch in batches:
        yield from (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS))


_LOST = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType()), T.StructField("text", T.StringType())]))


def lost_spans(df: DataFrame, before: str, after: str, out: str = "lost") -> DataFrame:
    """df with the spans of words of the text before that the one after doesn't have: start (from 0), words, text (one
    blank between words), in place of a column of that name."""
    kept = [c for c in df.columns if c.lower() != out.lower()]
    split = lambda c: F.filter(F.split(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"\s+"), lambda w: w != "")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), split(before).alias("a"), split(after).alias("b"))

    def run(batches):
        for batch in _pieces(batches):
            found = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                there, spans = {i for i, _ in aligned(a, b)}, []
                for i, w in enumerate(a):
                    if i in there:
                        continue
                    if spans and spans[-1]["start"] + spans[-1]["words"] == i:
                        spans[-1]["words"] += 1
                        spans[-1]["text"].append(w)
                    else:
                        spans.append({"start": i, "words": 1, "text": [w]})
                found.append([s | {"text": " ".join(s["text"])} for s in spans])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, type=kind)], names=["row", "_lost"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("_lost", _LOST)])).select("row.*", F.col("_lost").alias(out))
