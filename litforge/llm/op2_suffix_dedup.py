"""Operator 2: removal of repeated byte strings (suffix-array dedup, blockwise over a cover sample).

Suffixes are compared only as far as `span` bytes, so a suffix is a window of `span` bytes. The cover sample is chosen
by content: in every window the k-gram of smallest hash is sampled, so that two equal windows hold the same sampled
position at the same distance, which is what a difference cover gives for two positions. A cover by position moves
|D|/v of all suffixes (6 of 31) through the shuffle, this one about one in 39. It goes in three steps:

1. Each task finds the cover samples of its texts and names each by the bytes that its windows span. Sampled suffixes
   are dealt out by their k-gram; a partition is a suffix bucket, and each bucket is sorted by itself. Samples whose
   k-gram is alone in the corpus are done. Of those that share all bytes (a long tie), the first stays and the windows
   of the others are marked at once, whatever the length of the repeat: names settle the tie, not the texts.
2. Samples that share the k-gram but not the name fetch their bytes, at most 2 * span each, and their bucket sorts the
   windows themselves. Where a k-gram is hot (many names), its windows are dealt out one by one instead, by their
   hashes, so that no task gets the bytes of a whole hot bucket. K-grams that make up more of all samples than one of
   `few` partitions should get are looked for in a share of the texts beforehand; there are at most `few`, their buckets
   are cut by the names into as many parts as they need, and all their samples count as hot. What is found beforehand
   moves work, not results.
3. The marks of each text are merged to spans.

Equality of windows is that of 64-bit hashes of their bytes. No text is compared as a whole, a task holds one bucket,
and what it holds follows the number of partitions. Marks of equal samples in one batch are settled before the
shuffle, so a passage in a third of all rows sends a row a batch and not a row a copy.

Rows: null texts count as empty; a null id sorts before all others; texts under one id, or without one, are told apart by
a 64-bit hash and ordered by it (two texts of one id share it with a chance of about 2**-64), and rows that repeat both
count as one text (neither removes the other). Other columns are left aside, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.llm import _hashing as H
from litforge.llm._io import collected_bounded, written

U = np.uint64
K = 24
NO_ID = -(1 << 63)
#: Ids that occur more than once are remembered by so many hash values of theirs.
SLOTS = 1 << 16
#: key: bucket key; name: of the sample's bytes; doc, tag, at: place of the first window (tag tells the texts of one id
#: apart, at is the byte offset); m: for a sample, windows - 1 and the sample's distance from the first window; for marks, minus the number of windows.
#: Added to m of a sample whose k-gram is hot.
HOT = 1 << 24
#: One in so many texts is looked at for k-grams that are frequent.
SHARE = 64
MARKS = "key long, name long, doc long, tag long, at long, m int"


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours."""
    blocks = np.concatenate((v, np.full(-len(v) % w, np.iinfo(v.dtype).max, dtype=v.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(v) - w + 1], ahead[w - 1 : len(v)])


def _samples(data: np.ndarray, offsets: np.ndarray, span: int):
    """The cover samples of texts that lie one behind the other: text, first window, last window, sample's place, k-gram's hash, name."""
    n = len(data)
    if n < span:
        return [np.zeros(0, dtype=np.int64)] * 4 + [np.zeros(0, dtype=U)] * 2
    hashes = H.Rolling(H.BYTE[data])
    grams = (hashes.sums[K:] - hashes.sums[:-K]) * hashes.inverse[: n - K + 1]
    order = ((grams * U(0xD6E8FEB86659FD93)) & ~U(0xFFFFFF)) | np.arange(n - K + 1, dtype=U)
    chosen = (_least(order, span - K + 1) & U(0xFFFFFF)).astype(np.int64)
    begin, end = offsets[:-1], offsets[1:] - span
    own = end >= begin
    step = np.zeros(n + 1, dtype=np.int8)
    step[begin[own]] += 1
    step[end[own] + 1] -= 1
    new = np.concatenate(([True], chosen[1:] != chosen[:-1]))
    new[begin[own]] = True
    new &= np.cumsum(step, dtype=np.int8)[: len(new)] > 0
    lo = np.flatnonzero(new)
    text = np.searchsorted(offsets, lo, side="right") - 1
    hi = np.minimum(np.concatenate((lo[1:], [n])) - 1, end[text])
    at = chosen[lo]
    name = hashes.of(lo, hi + span) + (at - lo).astype(U) * U(0x9E3779B97F4A7C15) + (hi - lo).astype(U) * U(0xC2B2AE3D27D4EB4F)
    return text, lo, hi, at, H.mix(grams[at]), H.mix(name)


def _runs(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, windows: np.ndarray):
    """Marks that follow on each other in a text become one."""
    if not len(doc):
        return doc, tag, at, windows
    order = np.lexsort((at, tag, doc))
    doc, tag, at, windows = doc[order], tag[order], at[order], windows[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] != at[:-1] + windows[:-1])))
    first = np.flatnonzero(new)
    return doc[first], tag[first], at[first], np.add.reduceat(windows, first)


def _batches(key, name, doc, tag, at, m, rows: int = 200_000):
    for i in range(0, len(key), rows):
        cut = slice(i, i + rows)
        yield pa.RecordBatch.from_arrays([pa.array(x[cut].view(np.int64) if x.dtype == U else x[cut].astype(np.int64)) for x in (key, name, doc, tag, at)] + [pa.array(m[cut].astype(np.int32))], names=["key", "name", "doc", "tag", "at", "m"])


def _marked(doc, tag, at, windows):
    """Rows of marks, dealt out evenly."""
    doc, tag, at, windows = _runs(doc, tag, at, windows)
    yield from _batches(H.mix(doc.astype(U) ^ H.mix(at.astype(U) ^ tag.astype(U))), np.zeros(len(doc), dtype=U), doc, tag, at, -windows)


def _first_of(name, doc, tag, at):
    """Which places are the first of their name, and which are later than it; a place that comes twice is one place."""
    order = np.lexsort((at, tag, doc, name))
    name, doc, tag, at = name[order], doc[order], tag[order], at[order]
    new = np.concatenate(([True], name[1:] != name[:-1]))[: len(name)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
    stays, later = np.empty(len(name), dtype=bool), np.empty(len(name), dtype=bool)
    stays[order], later[order] = new, (doc != doc[first]) | (tag != tag[first]) | (at != at[first])
    return stays, later


def _parted(key: np.ndarray, name: np.ndarray, m: np.ndarray, often: np.ndarray, parts: np.ndarray):
    """Cuts the buckets of frequent k-grams (sorted, with their number of parts) by the names, and marks them as hot."""
    if not len(often):
        return key, m
    spot = np.minimum(np.searchsorted(often, key), len(often) - 1)
    own = often[spot] == key
    key, m = key.copy(), m.copy()
    key[own] = H.mix(key[own] ^ H.mix(name[own] % parts[spot[own]] + U(1)))
    m[own] += HOT
    return key, m


def _sampled(span: int, often: np.ndarray, parts: np.ndarray):
    def run(batches):
        for batch in batches:
            data, offsets = H.utf8(batch.column("text"))
            docs, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
            found = []
            for i, j in H.pieces(offsets):
                a, b = offsets[i], offsets[j]
                for s in range(a, b, H.PIECE) if b - a > 2 * H.PIECE else [a]:
                    cut = data[s : min(b, s + H.PIECE + span - 1)] if b - a > 2 * H.PIECE else data[a:b]
                    text, lo, hi, at, key, name = _samples(cut, np.array([0, len(cut)]) if b - a > 2 * H.PIECE else offsets[i : j + 1] - a, span)
                    base = (s if b - a > 2 * H.PIECE else a) - offsets[i + text]
                    found.append((key, name, docs[i + text], tags[i + text], lo + base, ((hi - lo) << 8) | (at - lo)))
            if not found:
                continue
            key, name, doc, tag, at, m = (np.concatenate(x) for x in zip(*found, strict=True))
            stays, later = _first_of(name, doc, tag, at)
            cut, hot = _parted(key[stays], name[stays], m[stays], often, parts)
            yield from _batches(cut, name[stays], doc[stays], tag[stays], at[stays], hot)
            yield from _marked(doc[later], tag[later], at[later], (m[later] >> 8) + 1)

    return run


def _columns(batches) -> list[np.ndarray]:
    found = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, dtype=np.int64)] * 6


def _buckets(hot: int):
    """Sorts buckets of samples; gives marks, and the samples whose windows must be looked at."""

    def run(batches):
        yield from _sorted(_columns(batches), hot)

    return run


def _sorted(columns, hot: int):
    key, name, doc, tag, at, m = columns
    if not len(key):
        return
    marks = m < 0
    yield from _batches(key[marks], name[marks], doc[marks], tag[marks], at[marks], m[marks])
    key, name, doc, tag, at, m = (x[~marks] for x in (key, name, doc, tag, at, m))
    if not len(key):
        return
    order = np.lexsort((at, tag, doc, name, key))
    key, name, doc, tag, at, m = (x[order] for x in (key, name, doc, tag, at, m))
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    stays = new_key | np.concatenate(([True], name[1:] != name[:-1]))
    group = np.cumsum(new_key) - 1
    names = np.bincount(group, weights=stays)[group]
    first = np.maximum.accumulate(np.where(stays, np.arange(len(key)), 0))
    # rows that repeat a text under its own id are the same place, not an earlier one
    later = ~stays & ((doc != doc[first]) | (tag != tag[first]) | (at != at[first]))
    yield from _marked(doc[later], tag[later], at[later], (m[later] % HOT >> 8) + 1)
    ask = stays & ((names > 1) | (m >= HOT))  # other names of a k-gram that was cut may be in its other parts
    yield from _batches(key[ask], name[ask], doc[ask], tag[ask], at[ask], m[ask] % HOT + HOT * ((names[ask] > hot) | (m[ask] >= HOT)))


def _named(data, offsets, docs, tags, places, span: int):
    """The windows of runs of bytes: name, text (id and tag) and place of each."""
    found = [(np.zeros(0, dtype=U), *[np.zeros(0, dtype=np.int64)] * 3)]
    for i, j in H.pieces(offsets):
        hashes = H.Rolling(H.BYTE[data[offsets[i] : offsets[j]]])
        n = np.diff(offsets[i : j + 1]) - span + 1
        row = np.repeat(np.arange(j - i), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = offsets[i + row] - offsets[i] + step
        found.append((H.mix(hashes.of(start, start + span)), docs[i + row], tags[i + row], places[i + row] + step))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _fetched(span: int):
    """The bytes of the samples that are asked for. Samples of a hot k-gram give their windows instead, each under its
    own name, without bytes; what a batch holds twice becomes a mark at once."""

    def out(key, doc, tag, at, m, got=None):
        got = pa.nulls(len(key), pa.binary()) if got is None else got
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(tag), pa.array(at), pa.array(m.astype(np.int32)), got], names=["key", "doc", "tag", "at", "m", "got"])

    def run(batches):
        for batch in batches:
            data, offsets = H.utf8(batch.column("text"))
            docs, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
            asked = batch.column("asked")
            every = np.repeat(np.arange(batch.num_rows), asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = asked.flatten()
            keys, places, ms = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for hot in (False, True):
                own = (ms >= HOT) == hot
                rows, key, at, m = every[own], keys[own], places[own], ms[own] % HOT
                start = offsets[rows] + at
                size = (m >> 8) + span
                ends = np.cumsum(size)
                for i in range(0, len(rows), 50_000):
                    cut = slice(i, i + 50_000)
                    n, to = size[cut], ends[cut] - (ends[i] - size[i])
                    where = np.arange(to[-1]) - np.repeat(to - n, n) + np.repeat(start[cut], n)
                    raw, bounds = np.ascontiguousarray(data[where]), np.concatenate(([0], to))
                    if not hot:
                        got = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])
                        yield out(key[cut], docs[rows[cut]], tags[rows[cut]], at[cut], m[cut], got)
                        continue
                    name, doc, tag, place = _named(raw, bounds, docs[rows[cut]], tags[rows[cut]], at[cut], span)
                    stays, later = _first_of(name, doc, tag, place)
                    yield out(name[stays], doc[stays], tag[stays], place[stays], np.zeros(int(stays.sum())))
                    doc, tag, place, windows = _runs(doc[later], tag[later], place[later], np.ones(int(later.sum()), dtype=np.int64))
                    yield out(H.mix(doc.astype(U) ^ H.mix(place.astype(U) ^ tag.astype(U))), doc, tag, place, -windows)

    return run


def _windows(span: int):
    """Sorts the windows of a bucket of samples and marks all but the first of equal ones."""

    def run(batches):
        found = [(np.zeros(0, dtype=U), *[np.zeros(0, dtype=np.int64)] * 3)]
        for batch in batches:
            key, doc, tag, at, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            got = batch.column("got")
            whole, marks = got.is_valid().to_numpy(zero_copy_only=False), m < 0
            yield from _batches(key[marks], np.zeros(int(marks.sum()), dtype=U), doc[marks], tag[marks], at[marks], m[marks])
            bare = ~whole & ~marks
            found.append((np.ascontiguousarray(key[bare]).view(U), doc[bare], tag[bare], at[bare]))
            if whole.any():
                got = got.drop_null()
                offsets = np.frombuffer(got.buffers()[1], dtype=np.int32)[got.offset : got.offset + len(got) + 1].astype(np.int64)
                data = np.frombuffer(got.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
                found.append(_named(data, offsets - offsets[0], doc[whole], tag[whole], at[whole], span))
        name, doc, tag, at = (np.concatenate(x) for x in zip(*found, strict=True))
        _, later = _first_of(name, doc, tag, at)
        yield from _marked(doc[later], tag[later], at[later], np.ones(int(later.sum()), dtype=np.int64))

    return run


def _cut(span: int):
    """The texts without the bytes under marks."""

    def run(batches):
        for batch in batches:
            data, offsets = H.utf8(batch.column("text"))
            marks = batch.column("marks")
            bounds = np.concatenate(([0], np.cumsum(marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            flat = marks.flatten()
            at, m = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            spans, kept, raw = [], [], data.tobytes()
            for i in range(batch.num_rows):
                text = raw[offsets[i] : offsets[i + 1]]
                if bounds[i] == bounds[i + 1]:
                    spans.append([])
                    kept.append(text)
                    continue
                start = at[bounds[i] : bounds[i + 1]]
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate((start - m[bounds[i] : bounds[i + 1]] + span - 1)[order])
                new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
                start, end = start[new].tolist(), end[np.concatenate((new[1:] - 1, [len(end) - 1]))].tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(start, end, strict=True)])
                kept.append(b"".join(text[a:b] for a, b in zip([0, *end], [*start, len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offsets)), pa.array(spans, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, type=pa.binary())],
                names=["id", "n_bytes", "removed", "kept"],
            )

    return run


def _frequent(docs: DataFrame, span: int, few: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-grams that make up more than one in `few` samples of a share of the texts, and into how many parts to cut them."""
    some = docs.where(F.pmod(F.xxhash64(F.lit(2), "doc", "tag"), F.lit(share)) == 0) if share > 1 else docs
    none = np.zeros(0, dtype=U)
    counts = some.select("doc", "tag", "text").mapInArrow(_sampled(span, none, none), MARKS).where("m >= 0").groupBy("key").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = collected_bounded(counts.where((F.col("n") > total / few) & (F.col("n") > 8)), few, "the frequent k-grams")
    rows = sorted((r["key"] % (1 << 64), -(-r["n"] * few // total)) for r in rows)
    return np.array([k for k, _ in rows], dtype=U), np.array([n for _, n in rows], dtype=U)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 100, hot: int = 1024, few: int | None = None, share: int = SHARE) -> DataFrame:
    """id, n_bytes, removed array<struct<start, end>> (byte offsets, end exclusive) and kept (binary): each text without
    the bytes that are covered by a string of `span` bytes that also starts earlier, in a text of smaller id or before in
    the same text. A row for each row of df, also for empty and short texts, of which nothing is removed. A k-gram is hot
    if its samples have over `hot` names; their windows are dealt out by what they hold, with the same result. `few` is the
    session's number of shuffle partitions unless given."""
    if not K < span <= 250:
        raise ValueError(f"span must be over {K} and at most 250")
    few = max(100, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if few is None else few
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = _tagged(df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("doc", F.coalesce("id", F.lit(NO_ID))))
    sampled = docs.select("doc", "tag", "text").mapInArrow(_sampled(span, *_frequent(docs, span, few, share)), MARKS)
    first = written(sampled.repartition("key").mapInArrow(_buckets(hot), MARKS), "suffix-buckets")
    asked = first.where("m >= 0").groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "at", "m")).alias("asked"))
    got = docs.select("doc", "tag", "text").join(asked.hint("shuffle_hash"), ["doc", "tag"]).mapInArrow(_fetched(span), "key long, doc long, tag long, at long, m int, got binary")
    second = got.repartition("key").mapInArrow(_windows(span), MARKS)
    marks = first.where("m < 0").unionByName(second).groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "m")).alias("marks"))
    return docs.join(marks.hint("shuffle_hash"), ["doc", "tag"], "left").select("id", "text", "marks").mapInArrow(_cut(span), f"id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", id_col)


def _tagged(docs: DataFrame) -> DataFrame:
    """docs with tag, which tells the texts of one id apart: 0, or the text's hash where the id may occur more than once,
    that is, where it shares one of SLOTS hash values with an id that does. There are at most SLOTS of these."""
    slot = F.pmod(F.xxhash64(F.lit(2), "doc"), F.lit(SLOTS)).cast("int")
    repeated = docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(slot.alias("slot")).distinct()
    found = collected_bounded(repeated, SLOTS, "the hash values of repeated ids")
    if not found:
        return docs.withColumn("tag", F.lit(0).cast("long"))
    slots = docs.sparkSession.createDataFrame(found, "slot int")
    return docs.withColumn("slot", slot).join(F.broadcast(slots.withColumn("many", F.lit(True))), "slot", "left").withColumn("tag", F.when(F.col("many"), F.xxhash64("text", F.octet_length("text"))).otherwise(F.lit(0).cast("long"))).drop("slot", "many")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
