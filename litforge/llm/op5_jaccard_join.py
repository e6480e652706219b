"""Operator 5: n-gram Jaccard join by MinHash banding, and the groups that its links make.

Texts are sets of `k`-word shingles of lower-case words (a text of fewer words is one shingle). Documents with the same
set are one class and need no links among themselves. Bands and rows are the cheapest plan whose recall at the
threshold is `recall` or more; classes meet in the buckets of their band hashes, by shuffle, and pairs are verified on
the full shingle sets, each once:

- Buckets of up to `bucket` members (and `block_bytes` of shingles) are a task's. A pair belongs to the first band that it
  shares; only members with a pair of their own in a bucket fetch their text, so a copy does not travel once a band.
- Larger buckets that share members make a pool. A pool's members are sent once, to one of its blocks of about `block`
  members, in PIECES which are packed: a dictionary of a piece's shingles, the shingles that most of its members have,
  and what each member differs from them by. Each pair of packed blocks is a task that verifies all their pairs, whether
  they share a band or not. So the shingles of a large group travel once; what is sent again for each block is its packed form, some bytes a
  member where the texts are near copies. The verification of a group of different texts still costs its square.

A task counts its links and gives a spanning forest of them, never the pairs. Groups are the connected components of the
forests, by alternating large and small stars. Where a table meets the facts of a bucket, group or copied text, the key
is split by a salt, of which the facts are given only those that occur.

Result, a row for each row: id, class_id (the smallest id of the group), copy_of (the smallest id with the same shingles)
and n_links (other documents at the threshold or more, copies included).

Rows: a text without words, or null, is a group of its own, without links; a null id counts in groups but names none
unless alone; rows that repeat are copies of each other. Other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.llm import _hashing as H
from litforge.llm._io import drop_since, mark, release, written

U = np.uint64


def plan(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): of the plans with the recall wanted, the one of the most rows whose hashes are at most `most`; more
    rows mean fewer false candidates."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = next((b for b in range(1, most // rows + 1) if 1 - (1 - threshold**rows) ** b >= recall), None)
        if bands and bands * rows <= 100:
            best = (bands, rows)
    return best


class Scheme(NamedTuple):
    """How texts become sets, and how sets are signed and compared. sign gives the band hashes of sets, and what likely
    reads, a row of bytes each, or None. likely tells which of some sets may reach the threshold with which of others;
    without it every pair that shares a band is verified."""

    k: int
    threshold: float
    bands: int
    sign: Callable
    words: Callable
    likely: Callable | None = None


def lower_words(data: np.ndarray, offsets: np.ndarray):
    return H.words(data, offsets)


def _sets(column, scheme: Scheme):
    """For each text of an Arrow column its sorted set of shingles."""
    data, offsets = H.utf8(H.lowered(column) if scheme.words is lower_words else column)
    for i, j in H.pieces(offsets):
        hashes, first = scheme.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        grams, begin = H.shingles(hashes, first, scheme.k)
        for r in range(j - i):
            yield np.unique(grams[begin[r] : begin[r + 1]])


def _class(own: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(H.mix(np.array([np.bitwise_xor.reduce(own) + H.mix(own).sum(dtype=U) + U(len(own))], dtype=U)).view(np.int64)[0])


def minima(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """The least value of each hash function over each set."""
    every = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(p) for p in sets])[:-1]))
    return np.stack([np.minimum.reduceat(every * f, at) for f in factors], axis=1)


def banded(values: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each band of the same number of values."""
    low = values.astype(U).reshape(len(values), bands, -1)
    out = np.zeros((len(values), bands), dtype=U)
    for r in range(low.shape[2]):
        out = H.mix(out * U(H.BASE) + low[:, :, r])
    return H.mix(out + H.mix(np.arange(1, bands + 1, dtype=U) * U(77))).view(np.int64)


def minhash(bands: int, rows: int):
    factors = H.mix(np.arange(1, bands * rows + 1, dtype=U)) | U(1)

    def sign(sets: list[np.ndarray]):
        return banded(minima(sets, factors), bands), None

    return sign


SIGNED = "id long, h long, name long, n int, signs array<long>, sketch binary"


def _signed(scheme: Scheme):
    def run(batches):
        for batch in batches:
            names, sizes, signs, sketches = [], [], [], []
            part: list[np.ndarray] = []

            def flush():
                if part:
                    hashes, sketch = scheme.sign(part)
                    signs.extend(hashes)
                    sketches.extend([None] * len(part) if sketch is None else sketch)
                    part.clear()

            where = []
            for own in _sets(batch.column("text"), scheme):
                sizes.append(len(own))
                names.append(_class(own) if len(own) else 0)
                if len(own):
                    where.append(len(sizes) - 1)
                    part.append(own)
                    if sum(map(len, part[-1:])) > 200_000 or len(part) >= 400:
                        flush()
            flush()
            full, kept = [np.zeros(0, dtype=np.int64)] * len(sizes), [None] * len(sizes)
            for r, s, x in zip(where, signs, sketches, strict=True):
                full[r], kept[r] = s, x
            columns = [batch.column("id"), batch.column("h"), pa.array(names, type=pa.int64()), pa.array(sizes, type=pa.int32()), pa.array(full, type=pa.list_(pa.int64())), pa.array(kept, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "name", "n", "signs", "sketch"])

    return run


def _runs(batches, keys: list[str]):
    """Tables of whole groups from batches that are sorted by the keys, and where each group begins and ends."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        bounds = _bounds(table, keys)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
        rest = table.slice(bounds[-2])
    if rest is not None:
        yield rest, _bounds(rest, keys)


def _bounds(table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows - 1, dtype=bool)
    for k in keys:
        c = table.column(k).to_numpy()
        new |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [table.num_rows]))


def _lists(column, width: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).reshape(-1, width)


def _apart(signs: np.ndarray, pool: np.ndarray, others: np.ndarray, other_pool: np.ndarray) -> np.ndarray:
    """Which pairs belong to a bucket: they share no earlier band, and no pool."""
    out = (pool[:, None] != other_pool[None, :]) | (pool[:, None] == 0)
    for x in range(signs.shape[1]):
        out &= signs[:, x][:, None] != others[:, x][None, :]
    return out


def _sketches(column) -> np.ndarray:
    """A column of rows of bytes of one length as a matrix."""
    found = column.to_pylist()
    return np.frombuffer(b"".join(found), dtype=np.uint8).reshape(len(found), -1)


def _owners(scheme: Scheme):
    """Of the members of each bucket, those with a pair that belongs to it."""

    def run(batches):
        for table, bounds in _runs(batches, ["band", "bucket"]):
            band, pool, signs = table.column("band").to_numpy(), table.column("pool").to_numpy(), _lists(table.column("signs"), scheme.bands)
            sketch = _sketches(table.column("sketch")) if scheme.likely else None
            keep = np.zeros(table.num_rows, dtype=bool)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                s = signs[a:b, : band[a]]
                for i in range(a, b, 512):
                    j = min(b, i + 512)
                    own = _apart(s[i - a : j - a], pool[i:j], s, pool[a:b])
                    own[np.arange(j - i), np.arange(i - a, j - a)] = False
                    if scheme.likely and own.any():
                        own &= scheme.likely(sketch[i:j], sketch[a:b])
                    keep[i:j] = own.any(axis=1)
            yield from table.select(["bucket", "band", "name"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


CELL = "cell long, piece int, parts int, band int, name long, copies long, pool long, signs array<long>, sketch binary, grams binary"
_CELL = (("cell", pa.int64()), ("piece", pa.int32()), ("parts", pa.int32()), ("band", pa.int32()), ("name", pa.int64()), ("copies", pa.int64()), ("pool", pa.int64()), ("signs", pa.list_(pa.int64())), ("sketch", pa.binary()))


def _fetched(scheme: Scheme):
    """The shingles of each class that is asked for, once for each of its buckets, and once for its piece of a pool
    (-1 for a bucket)."""

    def run(batches):
        done = set()
        for batch in batches:
            asked = batch.select([c for c in batch.schema.names if c != "text"]).to_pylist()
            for r, own in zip(asked, _sets(batch.column("text"), scheme), strict=True):
                if not len(own) or r["name"] in done:
                    continue
                done.add(r["name"])
                raw = own.tobytes()
                rows = [(c["bucket"], -1, 0, c["band"], r["name"], r["copies"], r["pool"] or 0, r["signs"], r["sketch"]) for c in r["cells"] or []]
                if r["pool"]:
                    rows.append((r["pool"], r["piece"], r["parts"], 0, r["name"], r["copies"], r["pool"], [], r["sketch"]))
                step = max(1, (32 << 20) // len(raw))
                for i in range(0, len(rows), step):
                    cut = rows[i : i + step]
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, (_, t) in zip(zip(*cut, strict=True), _CELL, strict=True)] + [pa.array([raw] * len(cut), type=pa.binary())], names=[*(n for n, _ in _CELL), "grams"])

    return run


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of left reach the threshold with which of right; counts shared shingles by matrix products, some columns at a time."""
    size = np.array([len(s) for s in sets])
    use = np.concatenate((left, right))
    every, where = np.unique(np.concatenate([sets[i] for i in use]), return_inverse=True)
    row = np.repeat(np.arange(len(use)), size[use])
    counts = np.bincount(where, minlength=len(every))
    many = np.flatnonzero(counts > 1)
    rank = np.full(len(every), -1)
    rank[many] = np.arange(len(many))
    column = rank[where]
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    for c in range(0, len(many), 4096):
        own = (column >= c) & (column < c + 4096)
        m = np.zeros((len(use), min(4096, len(many) - c)), dtype=np.float32)
        m[row[own], column[own] - c] = 1
        shared += m[: len(left)] @ m[len(left) :].T
    both = size[left][:, None] + size[right][None, :] - shared
    return shared >= threshold * both - 1e-6


def _counted(sets: list[np.ndarray], names: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, allowed=None, step: int = 512):
    """(name, root, links) of the members that have a link between left and right; left itself may be right."""
    links, root = np.zeros(len(names), dtype=np.int64), np.arange(len(names))
    alike = left is right

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, len(left), step):
        some = left[a : a + step]
        for b in range(a if alike else 0, len(right), step):
            others = right[b : b + step]
            fine = names[some][:, None] != names[others][None, :]
            if alike:
                fine &= some[:, None] < others[None, :]
            if allowed is not None:
                fine &= allowed(some, others)
            p, q = np.flatnonzero(fine.any(axis=1)), np.flatnonzero(fine.any(axis=0))
            if not len(p):
                continue
            fine[np.ix_(p, q)] &= _linked(sets, some[p], others[q], threshold)
            links[some] += fine @ copies[others]
            links[others] += copies[some] @ fine
            for i, j in _forest(fine):
                p, q = top(some[i]), top(others[j])
                if p != q:
                    root[max(p, q)] = min(p, q)
    return [(int(names[i]), int(names[top(i)]), int(links[i])) for i in range(len(names)) if links[i]]


def _forest(fine: np.ndarray):
    """Pairs that connect what all pairs of a block connect: row by row, the columns that no row has had yet, and one
    column of each row that had others before."""
    owner = np.full(fine.shape[1], -1)
    for i in np.flatnonzero(fine.any(axis=1)).tolist():
        at = np.flatnonzero(fine[i])
        before, one = np.unique(owner[at], return_index=True)
        for j in at[owner[at] < 0].tolist() + at[one[before >= 0]].tolist():
            yield i, j
        owner[at] = i


LINKS = "name long, root long, links long, cell long, piece int, parts int, names array<long>, copies array<long>, grams array<long>, usual array<int>, sizes array<int>, items array<int>, sketches array<binary>"
_PACKED = (("names", pa.int64()), ("copies", pa.int64()), ("grams", pa.int64()), ("usual", pa.int32()), ("sizes", pa.int32()), ("items", pa.int32()), ("sketches", pa.binary()))


def _out(links: list, packed: list):
    """Links and packed pieces as rows of one table."""
    n, m = len(links), len(packed)
    columns = [pa.array([x[i] for x in links] + [None] * m, type=pa.int64()) for i in range(3)]
    columns += [pa.array([None] * n + [p[i] for p in packed], type=t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
    columns += [pa.array([None] * n + [p[i + 3] for p in packed], type=pa.list_(t)) for i, (_, t) in enumerate(_PACKED)]
    return pa.RecordBatch.from_arrays(columns, names=["name", "root", "links", "cell", "piece", "parts", *(f for f, _ in _PACKED)])


def _pack(sets: list[np.ndarray], names: np.ndarray, copies: np.ndarray, sketches: list) -> tuple:
    """A piece's dictionary, the numbers of the shingles that most members have, and for each member the numbers of its
    own shingles (size n), or of those by which it differs from most (size -n - 1), whichever are fewer."""
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    where = where.astype(np.int32)
    usual = np.flatnonzero(np.bincount(where, minlength=len(every)) * 2 > len(sets)).astype(np.int32)
    sizes, items = [], []
    for own in np.split(where, np.cumsum([len(s) for s in sets])[:-1]):
        apart = np.setxor1d(own, usual, assume_unique=True)
        sizes.append(-len(apart) - 1 if len(apart) < len(own) else len(own))
        items.append(apart if len(apart) < len(own) else own)
    return names, copies, every.view(np.int64), usual, np.array(sizes, dtype=np.int32), np.concatenate(items), sketches


def _unpack(row: dict) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    names, copies, grams, usual, sizes, items, sketches = (row[f] for f, _ in _PACKED)
    grams, at, sets = grams.view(U), 0, []
    for n in sizes.tolist():
        m = n if n >= 0 else -n - 1
        own = items[at : at + m]
        at += m
        sets.append(grams[own if n >= 0 else np.setxor1d(usual, own, assume_unique=True)])
    return sets, names, copies, sketches


def _met(scheme: Scheme):
    """Verifies the buckets, and packs the pieces of pools."""

    def run(batches):
        links, packed, held = [], [], 0
        for table, bounds in _runs(batches, ["cell", "piece", "band"]):
            piece, name = table.column("piece").to_numpy(), table.column("name").to_numpy()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                at = a + np.flatnonzero(np.concatenate(([True], name[a + 1 : b] != name[a : b - 1])))  # a class that is fetched twice counts once
                rows = table.take(pa.array(at))
                sets = [np.frombuffer(g, dtype=U) for g in rows.column("grams").to_pylist()]
                names, copies, pool = (rows.column(c).to_numpy() for c in ("name", "copies", "pool"))
                if piece[a] >= 0:
                    packed.append((int(rows.column("cell")[0].as_py()), int(piece[a]), int(rows.column("parts")[0].as_py()), *_pack(sets, names, copies, rows.column("sketch").to_pylist())))
                    held += sum(len(s) for s in sets)
                else:
                    signs = _lists(rows.column("signs"), scheme.bands)[:, : rows.column("band")[0].as_py()]
                    every = np.arange(len(names))
                    likely = _likely(scheme, rows.column("sketch").to_pylist())
                    links += _counted(sets, names, copies, every, every, scheme.threshold, lambda i, j, s=signs, p=pool, f=likely: _apart(s[i], p[i], s[j], p[j]) & (f(i, j) if f else True))
                if len(links) > 50_000 or held > 4_000_000:
                    yield _out(links, packed)
                    links, packed, held = [], [], 0
        if links or packed:
            yield _out(links, packed)

    return run


def _likely(scheme: Scheme, sketches: list):
    """scheme.likely by the members' numbers."""
    if scheme.likely is None:
        return None
    own = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), -1)
    return lambda i, j: scheme.likely(own[i], own[j])


def _paired(scheme: Scheme):
    """Verifies all pairs of two packed blocks, or of one with itself."""

    def run(batches):
        for table, bounds in _runs(batches, ["pair", "pair_of"]):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part, piece, rows = table.column("part").to_numpy()[a:b], table.column("piece").to_numpy()[a:b], []
                for i in range(b - a):
                    if i == 0 or piece[i] != piece[i - 1]:
                        rows.append((part[i], _unpack({f: v.to_pylist() if f == "sketches" else v.to_numpy(zero_copy_only=False) for f, _ in _PACKED for v in [table.column(f)[a + i].values]})))
                sets = [s for _, r in rows for s in r[0]]
                names, copies = (np.concatenate([r[i] for _, r in rows]) for i in (1, 2))
                low, high = table.column("pair_of")[a].as_py(), table.column("pair_to")[a].as_py()
                left = np.arange(sum(len(r[0]) for p, r in rows if p == low))
                right = left if low == high else np.arange(len(left), len(sets))  # a block may be empty
                likely = _likely(scheme, [x for _, r in rows for x in r[3]])
                links = _counted(sets, names, copies, left, right, scheme.threshold, likely) if len(left) and len(right) else []
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*links, strict=True)], names=["name", "root", "links"])

    return run


SALTS, PIECES = 64, 8


def _salted(rows: DataFrame, of: str) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int"))


def _with_facts(rows: DataFrame, keys: list[str], of: str, facts: dict, where: str | None = None) -> DataFrame:
    """rows with sums or minima over their group by keys: facts name -> (F.sum or F.min, column). A group is dealt out by
    the hash of its column `of`, so that a hot one spreads over tasks. Groups that where leaves out are left out."""
    salted = _salted(rows, of)
    part = salted.groupBy(*keys, "_salt").agg(*(f(c).alias(n) for n, (f, c) in facts.items()))
    whole = part.groupBy(*keys).agg(*(f(n).alias(n) for n, (f, _) in facts.items()))
    whole = whole.where(where) if where else whole
    return salted.join(part.select(*keys, "_salt").join(whole, keys), [*keys, "_salt"]).drop("_salt")


def _looked_up(rows: DataFrame, key: str, of: str, table: DataFrame) -> DataFrame:
    """rows with the columns of a table that has one row a key, or with nulls; a hot key spreads over tasks."""
    salted = _salted(rows, of)
    found = salted.select(key, "_salt").where(F.col(key).isNotNull()).distinct().join(table, key)
    return salted.join(found, [key, "_salt"], "left").drop("_salt")


def components(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """node, root: the smallest node that edges (a, b) connect it to, for every node of an edge between two."""
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    before, place = None, mark()
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _with_facts(both, ["u"], "v", {"m": (F.min, F.col("v"))}).withColumn("m", F.least("m", "u"))
        large = least.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # the edges of u to its smaller neighbours: each of these, and u, to the smallest of them
        joined = _with_facts(large, ["u"], "v", {"m": (F.min, F.col("v"))})
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(small, "stars")
        drop_since(place, but=1)
        release(edges.sparkSession)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def by_minhash(k: int, threshold: float, recall: float) -> Scheme:
    bands, rows = plan(threshold, recall)
    return Scheme(k, threshold, bands, minhash(bands, rows), lower_words)


def joined(df: DataFrame, id_col: str, text_col: str, scheme: Scheme, bucket: int, block: int, block_bytes: int) -> DataFrame:
    """id, h (hash of the text), n_shingles, class_id, copy_of, n_links and first (whether the row is the one that stands for its group:
    the smallest id, and of several texts under that id the one of smallest hash) of every row."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    signed = written(docs.mapInArrow(_signed(scheme), SIGNED), "signatures")
    place: Column = F.struct(F.col("id").isNull().alias("no"), "id", "h")
    classes = signed.where("n > 0").groupBy("name").agg(F.min(place).alias("place"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("signs").alias("signs"), F.first("sketch").alias("sketch"))

    spread = classes.select("name", "n", F.posexplode("signs").alias("band", "bucket"))
    met = written(_with_facts(spread, ["band", "bucket"], "name", {"m": (F.sum, F.lit(1)), "size": (F.sum, F.col("n").cast("long"))}, "m > 1"), "met")
    large = (F.col("m") > bucket) | (F.col("size") * 8 > block_bytes)
    pooled = _pools(met.where(large), block, block_bytes)
    small = met.where(~large).select("name", "band", "bucket").join(classes.select("name", "signs", *["sketch"] * bool(scheme.likely)), "name").join(pooled.select("name", "pool"), "name", "left").fillna(0, ["pool"])
    owned = small.repartition("band", "bucket").sortWithinPartitions("band", "bucket", "name").mapInArrow(_owners(scheme), "bucket long, band int, name long")
    cells = owned.groupBy("name").agg(F.collect_list(F.struct("bucket", "band")).alias("cells"))  # at most one a band

    asked = written(cells.join(pooled, "name", "full").join(classes.select("name", "place", "copies", "signs", "sketch"), "name").select(F.col("place.id").alias("of_id"), F.col("place.h").alias("of_h"), "name", "copies", "signs", "sketch", "pool", "piece", "parts", "cells"), "asked")
    got = docs.join(asked.hint("shuffle_hash"), docs["id"].eqNullSafe(asked["of_id"]) & (docs["h"] == asked["of_h"])).drop("id", "h", "of_id", "of_h").mapInArrow(_fetched(scheme), CELL)
    found = written(got.repartition("cell", "piece", "band").sortWithinPartitions("cell", "piece", "band", "name").mapInArrow(_met(scheme), LINKS), "links")
    blocks = found.where("cell is not null").select("cell", "piece", F.floor(F.col("piece") / PIECES).cast("int").alias("part"), *(f for f, _ in _PACKED), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = blocks.withColumn("pair", F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other"))).withColumn("pair_of", F.least("part", "other")).withColumn("pair_to", F.greatest("part", "other")).drop("cell", "other")
    between = written(pairs.repartition("pair").sortWithinPartitions("pair", "pair_of", "part", "piece").mapInArrow(_paired(scheme), "name long, root long, links long"), "block-links")

    links = found.where("name is not null").select("name", "root", "links").unionByName(between)
    roots = components(links, "name", "root")
    per_class = links.groupBy("name").agg(F.sum("links").alias("links"))
    alone = classes.select("name", "place", "copies").join(per_class, "name", "left").join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    by_class = _with_facts(alone, ["root"], "name", {"least": (F.min, F.col("place"))}).select("name", "place", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    every = _looked_up(signed.select("id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).alias("name")), "name", "id", by_class)
    first = F.col("name").isNull() | (F.col("least.id").eqNullSafe(F.col("id")) & (F.col("least.h") == F.col("h")))
    return every.select("id", "h", "n_shingles", F.coalesce("least.id", "id").alias("class_id"), F.coalesce("place.id", "id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first.alias("first"))


def _pools(met: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """name, pool, piece, parts: the members of large buckets, in pools of buckets that share members, which are cut into
    parts, or blocks, of PIECES each."""
    if not met.limit(1).count():
        return met.sparkSession.createDataFrame([], "name long, pool long, piece int, parts int")
    hub = F.xxhash64(F.lit(11), "band", "bucket")
    roots = components(met.select("name", hub.alias("hub")), "name", "hub")
    members = met.select("name", "n").distinct().join(roots.select(F.col("node").alias("name"), F.col("root").alias("pool")), "name", "left").withColumn("pool", F.coalesce("pool", "name"))
    sized = _with_facts(members, ["pool"], "name", {"m": (F.sum, F.lit(1)), "size": (F.sum, F.col("n").cast("long"))})
    parts = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("size") * 8 / block_bytes), F.lit(1)).cast("int")
    return written(sized.select("name", "pool", F.pmod(F.xxhash64(F.lit(5), "name"), parts * PIECES).cast("int").alias("piece"), parts.alias("parts")), "pools")


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.999, bucket: int = 256, block: int = 1024, block_bytes: int = 64 << 20) -> DataFrame:
    found = joined(df, id_col, text_col, by_minhash(k, threshold, recall), bucket, block, block_bytes)
    return found.select(F.col("id").alias(id_col), "class_id", "copy_of", "n_links")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.999, bucket: int = 256, block: int = 1024, block_bytes: int = 64 << 20) -> DataFrame:
    """id, h (xxhash64 of the text) and n (rows) of the text that stands for each group, and of each text without words."""
    found = joined(df, id_col, text_col, by_minhash(k, threshold, recall), bucket, block, block_bytes)
    return found.where("first").groupBy(F.col("id").alias(id_col), "h").agg(F.count("*").alias("n"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
