"""Operators over documents and their chunks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ours: the words that mark a kind of chunk that is not content, in order.
CATEGORIES = {
    "copyright_license": r"(?i)copyright|licen[cs]e|all rights reserved",
    "publication_metadata": r"(?i)\bdoi\b|10\.[0-9]{4,}/|published online|volume [0-9]+",
    "author_affiliation": r"(?i)department of|university|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}",
    "ui_navigation": r"(?i)\bclick here\b|\bsign in\b|\bnext page\b|\| .* \|",
    "academic_boilerplate": r"(?i)conflicts? of interest|acknowledge?ments?|supplementary",
}


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sep: str = "\n") -> DataFrame:
    """id, pos, chunk in the text's order."""
    return docs.select(id_col, F.posexplode(F.split(text_col, sep)).alias("pos", "chunk"))


def first_of_each(rows: DataFrame, value: str, order: list[str], id_col: str) -> DataFrame:
    """The rows that hold a value first: grouped by the value with the least place, which partial sums bring down to a row a
    task and value before the shuffle; a window over a frequent value would hold all its rows."""
    place = F.struct(*order)
    return rows.groupBy(value).agg(F.min(place).alias("p")).select(F.col(value), "p.*")


def ordinal(df: DataFrame, key: str, name: str = "ord", slices: int | None = None, slice_rows: int = 1 << 20) -> DataFrame:
    """df with 0, 1, 2, ... by rising numeric key (unique). Rows are numbered within key ranges, in parallel; only the
    sizes of the ranges are summed up in one task. There are as many ranges as give each about `slice_rows` rows."""
    if slices is None:
        slices = min(10_000, max(1, -(-df.count() // slice_rows)))
    bounds = sorted(set(df.approxQuantile(key, [i / slices for i in range(1, slices)], min(0.001, 0.1 / slices)))) if slices > 1 else []
    part = _below(bounds, F.col(key))
    sliced = df.withColumn("_slice", part)
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(key)) - 1
    return sliced.withColumn("_in", inside).join(F.broadcast(before), "_slice").withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_slice", "_in", "_before")


def _below(bounds: list[float], key: Column) -> Column:
    """How many of the sorted bounds lie below the key: first by blocks of bounds, then within the block that is left."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    array = lambda values: f"array({', '.join(f'{float(v)!r}D' for v in values)})"
    count = lambda values: F.size(F.filter(values, lambda b: b < key))
    whole = count(F.expr(array([b[-1] for b in blocks])))
    inside = F.get(F.expr(f"array({', '.join(map(array, blocks))})"), whole)
    return whole * step + F.when(whole < len(blocks), count(inside)).otherwise(0)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def first_of_group(df: DataFrame, group: str, order: str) -> DataFrame:
    """All rows of the group that comes first: the one that holds the smallest value of order."""
    first = df.where(F.col(group).isNotNull()).agg(F.min(F.struct(order, group)).alias("p")).select(F.col("p").getField(group).alias(group))
    return df.join(F.broadcast(first), group, "left_semi")  # one row


def split_by_place(df: DataFrame, key: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """df with split: the first int(n * train) rows, the next int(n * val), the rest."""
    n = df.count()
    a = int(n * train)
    b = a + int(n * val)
    return ordinal(df, key).withColumn("split", F.when(F.col("ord") < a, "train").when(F.col("ord") < b, "val").otherwise("test"))


def without_places(df: DataFrame, places: tuple[int, ...], name: str = "ord") -> DataFrame:
    return df.where(~F.col(name).isin(*places))


def category(chunk: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CATEGORIES.items()):
        out = F.when(chunk.rlike(pattern), name).otherwise(out)
    return F.coalesce(out, F.lit("content"))


def retention(before: Column, after: Column, pattern: str) -> Column:
    """The share of a pattern's hits that cleaning has kept; 1 if there were none."""
    n = F.regexp_count(before, F.lit(pattern))
    return F.when(n > 0, F.regexp_count(after, F.lit(pattern)) / n).otherwise(1.0)


def without_categories(chunks: DataFrame, drop: tuple[str, ...], chunk_col: str = "chunk") -> tuple[DataFrame, DataFrame]:
    """The chunks of other categories, and how many of each were removed (category, n). A null chunk is content."""
    of = chunks.withColumn("_category", category(F.coalesce(chunk_col, F.lit(""))))
    gone = of.where(F.col("_category").isin(*drop))
    return of.where(~F.col("_category").isin(*drop)).drop("_category"), gone.groupBy(F.col("_category").alias("category")).agg(F.count("*").alias("n"))


def expand(text: Column, words: dict[str, str]) -> Column:
    """Abbreviations that stand as words of their own become their long forms."""
    if not words:
        return text
    known = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(known[w], w)), " ")


def without_words(text: Column, stop: list[str]) -> Column:
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~F.array_contains(F.array(*map(F.lit, stop)), F.lower(w))), " ")


def lost(before: DataFrame, after: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows that are no longer there, by their key."""
    keys = [key] if isinstance(key, str) else key
    return before.join(after.select(*keys), keys, "left_anti")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: docs, chunks, unique_chunks, average_chunks a document and the reduction that dropping repeated chunks
    makes. Chunks are told apart by their MD5, of which partial counts are shuffled, and not the chunks."""
    each = chunks(docs, id_col, text_col).groupBy(F.md5("chunk").alias("c")).agg(F.count("*").alias("n"))
    of_chunks = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("unique_chunks"))
    of_docs = docs.where(F.col(text_col).isNotNull()).agg(F.countDistinct(id_col).alias("docs"))
    both = of_docs.crossJoin(of_chunks)  # one row each
    return both.select("docs", "chunks", "unique_chunks", (F.col("chunks") / F.nullif("docs", F.lit(0))).alias("average_chunks"), (1 - F.col("unique_chunks") / F.nullif("chunks", F.lit(0))).alias("reduction"))


def plain_html(html: Column) -> Column:
    """Ours: no scripts, styles and tags, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def scraped(pages: DataFrame, html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Pages with their plain text, and the pages of which nothing is left."""
    read = pages.withColumn("body", plain_html(F.col(html_col)))
    fine = F.coalesce(F.length("body") > 0, F.lit(False))
    return read.where(fine), read.where(~fine).drop("body")


def named(text: Column) -> Column:
    """Ours: what looks like the name of a species, a capitalised word and a small one."""
    return F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+ [a-z]{3,})"), F.lit(1))
