"""Abbreviations and sentence bounds that are learned from the texts themselves, by counts over the corpus.

Rows: null texts have no definitions and no sentences; a null id counts as an id. Texts that repeat count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a bracket with a short form begins with, and how many words before it are looked at.
_BRACKET, _BEFORE = r"^([\p{L}\p{N}][\p{L}\p{N}-]{1,9})\)", 20
_SHORT = r"^[\p{L}\p{N}][\p{L}\p{N}-]*$"


def long_form(words: Column, short: Column) -> Column:
    """The words before a bracket that a short form stands for: its letters and digits, from right to left, each at the
    nearest place before the last one found, the first at the begin of a word. That is the last word's begin from which the
    others follow in order. Null if there is none, or if it is longer than min(n + 5, 2n) words of n letters."""
    signs = F.filter(F.split(F.lower(short), ""), lambda c: c.rlike(r"[\p{L}\p{N}]"))
    onward = F.array_join(F.transform(F.slice(signs, 2, 100), lambda c: F.concat(F.lit("[^"), c, F.lit("]*"), c)), "")
    pattern = F.concat(F.lit(r"(?ius)^(?:.*[^\p{L}\p{N}])?("), F.get(signs, F.lit(0)), onward, F.lit(r".*)$"))
    found = F.call_function("regexp_extract", F.trim(words), pattern, F.lit(1))
    n = F.size(signs)
    fits = (F.length(found) > F.length(short)) & (F.size(F.split(found, r"\s+")) <= F.least(n + 5, 2 * n))
    return F.when(fits & short.rlike(r"\p{L}") & short.rlike(_SHORT), found)


def definitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, place, short, long: what texts define as "long form (SF)"."""
    parts = F.split(text_col, r"\(", -1)
    last = lambda ws: F.slice(ws, F.greatest(F.size(ws) - _BEFORE + 1, F.lit(1)), _BEFORE)

    def one(part: Column, i: Column) -> Column:
        before = F.substring_index(F.get(parts, i - 1), ")", -1)
        words = lambda short: F.when((short != "") & before.rlike(r"\S\s+$"), F.struct(F.array_join(F.get(F.transform(F.array(F.filter(F.split(before, r"\s+"), lambda w: w != "")), last), F.lit(0)), " ").alias("words"), short.alias("short")))
        return F.when(i > 0, F.get(F.transform(F.array(F.regexp_extract(part, _BRACKET, 1)), words), F.lit(0)))

    found = F.filter(F.transform(parts, one), lambda h: h.isNotNull())
    each = docs.where(F.col(text_col).contains("(")).select(F.col(id_col).alias("id"), F.posexplode(found).alias("place", "h")).select("id", "place", "h.*")
    return each.select("id", "place", "short", long_form(F.col("words"), F.col("short")).alias("long")).where("long is not null")


def dictionary(found: DataFrame, least: int = 2, share: float = 0.6) -> DataFrame:
    """short, long of the corpus: the long form, in lower case, that most texts give a short form, if at least `least` texts
    and a share of those that define it do; equally many go by the long form."""
    own = found.select("id", "short", F.lower("long").alias("long")).distinct()
    n = own.groupBy("short", "long").agg(F.count("*").alias("n"))
    first = n.groupBy("short").agg(F.min_by("long", F.struct(-F.col("n"), "long")).alias("long"), F.sum("n").alias("all"), F.max("n").alias("n"))
    return first.where((F.col("n") >= least) & (F.col("n") >= share * F.col("all"))).select("short", "long")


def expanded(docs: DataFrame, found: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `expanded`: short forms that stand as words between blanks become the long form that their text gives them
    first, or else the corpus's. Only ids and short forms are joined, of words only those that the corpus knows; a text of an
    id that repeats takes all that its id defines. If found and known are stored tables, a small known is broadcast and the
    texts' words are not shuffled."""
    own = found.groupBy("id", "short").agg(F.min_by(F.lower("long"), F.struct("place", "long")).alias("long"))
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.filter(F.split(text_col, " "), lambda w: w.rlike(_SHORT) & (F.length(w) <= 10)))).alias("short"))
    met = words.join(known, "short").select("id", "short", "long").distinct()  # a short form has one long form in known
    given = own.select(F.col("id").alias("of"), F.col("short").alias("given")).hint("merge")
    met = met.join(given, F.col("id").eqNullSafe(F.col("of")) & (F.col("short") == F.col("given")), "left").where("given is null").select("id", "short", "long")  # an anti join would be done before the other, on all words
    maps = own.select("id", "short", "long").unionByName(met).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("short", "long"))).alias("_forms"))
    maps = maps.withColumnRenamed("id", "_of")
    joined = docs.join(maps.hint("merge"), docs[id_col].eqNullSafe(maps["_of"]), "left").drop("_of")
    swap = F.array_join(F.transform(F.split(text_col, " "), lambda w: F.coalesce(F.col("_forms")[w], w)), " ")
    return joined.withColumn("expanded", F.when(F.col("_forms").isNull(), F.col(text_col)).otherwise(swap)).drop("_forms")


_END = r"[.!?][\"'”’)\]]*$"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _kind(word: Column) -> Column:
    """A word in lower case without the stop at its end."""
    return F.lower(F.regexp_replace(word, r"\.$", ""))


def abbreviations(docs: DataFrame, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """kind, score of words that stop signs belong to. Of each kind of word the counts with and without a stop are
    compared by the log likelihood ratio of "the stop always follows" against "it follows as often as anywhere"; the
    score falls with the length of the word and with its uses without a stop, and rises with stops inside."""
    each = docs.select(F.explode(_words(F.col(text_col))).alias("w")).where(F.col("w").rlike(r"\p{L}"))
    counts = each.groupBy(_kind(F.col("w")).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("w").endswith(".")).alias("k"))
    total = counts.agg(F.sum("n").alias("all"), F.sum("k").alias("stops"))
    rated = counts.where("k > 0").join(F.broadcast(total))  # one row
    p, k, n = F.col("stops") / F.col("all"), F.col("k"), F.col("n")
    log = lambda x, y: F.when(x > 0, x * F.log(y)).otherwise(0.0)
    ratio = 2 * (log(k, F.lit(0.99)) + log(n - k, F.lit(0.01)) - log(k, p) - log(n - k, F.when(p < 1, 1 - p).otherwise(1e-9)))
    signs = F.length(F.regexp_replace("kind", r"\.", ""))
    score = ratio * F.exp(-signs.cast("double")) * (1 + F.length("kind") - signs) * F.pow(signs.cast("double"), -(n - k).cast("double"))
    return rated.select("kind", F.round(score, 6).alias("score")).where((F.col("score") >= least) & (signs > 0))


def sentences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `sentences`: texts cut behind words that end in a stop, question or exclamation mark, but not behind a known
    abbreviation. Only each text's different abbreviations are joined. Words in a sentence have one blank between them."""
    stops = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.transform(F.filter(_words(F.col(text_col)), lambda w: w.endswith(".")), _kind))).alias("kind")).distinct()
    own = stops.join(known.select("kind"), "kind").groupBy("id").agg(F.collect_set("kind").alias("_short")).withColumnRenamed("id", "_of")
    joined = docs.join(own, docs[id_col].eqNullSafe(own["_of"]), "left").drop("_of")

    def cut(words: Column) -> Column:
        held = F.coalesce(F.col("_short"), F.array().cast("array<string>"))
        ends = lambda w, i: (i == F.size(words) - 1) | (w.rlike(_END) & ~(w.endswith(".") & F.array_contains(held, _kind(w))))
        places = F.filter(F.transform(words, lambda w, i: F.when(ends(w, i), i)), lambda i: i.isNotNull())
        begin = lambda ps, j: F.when(j > 0, F.get(ps, F.greatest(j - 1, F.lit(0))) + 1).otherwise(0)
        slices = lambda ps: F.transform(ps, lambda p, j: F.array_join(F.slice(words, begin(ps, j) + 1, p - begin(ps, j) + 1), " "))
        return F.get(F.transform(F.array(places), slices), F.lit(0))

    found = F.get(F.transform(F.array(_words(F.col(text_col))), cut), F.lit(0))
    return joined.withColumn("sentences", found).drop("_short")
