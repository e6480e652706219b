"""Words that scanning has garbled, corrected by the corpus's own words in a noisy channel.

A rare word may stand for a frequent one that is one edit away: one sign left out, put in, changed, or two that look like
one (rn and m, cl and d, vv and w) or like each other (0 and o, 1 and l, 5 and s). Candidates meet in an index of the words'
own forms and of what is left of them when a sign is deleted, by a join; each is weighed by its frequency and by the
channel: what looks alike is likelier. A word is corrected to the best candidate if that outweighs the word itself by
`odds`. All are counts and joins over the vocabulary; the texts are only counted and, at last, looked up.

Rows: null texts have no words and stay null. A null id is an id. Candidates that weigh the same go by the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs that look alike in print, each as what the first is folded to.
ALIKE = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("0", "o"), ("1", "l"), ("5", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"))
WORD = r"^[\p{Ll}0-9ﬁﬂ]{4,40}$"


def folded(word: Column) -> Column:
    out = word
    for a, b in ALIKE:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n of the words between blanks that are all small letters or digits, with a letter, of 4 to 40 signs."""
    each = docs.select(F.explode(F.split(text_col, r"\s+")).alias("word"))
    return each.where(F.col("word").rlike(WORD) & F.col("word").rlike(r"\p{Ll}")).groupBy("word").agg(F.count("*").alias("n"))


def corrections(words: DataFrame, rare: int = 2, frequent: int = 20, odds: float = 10.0, look: float = 100.0) -> DataFrame:
    """word, correct, weight: for words that occur at most `rare` times, the frequent word that they stand for. A look-alike
    outweighs another edit by `look`."""
    near = lambda w: F.array_distinct(F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
    keys = lambda df: df.select("word", "n", F.explode(F.concat(near(F.col("word")), F.array(F.concat(F.lit("="), folded(F.col("word")))))).alias("key"))
    asked, known = keys(words.where(F.col("n") <= rare)), keys(words.where(F.col("n") >= frequent)).withColumnsRenamed({"word": "correct", "n": "of"})
    pairs = asked.join(known, "key").select("word", "n", "correct", "of").distinct()
    alike = folded(F.col("word")) == folded(F.col("correct"))
    fits = pairs.where(alike | (F.levenshtein("word", "correct") == 1))
    weighed = fits.select("word", "n", "correct", (F.col("of") * F.when(alike, look).otherwise(1.0) / F.col("n")).alias("weight"))
    best = weighed.groupBy("word").agg(F.min_by(F.struct("correct", "weight"), F.struct(-F.col("weight"), "correct")).alias("b"))
    return best.select("word", "b.correct", F.round("b.weight", 6).alias("weight")).where(F.col("weight") >= odds)


def corrected(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `corrected`: garbled words replaced, all else as it is. Only ids and rare words are joined."""
    words = docs.select(F.col(id_col).alias("_of"), F.explode(F.array_distinct(F.filter(F.split(text_col, r"\s+"), lambda w: w.rlike(WORD)))).alias("word"))
    maps = words.join(found.select("word", "correct"), "word").groupBy("_of").agg(F.map_from_entries(F.collect_set(F.struct("word", "correct"))).alias("_swap"))
    joined = docs.join(maps, docs[id_col].eqNullSafe(maps["_of"]), "left").drop("_of")
    pieces = F.regexp_extract_all(text_col, F.lit(r"\s+|\S+"), F.lit(0))
    swap = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.col("_swap")[p], p)), "")
    return joined.withColumn("corrected", F.when(F.col("_swap").isNull(), F.col(text_col)).otherwise(swap)).drop("_swap")
