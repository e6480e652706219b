"""Text cleaning as column expressions. The order of the replacements is part of each chain's meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes that Java, RE2 and Python's Unicode `\\s` and `\\d` agree on.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
DIGIT = r"\p{Nd}"
#: The characters of WS.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Fixed values of the junk test and of the truncations.
MIN_CHUNK, MAX_TEXT, MAX_PROMPT, MAX_RAW = 30, 48_000, 6_000, 500
REFERENCE = r"\[DOI\]|\[PubMed\]|\[PMC"
DOI_START = rf"^10\.{DIGIT}{{4,}}/"
#: Fixed value: the characters of Python's Unicode `\\w`.
WORD = r"\p{L}\p{N}_"
EMAIL = rf"[{WORD}.+-]+@[{WORD}.-]+\.[{WORD}]+"

#: Ours: identifiers of articles, and signs that text from scans holds but that mean nothing.
IDS = r"(?i)pmc[0-9]{4,}|pmid:? ?[0-9]+|(?:doi:? ?)?10\.[0-9]{4,}/[^ \t\n\])},;]+"
SCAN_MARKS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{ad}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column, ws: str = WS) -> Column:
    return F.regexp_replace(c, f"{ws}+", " ")


def tighten(c: Column, ws: str = WS) -> Column:
    """No space before . , ; :"""
    return F.regexp_replace(c, f"{ws}+([.,;:])", "$1")


def space_after_stop(c: Column, ws: str = WS) -> Column:
    return F.regexp_replace(c, f"([.!?]){ws}*([a-z])", "$1 $2")


def drop_citations(c: Column, ws: str = WS) -> Column:
    """[n], [n-m] with hyphen or en dash, then [n, m, ...]; mixed lists stay."""
    c = F.regexp_replace(c, rf"\[{DIGIT}+(?:[-–]{DIGIT}+)?\]", "")
    return F.regexp_replace(c, rf"\[{DIGIT}+(?:,{ws}*{DIGIT}+)*\]", "")


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z])([A-Z][a-z])", "$1. $2")


def one_period(c: Column) -> Column:
    return F.regexp_replace(c, r"\.{2,}", ".")


# once white space is collapsed, a blank is all there is of it, and a blank is found faster than a class of signs


def post_process(c: Column) -> Column:
    """What follows a model's answer: white space first, citations after punctuation, collapsed again at the end."""
    tidy = drop_citations(space_after_stop(tighten(collapse(c), " "), " "), " ")
    return strip(F.regexp_replace(one_period(split_camel(tidy)), " {2,}", " "))


def fallback_clean(c: Column) -> Column:
    """What stands in for a model: citations before punctuation, no second collapse."""
    return strip(space_after_stop(tighten(drop_citations(collapse(c), " "), " "), " "))


def join_chunks(chunks: Column) -> Column:
    return F.array_join(chunks, " ")


def is_junk(chunk: Column) -> Column:
    """Short, full of reference marks or e-mail addresses, or starting with a DOI. A pattern is searched for only where a
    character is found that all its hits hold."""
    s = strip(chunk)
    often = lambda sign, pattern: F.contains(s, F.lit(sign)) & (F.regexp_count(s, F.lit(pattern)) >= 3)
    return (F.length(s) < MIN_CHUNK) | often("[", REFERENCE) | (F.startswith(s, F.lit("10.")) & s.rlike(DOI_START)) | often("@", EMAIL)


def merge_chunks(chunks: Column, most: int = MAX_TEXT) -> Column:
    """The chunks that aren't junk, joined by a blank after a sentence's end and by '. ' elsewhere; cut to `most` code points."""
    ended = lambda s: F.regexp_replace(s, f"{WS}+$", "").rlike(r"[.!?]$")
    kept = lambda xs: F.array_join(F.transform(xs, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.when(ended(F.get(xs, i - 1)), " ").otherwise(". "), x))), "")
    return F.substring(F.get(F.transform(F.array(F.filter(chunks, lambda x: ~is_junk(x))), kept), F.lit(0)), 1, most)


def truncated(c: Column, most: int = MAX_RAW) -> Column:
    return F.substring(c, 1, most)


def prompt(prefix: str, text: Column, suffix: str) -> Column:
    return F.concat(F.lit(prefix), text, F.lit(suffix))


def answer(response: Column, marker: str, header: str, last: str = "TEXT TO CLEAN:") -> Column:
    """What follows the last marker; else what follows the last header, without the marker; else what follows `last`."""
    after = lambda m: F.substring_index(response, m, -1)
    return strip(F.when(F.contains(response, F.lit(marker)), after(marker)).when(F.contains(response, F.lit(header)), F.replace(after(header), F.lit(marker), F.lit(""))).otherwise(after(last)))


def sentences(c: Column) -> Column:
    return F.split(c, rf"(?<=[.!?]){WS}+")


def credentials(key: Column) -> Column:
    """The value of an authorisation header: the key as JSON, in base64."""
    body = F.concat(F.lit('{"secret_key": '), F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit("}"))
    return F.concat(F.lit("Bearer "), F.base64(F.encode(body, "UTF-8")))


def shown(value: Column, places: int = 1, unit: str = "", missing: str = "—") -> Column:
    """A number with a fixed number of decimals and its unit; a dash where there is none."""
    return F.when(value.isNull(), missing).otherwise(F.concat(F.format_string(f"%.{places}f", value.cast("double")), F.lit(unit)))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def drop_ids(c: Column) -> Column:
    """Ours: without PMC numbers, PubMed numbers and DOIs."""
    return F.regexp_replace(c, IDS, "")


def drop_scan_marks(c: Column) -> Column:
    """Ours: words that a scan has cut at a line's end are joined, ligatures are spelt out, control signs and soft hyphens go."""
    joined = F.regexp_replace(c, "([a-z])-\n([a-z])", "$1$2")
    return F.regexp_replace(F.replace(F.replace(joined, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), SCAN_MARKS, "")
