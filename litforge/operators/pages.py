"""Text of HTML pages: a tokenizer, and removal of boilerplate by the density of words and links in blocks.

A page is read once from left to right: comments, elements whose content is no text (script, style), declarations, and tags,
whose attributes may hold `>` in quotes. What lies between is text, whose references (`&amp;`, `&#233;`, `&#xe9;`) are decoded;
a tag or a quote that never ends is text, and so is a reference without its semicolon or of a name that isn't known.
Tags of blocks cut the text, line breaks are blanks, other tags leave no trace. All is column expressions.

A block is kept or not by a small decision tree over the number of its words and of those in links, and the same of the blocks
before and after it.

Rows: a null page has null texts; a page without text has no block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a block.
BLOCKS = tuple("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: The names of some characters.
NAMES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "deg": "°", "micro": "µ", "times": "×", "divide": "÷", "plusmn": "±", "para": "¶", "sect": "§", "euro": "€", "pound": "£",
    "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "ccedil": "ç", "ntilde": "ñ", "oacute": "ó", "iacute": "í", "aacute": "á", "uacute": "ú",
}
#: Signs of our own between tokens; a page that holds them loses them.
MARKUP, TEXT, CUT, LINK, UNLINK = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_HIDDEN = rf"<!--.*?(?:-->|\z)|<script(?=[\s/>]){_REST}>.*?(?:</script[^>]*>|\z)|<style(?=[\s/>]){_REST}>.*?(?:</style[^>]*>|\z)|<[!?][^>]*>"
_TOKEN = rf"(?is)(?:{_HIDDEN})|(</?[a-z]{_REST}>)"
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"


def _once(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decoded(text: Column) -> Column:
    """Text with its references replaced by the characters they name; numbers of no character are U+FFFD."""
    known = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, _REFERENCE, 1)
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 9), 16, 10)).otherwise(F.substring(name, 2, 9)).cast("long")
        fine = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        sign = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")
        value = F.when(name.startswith("#"), sign).otherwise(known[name])
        return F.when((name != "") & value.isNotNull(), F.concat(value, rest)).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&", -1)
    return F.when(text.contains("&"), F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(one(p))), "")).otherwise(text)


def marked(html: Column) -> Column:
    """A page's text with CUT between blocks and LINK, UNLINK around the text of links."""
    clean = F.translate(html, MARKUP + TEXT + CUT + LINK + UNLINK, "")
    tokens = F.split(F.regexp_replace(clean, _TOKEN, f"{MARKUP}$1{TEXT}"), MARKUP, -1)

    def one(token: Column, i: Column) -> Column:
        tag, text = F.substring_index(token, TEXT, 1), F.substring(token, F.instr(token, TEXT) + 1, F.length(token))
        name = F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][^\s/>]*)", 1))
        sign = F.when(name.isin(*BLOCKS), CUT).when(name == "br", " ").when(name == "a", F.when(tag.startswith("</"), UNLINK).otherwise(LINK)).otherwise("")
        return F.when(i == 0, decoded(token)).otherwise(F.concat(sign, decoded(text)))

    return F.array_join(F.transform(tokens, one), "")


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\s\x{a0}]+"), lambda w: w != ""))


def blocks(html: Column) -> Column:
    """array<struct<text, words, linked>> of the blocks that have words: white space is collapsed; linked is how many words lie
    in links. A link that isn't closed ends with its block."""

    def one(block: Column) -> Column:
        inside = F.array_join(F.regexp_extract_all(block, F.lit(f"{LINK}([^{UNLINK}]*)"), F.lit(1)), " ")
        text = F.trim(F.regexp_replace(F.translate(block, LINK + UNLINK, ""), r"[\s\x{a0}]+", " "))
        return F.struct(text.alias("text"), _words(text).alias("words"), _words(F.translate(inside, LINK, "")).alias("linked"))

    return F.filter(F.transform(F.split(marked(html), CUT, -1), one), lambda b: b["words"] > 0)


def content(found: Column) -> Column:
    """The blocks that are no boilerplate. A block of links (more than a third of its words) is; of others it depends on how
    many words they have, and the blocks before and after."""

    def keep(b: Column, i: Column) -> Column:
        words = lambda j: F.coalesce(F.get(found, j)["words"], F.lit(0))
        before, after = F.when(i > 0, words(F.greatest(i - 1, F.lit(0)))).otherwise(0), words(i + 1)
        links = F.when(i > 0, F.get(found, F.greatest(i - 1, F.lit(0)))["linked"] / words(F.greatest(i - 1, F.lit(0)))).otherwise(0.0)
        plain = F.when(b["words"] > 16, True).when(after > 15, True).otherwise(before > 4)
        beside = F.when(b["words"] > 40, True).otherwise(after > 17)
        return F.when(b["linked"] * 3 > b["words"], False).when(links * 9 <= 5, plain).otherwise(beside)

    return F.filter(found, keep)


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with `blocks` (all, as texts) and `body`, the kept ones, a line each."""
    both = lambda b: F.struct(F.transform(b, lambda x: x["text"]).alias("blocks"), F.array_join(F.transform(content(b), lambda x: x["text"]), "\n").alias("body"))
    page = F.col(f"`{html_col}`")
    rest = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("blocks", "body")]
    # generated from an array of one, the blocks are worked out once
    found = pages.select(*rest, F.explode(F.array(F.when(page.isNotNull(), _once(blocks(page), both)))).alias("_p"))
    return found.select(*rest, "_p.blocks", "_p.body")
