"""Pages with odd markup against a plain tokenizer, and alignment against brute force."""

import html as reference
import random
import re

from pyspark.sql import functions as F

from litforge.operators import losses, pages


def plain(text):
    """One sign at a time."""
    out, i, low = [""], 0, text.lower()
    cut = lambda: out.append("")

    def tag_end(j):
        while j < len(text):
            if text[j] in "\"'":
                j = text.find(text[j], j + 1)
                if j < 0:
                    return -1
            elif text[j] == ">":
                return j + 1
            j += 1
        return -1

    while i < len(text):
        if text.startswith("<!--", i):
            end = text.find("-->", i + 4)
            i = len(text) if end < 0 else end + 3
        elif m := re.match(r"<(script|style)(?=[\s/>])", low[i:]):
            end = tag_end(i + len(m[0]))
            if end < 0:
                out[-1] += text[i]
                i += 1
                continue
            close = re.compile(rf"</{m[1]}[^>]*>").search(low, end)
            i = close.end() if close else len(text)
        elif re.match(r"<[!?][^>]*>", text[i:]):
            i = text.index(">", i) + 1
        elif re.match(r"</?[a-zA-Z]", text[i:]) and tag_end(i + 2 if text[i + 1] != "/" else i + 3) > 0:
            name = re.match(r"</?([a-zA-Z][^\s/>]*)", text[i:])[1].lower()
            if name in pages.BLOCKS:
                cut()
            elif name == "br":
                out[-1] += " "
            i = tag_end(i + 2 if text[i + 1] != "/" else i + 3)
        elif m := re.match(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", text[i:]):
            known = m[1][0] == "#" or m[1] in pages.NAMES
            out[-1] += reference.unescape(m[0]) if known else m[0]
            i += len(m[0])
        else:
            out[-1] += text[i]
            i += 1
    return [t for t in (re.sub(r"[\s\xa0]+", " ", b).strip() for b in out) if t]


ODD = [
    "", "plain", "a<b>b</b>c<br>d", "<p>one<p>two</p>", '<a title="x > y">in</a> out', "<!-- <p>no</p> -->yes<!-- open", "<script>if (a<b) '</p>'</script >after", "<SCRIPT src='a>b'>x</SCRIPT>t<style>p{}</style>",
    "<script>never closed <p>", "1 < 2 and <3", "<a href='open>text", "&amp;lt; &eacute;&#233;&#xE9; &nope; &amp &#0;", "<!DOCTYPE html><?xml v?>x", "a &nbsp; b", "<div><scripty>z</scripty></div>", "<p", "</p >x</p\n>y", "<a><b>&lt;p&gt;</b></a>", "\ue000\ue001x",
    "<p attr=\"'\">quote</p>", "&#1114112;|&#xD800;|&#128512;",
]


def test_odd_markup_is_read_as_plainly(spark):
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<b class='x>'>", "text ", "&amp;", "<!--", "-->", "<script>", "</script>", '"', "<", ">", " a ", "<br/>", "</DIV>", "<style>", "</style>", "&#65;", "'"]
    texts = ODD + ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9000, None)], "page_id long, html string").withColumn("body", F.lit(1))
    got = {r.page_id: r.blocks for r in pages.extracted(df).collect()}
    want = {i: plain(re.sub("[\ue000-\ue004]", "", t)) for i, t in enumerate(texts)}
    for i, t in enumerate(texts):
        assert got[i] == want[i], t
    assert got[9000] is None


def test_boilerplate(spark):
    long = "a sentence of many words that goes on and on so that it counts as content of the page for sure "
    page = f"<nav><ul><li><a href=x>Home page</a><li><a>Other news here</a></ul></nav><h1>A title of five words</h1><p>{long}</p><p>short one</p><p>{long} <a>link</a></p><footer><p>fine print</p><p>a b</p></footer>"
    got = pages.extracted(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()[0].body
    assert got.split("\n") == ["A title of five words", long.strip(), "short one", f"{long.strip()} link", "fine print"]


def test_planted_cuts_are_found(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 300))]
        cut = sorted(rng.sample(range(len(words)), min(3, len(words) // 3)))
        rows.append((i, " ".join(words), " ".join(w for k, w in enumerate(words) if k not in cut), len(cut)))
    rows += [(100, "a b c", "", 3), (101, None, "x", 0), (102, "", None, 0), (103, "same here", "same here", 0), (104, "x " * 900, "x " * 890, 10), (105, "one two three", "three two one", 2)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "id long, before string, after string, n int, lost string")
    for r in losses.lost_spans(df, "before", "after").collect():
        a, b = (r.before or "").split(), (r.after or "").split()
        assert sum(s.words for s in r.lost) == r.n, r.id
        gone = {k for s in r.lost for k in range(s.start, s.start + s.words)}
        assert all(s.text == " ".join(a[s.start : s.start + s.words]) for s in r.lost)
        left, rest = [w for k, w in enumerate(a) if k not in gone], iter(b)
        assert all(w in rest for w in left)  # what is left is a subsequence of the text after


def test_alignment_is_a_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = losses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(losses._common(a, b)) >= len(pairs) >= 0
