"""Operator 6: secrets by fixed patterns, and by automata that are inferred from labelled credentials.

For each label, the credentials make a prefix tree with counts; states that are statistically compatible (Hoeffding's
bound on their ending and on each symbol, down the tree) are merged, of several the one under which the strings below
are likeliest, which gives a probabilistic automaton. A candidate is a maximal run of at least 16 characters out of
letters, digits and + / _ = - that holds a digit or such a beginning. A part of it starts at an occurrence of what all credentials of a label
begin with (where that is over two characters; else at the run's start or after one of + / _ = -), ends at the run's end
or before one of + / _ = -, and is at least as long as the label's shortest credential; its score is the log likelihood
ratio of the label's automaton to evenly spread characters. Of the ways to cut a run into parts of `threshold` nats or
more and rests, the one of the highest sum (of scores above the threshold) is taken, in one pass over the run. A part is
a span under its label; it goes on over characters of the label's credentials, and over the other parts of a JWT. Base
spans stay; spans that lie wholly in one are not added.

What no automaton can tell from evenly spread characters is not found: kinds that have no label, and kinds without a
prefix whose characters are as many as the alphabet's, such as 40 random signs of base64.

One pass without a shuffle; whole texts. Rows: a null text counts as empty and has no spans; rows that repeat give the
same spans each; of parts that tie, the one that ends first, then the first label; other columns are left aside (redact:
kept, whatever their names).
"""

from __future__ import annotations

import math
import os
import random
import re
import string
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex")
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
JOINT = re.compile(r"[+/_=-]")
#: A whole JWT, of which a part is found.
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+){1,2}", re.ASCII)
#: Rows that none of these finds have no base match and no candidate.
MAYBE_BASE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"
MAYBE = r"[A-Za-z0-9+/_=\-]{16}"
#: Public formats of credentials (label, prefix, alphabet, shortest and longest rest).
FORMATS = (
    ("aws", "AKIA", string.ascii_uppercase + string.digits, 16, 16),
    ("digitalocean", "dop_v1_", "0123456789abcdef", 64, 64),
    ("github", "ghp_", string.ascii_letters + string.digits, 36, 36),
    ("github-server", "ghs_", string.ascii_letters + string.digits, 36, 36),
    ("gitlab", "glpat-", string.ascii_letters + string.digits + "_-", 20, 20),
    ("google", "AIza", string.ascii_letters + string.digits + "_-", 35, 35),
    ("hexkey", "", "0123456789ABCDEF", 32, 40),
    ("huggingface", "hf_", string.ascii_letters, 34, 34),
    ("jwt", "eyJ", string.ascii_letters + string.digits + "_-", 16, 80),
    ("npm", "npm_", string.ascii_letters + string.digits, 36, 36),
    ("pypi", "pypi-", string.ascii_letters + string.digits + "_-", 60, 120),
    ("shopify", "shpat_", "0123456789abcdef", 32, 32),
    ("slack", "xoxb-", string.digits + "-", 20, 26),
    ("slack-user", "xoxp-", string.digits + string.ascii_lowercase + "-", 40, 70),
    ("stripe", "sk_live_", string.ascii_letters + string.digits, 24, 24),
    ("stripe-test", "sk_test_", string.ascii_letters + string.digits, 24, 24),
)
#: The chance that is set aside for each symbol that a state has not seen, as a count.
UNSEEN = 0.05


def labelled(per_label: int = 200, seed: int = 6) -> list[tuple[str, str]]:
    """(label, credential) pairs made up by the public formats."""
    rng = random.Random(seed)
    return [(label, prefix + "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))) for label, prefix, chars, low, high in FORMATS for _ in range(per_label)]


class Automaton:
    """A probabilistic deterministic automaton, inferred by merging compatible states of the prefix tree of strings."""

    def __init__(self, strings: list[str], alpha: float = 0.01):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = [{}]
        self.taken: list[dict[str, int]] = [{}]
        self.ends, self.seen = [0], [0]
        for s in strings:
            at = 0
            for c in s:
                self.seen[at] += 1
                self.taken[at][c] = self.taken[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.taken.append({})
                    self.ends.append(0)
                    self.seen.append(0)
                at = self.next[at][c]
            self.seen[at] += 1
            self.ends[at] += 1
        self._merge_all()
        self._freeze()

    def _differ(self, f1, n1, f2, n2) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ends[a], self.seen[a], self.ends[b], self.seen[b]):
                return False
            for c in self.taken[a].keys() | self.taken[b].keys():
                if self._differ(self.taken[a].get(c, 0), self.seen[a], self.taken[b].get(c, 0), self.seen[b]):
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys() if self.next[a][c] != self.next[b][c]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree at b to a, so that it stays deterministic."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, n in self.taken[b].items():
                self.taken[a][c] = self.taken[a].get(c, 0) + n
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _log(self, f: int, n: int) -> float:
        return math.log((f + UNSEEN) / (n + UNSEEN * (len(ALPHABET) + 1)))

    def _fit(self, a: int, b: int) -> float:
        """The log likelihood of the strings below b, read from a on."""
        todo, out = [(a, b)], 0.0
        while todo:
            a, b = todo.pop()
            out += self.ends[b] * self._log(self.ends[a], self.seen[a])
            for c, n in self.taken[b].items():
                out += n * self._log(self.taken[a].get(c, 0), self.seen[a])
                todo.append((self.next[a].get(c, a), self.next[b][c]))
        return out

    def _merge_all(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            frm, c = blue.pop(0)
            b = self.next[frm][c]
            if b in red:
                continue
            like = [r for r in red if self._compatible(r, b)]
            if like:
                r = max(like, key=lambda r: self._fit(r, b))
                self.next[frm][c] = r
                self._fold(r, b)
            else:
                red.append(b)
            blue = sorted({(r, c) for r in red for c, to in self.next[r].items() if to not in red})
        self.states = red

    def _freeze(self) -> None:
        number = {s: i for i, s in enumerate(self.states)}
        self.moves = [{c: (number[to], self._log(self.taken[s].get(c, 0), self.seen[s])) for c, to in self.next[s].items()} for s in self.states]
        self.other = [self._log(0, self.seen[s]) for s in self.states]
        self.stop = [self._log(self.ends[s], self.seen[s]) for s in self.states]
        del self.next, self.taken, self.ends, self.seen

    def likelihood(self, s: str) -> float:
        """Natural logarithm of the chance of s; an unknown symbol costs its smoothed chance and stays in its state."""
        at, out = 0, 0.0
        for c in s:
            to = self.moves[at].get(c)
            out += to[1] if to else self.other[at]
            at = to[0] if to else at
        return out + self.stop[at]


class Scanner:
    def __init__(self, credentials: list[tuple[str, str]] | None = None, threshold: float = 2.0):
        groups: dict[str, list[str]] = {}
        for label, s in labelled() if credentials is None else credentials:
            groups.setdefault(label, []).append(s)
        self.automata = {k: Automaton(v) for k, v in sorted(groups.items())}
        self.prefix = {k: os.path.commonprefix(v) for k, v in groups.items()}
        self.rest = {k: {c for s in v for c in s[len(self.prefix[k]) :]} for k, v in groups.items()}
        self.least = {k: min(map(len, v)) for k, v in groups.items()}
        self.signs = re.compile("|".join(re.escape(p) for p in self.prefix.values() if len(p) > 2) or r"(?!)")
        self.threshold = threshold
        self.order = {k: i for i, k in enumerate([*KINDS, *self.automata])}

    def score(self, s: str) -> tuple[float, str]:
        even = len(s) * math.log(1 / (len(ALPHABET) + 1))
        return max(((a.likelihood(s) - even, k) for k, a in self.automata.items()), default=(-math.inf, ""))

    def _starts(self, s: str, joints: list[int]) -> dict[str, set[int]]:
        """Where the parts of each label may start."""
        after, out = {0, *(j + 1 for j in joints)}, {}
        for label, prefix in self.prefix.items():
            if len(prefix) <= 2:
                out[label] = after
            elif prefix in s:
                out[label] = {m.start() for m in re.finditer(f"(?={re.escape(prefix)})", s)}
        return {label: at for label, at in out.items() if len(s) - min(at) >= self.least[label]}

    def parts(self, s: str) -> list[tuple[int, int, str]]:
        """The spans in a run. Parts of a label that meet in a state go on alike, so that of them the better stays; those
        too short to end are kept apart."""
        joints = [m.start() for m in JOINT.finditer(s)]
        starts, ends, even = self._starts(s, joints), {*joints, len(s)}, math.log(1 / (len(ALPHABET) + 1))
        if not starts:
            return []
        best, last = [0.0] * (len(s) + 1), [None] * (len(s) + 1)  # of what lies before each place: the sum, and the part that ends there
        long = {label: {} for label in starts}  # state: sum, start
        young = {label: [] for label in starts}  # state, sum, start
        for i in range(len(s) + 1):
            if i:
                best[i] = best[i - 1]
            if i in ends:
                for label in starts:
                    stop = self.automata[label].stop
                    for at, (total, start) in long[label].items():
                        if total + stop[at] - self.threshold >= best[i] and last[i] is None or total + stop[at] - self.threshold > best[i]:
                            best[i], last[i] = total + stop[at] - self.threshold, (start, label)
            if i == len(s):
                break
            c = s[i]
            for label, at_start in starts.items():
                if i in at_start:
                    young[label].append((0, best[i], i))
                if not young[label] and not long[label]:
                    continue
                automaton, least, step, still = self.automata[label], self.least[label], {}, []
                for at, total, start in [*((at, *v) for at, v in long[label].items()), *young[label]]:
                    to = automaton.moves[at].get(c)
                    total += (to[1] if to else automaton.other[at]) - even
                    at = to[0] if to else at
                    if i + 1 - start < least:
                        still.append((at, total, start))
                    elif at not in step or total > step[at][0]:
                        step[at] = total, start
                long[label], young[label] = step, still
        out, i = [], len(s)
        while i > 0:
            if last[i] is None:
                i -= 1
                continue
            start, label = last[i]
            end, limit = i, out[-1][0] if out else len(s)
            while end < limit and s[end] in self.rest[label]:
                end += 1
            out.append((start, end, label))
            i = start
        return out[::-1]

    def base(self, text: str) -> list[tuple[int, int, str]]:
        found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_ASSIGN]
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]{%d,}" % MIN_HEX, text)]
        return sorted(found, key=lambda x: (x[0], self.order[x[2]]))

    def more(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        begin, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))

        def inside(start: int, end: int) -> bool:
            """Whether a base span holds it: of those that start no later, the one that reaches farthest."""
            i = bisect_right(begin, start) - 1
            return i >= 0 and reach[i] >= end

        out = []
        for m in CANDIDATE.finditer(text):
            s = m.group()
            if not s.isalpha() and (any(c.isdigit() for c in s) or self.signs.search(s)) and not inside(m.start(), m.end()):
                found = [(m.start() + a, m.start() + b, label) for a, b, label in self.parts(s)]
                out += [x for x in found if not inside(*x[:2])]
        if any(label == "jwt" for _, _, label in out):
            whole, at, wider = [m.span() for m in JWT.finditer(text)], 0, set()
            for a, b, label in sorted(out):
                while at < len(whole) and whole[at][1] <= a:
                    at += 1
                if label == "jwt" and at < len(whole) and whole[at][0] < b:
                    a, b = min(a, whole[at][0]), max(b, whole[at][1])
                wider.add((a, b, label))
            out = sorted(wider)
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, str]]:
        """All spans (start, end, kind) by start, then kind as listed, then label."""
        base = self.base(text or "")
        return sorted(base + self.more(text or "", base), key=lambda x: (x[0], self.order[x[2]]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """A row for each row of df: its id and spans array<struct<start, end, kind>> in code points, end exclusive."""
    scanner = scanner or Scanner()

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            base = pc.fill_null(pc.match_substring_regex(column, MAYBE_BASE), False).to_pylist()
            maybe = pc.fill_null(pc.match_substring_regex(column, MAYBE), False).to_pylist()
            out = []
            for i in range(batch.num_rows):
                found = []
                if base[i] or maybe[i]:
                    text = column[i].as_py()
                    found = scanner.base(text) if base[i] else []
                    if maybe[i]:
                        found = sorted(found + scanner.more(text, found), key=lambda x: (x[0], scanner.order[x[2]]))
                out.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))], names=["id", "spans"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, spans array<struct<start:long,end:long,kind:string>>").withColumnRenamed("id", id_col)


def redact(df: DataFrame, text_col: str = "text", scanner: Scanner | None = None, mark: str = "[SECRET]") -> DataFrame:
    """df with each span of a secret in the text replaced by the mark (overlapping spans by one)."""
    scanner = scanner or Scanner()

    def clean(text):
        out, at = [], 0
        for a, b, _ in scanner.scan(text):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]]) if at else text

    def run(batches):
        for batch in batches:
            column = batch.column(text_col)
            hit = pc.fill_null(pc.match_substring_regex(column, f"{MAYBE_BASE}|{MAYBE}"), False).to_pylist()
            new = pa.array([clean(column[i].as_py()) if h else column[i].as_py() for i, h in enumerate(hit)], type=column.type)
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, new)

    return df.mapInArrow(run, df.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
