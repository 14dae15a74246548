"""Operator 3: secret scans by grammar inference.

Three patterns find the base secrets.  Their credentials are labelled examples
of formats: per kind, a prefix tree of the examples' character classes has its
states merged where a Hoeffding test finds their outgoing frequencies
compatible (the ALERGIA scheme), which gives a probabilistic automaton.  Two
further automata are learnt from ordinary words.  Every token of every whole
text is then a candidate: it is a secret of kind "format" where the best
credential automaton gives it a likelihood per character that is both
plausible in itself and clearly above that of ordinary words.

The automata are fitted on a bounded sample: per kind the ``sample`` distinct
examples of smallest hash, found by a bottom-k sketch in every task, so the
sample is the same however the table is partitioned.  Scanning is per row,
without a shuffle.

Defined results: a null or empty text has no spans; without labelled
credentials no spans are added; repeated rows give repeated results; other
columns are dropped; offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import map_rows, only, shared

KINDS = ("assign", "access", "hex", "format")
WORDS = ("word", "capitals")  # ordinary tokens, the second without small letters

# The base patterns, and the least length of what must be long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # as maximal runs of 16 or more
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
MAX_EXAMPLE = 64  # characters of an example that the tree takes


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, place of the kind, kind, credential, end) in order."""
    out = [(m.start(), 0, "assign", m[2], m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    out += [(m.start(), 1, "access", m[0], m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    out += [(m.start(), 2, "hex", m[0], m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _classes() -> dict[int, str]:
    table = {}
    for a, b, c in (("0", "9", "0"), ("a", "f", "f"), ("g", "z", "z"), ("A", "F", "F"), ("G", "Z", "Z")):
        table |= {i: c for i in range(ord(a), ord(b) + 1)}
    return table


CLASSES = _classes()


class Automaton:
    """A probabilistic automaton over character classes."""

    def __init__(self, examples: list[str], alpha: float = 0.05, unseen: float = -math.inf):
        """``unseen``: bits of a class that a state has no example of."""
        # a state: [arrivals, endings, {class: target}, {class: count}]
        self.states: dict[int, list] = {0: [0, 0, {}, {}]}
        for e in sorted(examples):
            at = 0
            self.states[0][0] += 1
            for c in e[:MAX_EXAMPLE].translate(CLASSES):
                s = self.states[at]
                s[3][c] = s[3].get(c, 0) + 1
                if c not in s[2]:
                    s[2][c] = len(self.states)
                    self.states[s[2][c]] = [0, 0, {}, {}]
                at = s[2][c]
                self.states[at][0] += 1
            self.states[at][1] += 1
        self.alpha, self.unseen = alpha, unseen
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return False
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            x, y = self.states[a], self.states[b]
            if self._differ(x[1], x[0], y[1], y[0]):
                return False
            for c in x[3].keys() | y[3].keys():
                if self._differ(x[3].get(c, 0), x[0], y[3].get(c, 0), y[0]):
                    return False
                if c in x[2] and c in y[2]:
                    todo.append((x[2][c], y[2][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = self.states[a], self.states.pop(b)
            x[0] += y[0]
            x[1] += y[1]
            for c, t in y[2].items():
                x[3][c] = x[3].get(c, 0) + y[3][c]
                if c in x[2]:
                    todo.append((x[2][c], t))
                else:
                    x[2][c] = t

    def _merge(self) -> None:
        red = [0]
        blue = [(0, c) for c in sorted(self.states[0][2])]
        while blue:
            r, c = blue.pop(0)
            b = self.states[r][2][c]
            if b in red:
                continue
            mate = next((x for x in red if self._compatible(x, b)), None)
            if mate is None:
                red.append(b)
                blue += [(b, c2) for c2 in sorted(self.states[b][2])]
                continue
            before = {x: set(self.states[x][2]) for x in red}
            self.states[r][2][c] = mate
            self._fold(mate, b)
            blue += [(x, c2) for x in red for c2 in sorted(set(self.states[x][2]) - before[x])]
        self.log = {k: ({c: math.log2(n / s[0]) for c, n in s[3].items()},
                        math.log2(max(s[1], 0.5) / (s[0] + 1)), s[2]) for k, s in self.states.items()}

    def score(self, token: str) -> float:
        """Log likelihood in bits per character."""
        at, total = 0, 0.0
        for c in token.translate(CLASSES):
            p, _, to = self.log[at]
            if c in p:
                total, at = total + p[c], to[c]
            else:
                total += self.unseen
        return (total + (self.log[at][1] if len(token) <= MAX_EXAMPLE else 0)) / len(token)


class Formats:
    """Credential automata against that of ordinary words.

    ``floor``: bits per character that are plausible for every format; what an
    automaton gives all but the least hundredth of its own examples is so too
    (random keys of many classes have more than 2 bits a character);
    ``margin``: bits per character by which it must beat ordinary words."""

    def __init__(self, examples: dict[str, list[str]], floor: float = -2.0, margin: float = 0.5):
        self.credentials = []  # (automaton, its floor)
        for _, v in sorted((k, v) for k, v in examples.items() if k not in WORDS and v):
            a = Automaton(v)
            self.credentials.append((a, min(floor, sorted(map(a.score, v))[len(v) // 100])))
        self.words = [Automaton(examples[k], unseen=math.log2(1e-3)) for k in WORDS if examples.get(k)]
        self.margin, self.memo = margin, {}

    def secret(self, token: str) -> bool:
        known = self.memo.get(token)
        if known is None:
            best = max((s for a, floor in self.credentials if (s := a.score(token)) >= floor), default=-math.inf)
            known = best > -math.inf and best >= self.margin + max((a.score(token) for a in self.words), default=-math.inf)
            if len(self.memo) >= 100_000:
                self.memo.clear()
            self.memo[token] = known
        return known


def scan(text: str, formats: Formats) -> list[tuple[int, int, str, int]]:
    """(start, place, kind, end): base spans, and tokens of a secret's format outside them."""
    base = [(s, p, k, e) for s, p, k, _, e in base_spans(text)]
    added, at = [], 0
    for m in TOKEN.finditer(text):
        if formats.secret(m[0]):
            while at < len(base) and base[at][3] <= m.start():
                at += 1
            if not any(b[0] < m.end() and b[3] > m.start() for b in base[max(0, at - 2):at + 3]):
                added.append((m.start(), 3, "format", m.end()))
    return sorted(base + added)


def _examples(texts: list[str], sample: int) -> list[tuple[str, str, str]]:
    found = defaultdict(set)
    for t in texts:
        base = base_spans(t)
        for _, _, kind, credential, _ in base:
            found[kind].add(credential)
        taken = {c for *_, c, _ in base}
        words = [w for w in TOKEN.findall(t) if w not in taken and not any(c in w or w in c for c in taken)]
        for w in words:
            found["capitals" if w == w.upper() else "word"].add(w)
    key = lambda v: hashlib.md5(v.encode()).hexdigest()
    return [(k, v, key(v)) for k, vs in found.items() for v in heapq.nsmallest(sample, vs, key=key)]


def fit_formats(docs: DataFrame, sample: int = 400) -> Formats:
    """Automata from at most ``sample`` distinct examples a kind."""
    def run(b):
        rows = _examples(b["text"], sample)
        k, v, h = zip(*rows, strict=True) if rows else ((), (), ())
        return {"kind": k, "value": v, "h": h}

    found = map_rows(only(docs, "text"), run, "kind string, value string, h string")
    # the smallest of each of 256 parts first: a task holds the bests of many others, not all
    best = found.distinct().withColumn("part", F.substring("h", -2, 2))
    for by in (("kind", "part"), ("kind",)):
        best = best.withColumn("nr", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("nr") <= sample)
    examples = defaultdict(list)
    for r in best.select("kind", "value").collect():  # at most 5 * sample short strings
        examples[r["kind"]].append(r["value"])
    return Formats(examples)


def secret_spans(docs: DataFrame, formats: Formats | None = None, sample: int = 400) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans."""
    formats = formats or fit_formats(docs, sample)
    sent = shared(docs.sparkSession, formats)

    def run(b):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans")}
        for t in b["text"]:
            spans = scan(t, sent())
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[2] == k for s in spans))
            text = [f"{k}:{s}:{e}" for s, _, k, e in spans]
            base = ",".join(x for x in text if not x.startswith("format"))
            out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            out["spans"].append(",".join(text))
        return {"doc_id": b["doc_id"]} | out

    return map_rows(only(docs, "doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, "
                    "n_format long, base_sha256 string, spans string")
