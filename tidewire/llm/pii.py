"""Personal data: exact patterns, and a semi-Markov conditional random field that adds spans."""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches

#: The base patterns.
BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
"""Labels of the field. The last two have no base pattern."""
MOST_CHARS = 43
"""Characters of the longest segment that any shape but that of spelt-out addresses describes (a bank account number with
its blanks); addresses are taken whole, so no candidate is lost by it."""
CONTEXT = 3
"""Words around a trigger that belong to its region."""
REACH = 80
"""Characters looked through for a context word's end; local parts and labels of addresses have 64 and 63 at most."""
TRAINED_ON = 240
"""Made-up sentences that the field is fitted on."""
MARGIN = 0.75
"""An added span's share of the probability of all readings of its region, at least."""

_PATTERN = {k: re.compile(p) for k, p in BASE}
_RUN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        s += d - 9 * (d > 9)
    return s % 10 == 0


def _passes(kind: str, s: str) -> bool:
    if kind == "ip":
        parts = [x.lstrip("0") for x in s.split(".")]
        return all(len(x) <= 3 and int(x or "0") <= 255 for x in parts)
    if kind == "card":
        d = s.replace(" ", "").replace("-", "")
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_DIGITS.findall(s)) <= 15
    return True


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the ip pattern: every four parts of each run of digits and dots, which is read once."""
    at = 0
    while m := _RUN.search(text, at):
        at = m.end()
        if text.count(".", m.start(), at) < 3:
            continue
        i = m.start()
        parts = m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            j = i + sum(map(len, parts[k : k + 4])) + 3
            yield i, j
            i = j + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then start. Every pattern reads each character a bounded number of
    times, however long a run of digits or blanks is."""
    out = []
    if "@" in text:
        at = text.find("@")
        free = 0
        while at >= 0:
            i = at  # the local part is the run before the sign, as far as it is free
            while i > free and _LOCAL.match(text[i - 1]):
                i -= 1
            if i < at and (m := _DOMAIN.match(text, at)):
                out.append(("email", i, m.end()))
                free = m.end()
            at = text.find("@", at + 1)
    out += [("ip", i, j) for i, j in _addresses(text) if _passes("ip", text[i:j])]
    out += [("card", m.start(), m.end()) for m in _PATTERN["card"].finditer(text) if _passes("card", m[0])]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PATTERN["phone"].finditer(text) if _passes("phone", m[0])]
    return out


# -- the field ---------------------------------------------------------------

_NEAR = re.compile(r"[0-9]+|\[(?:at|dot)\]|\((?:at|dot)\)|\bat\b(?=[^\n]{1,65}\bdot\b)|\bdot\b")
"""Runs of triggers, and the dots of addresses: what a region reaches around. A label of 63 characters and two blanks stand
between at and dot at most."""
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|[^\s]")
#: What whole spans look like.
_SHAPES = (
    ("groups", r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}"),
    ("national", r"0[0-9]{1,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,5}"),
    ("three_two_four", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("account", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    ("spelt", r"[A-Za-z0-9._+-]+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]+(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z]{2,})+"),
    ("date", r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"),
    ("number", r"[0-9]+(?:[.,][0-9]+)*"),
    ("bracketed", r"[A-Za-z0-9._+-]+ ?(?:\[at\]|\(at\)) ?[^\n]+"),
)
_SHAPE = [re.compile(p) for _, p in _SHAPES]
_BOUNDED = [p for (name, _), p in zip(_SHAPES, _SHAPE, strict=True) if name in ("groups", "national", "three_two_four", "account", "date")]
_START = re.compile(r"[(0-9]|[A-Z]{2}[0-9]")
"""How segments of the bounded shapes begin."""
_SPELT = re.compile(r"[A-Za-z0-9._+-]+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]+(?:(?: ?(?:\[dot\]|\(dot\)) ?| dot |\.)[A-Za-z]{2,})+")
"""A whole spelt-out address; a full stop with a blank ends it."""
_CUES = (
    ("call", re.compile(r"\b(?:call|phone|tel|telephone|mobile|fax|ring|reach|whatsapp|text)\b[^\n]{0,12}$", re.I)),
    ("social", re.compile(r"\b(?:ssn|social security)\b[^\n]{0,14}$", re.I)),
    ("bank", re.compile(r"\b(?:iban|account|bank|transfer)\b[^\n]{0,14}$", re.I)),
    ("mail", re.compile(r"\b(?:e-?mail|mail|write|contact)\b[^\n]{0,14}$", re.I)),
    ("serial", re.compile(r"\b(?:order|invoice|isbn|serial|version|item|ticket|ref|page|part|model|no)\b[^\n]{0,10}$", re.I)),
)
N_FEATURES = len(_SHAPES) + len(_CUES) + 7


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _features(text: str, i: int, j: int) -> np.ndarray:
    """Features of the whole span text[i:j]."""
    s = text[i:j]
    digits = _DIGITS.findall(s)
    before = text[max(0, i - 40) : i]
    edge = (i > 0 and (text[i - 1].isalnum() or text[i - 1] in "+@_")) or (j < len(text) and (text[j].isalnum() or text[j] in "@_"))
    f = [bool(p.fullmatch(s)) for p in _SHAPE] + [bool(p.search(before)) for _, p in _CUES]
    f += [1, edge, 9 <= len(digits) <= 15, 13 <= len(digits) <= 19 and luhn("".join(digits)), _iban(s), len(set(digits)) <= 1 < len(digits), i > 0 and text[i - 1] in "$€£#.-/:"]
    return np.array(f, float)


def _regions(text: str) -> list[tuple[int, int]]:
    """Stretches of text around triggers, with some words of context around each; those that touch are one."""
    out: list[list[int]] = []
    for m in _NEAR.finditer(text):
        i, j = m.start(), m.end()
        for _ in range(CONTEXT):
            k = min([x for x in (text.find(" ", j + 1, j + REACH), text.find("\n", j + 1, j + REACH)) if x >= 0], default=-1)
            j = k if k >= 0 else len(text) if len(text) <= j + REACH else j
        if out and j < out[-1][1]:
            j = out[-1][1]  # which is no letter's or digit's place
        while j < len(text) and text[j].isalnum():
            j += 1
        if out and i <= out[-1][1]:  # its context before begins no earlier than the first trigger's
            out[-1][1] = max(out[-1][1], j)
            continue
        for _ in range(CONTEXT):
            low = max(0, i - REACH - 1)
            k = max(text.rfind(" ", low, max(0, i - 1)), text.rfind("\n", low, max(0, i - 1)))
            i = k + 1 if k >= 0 and i - k < REACH else 0 if i < REACH and k < 0 else i
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [(i, j) for i, j in out]


class SemiMarkov:
    """Labels segments of a region: an entity, or one token outside.

    A reading's score is the sum of weights of its entities' whole-span features by label. Only segments that some shape
    describes are candidates; all others weigh nothing. Forward and backward sums over all readings give probabilities.
    """

    def __init__(self, weights: np.ndarray | None = None):
        self.w = np.zeros((len(KINDS), N_FEATURES)) if weights is None else weights

    def candidates(self, text: str, i: int, j: int) -> tuple[list[int], list[tuple[int, int]], np.ndarray]:
        cut = [i, *(i + m.end() for m in _TOKEN.finditer(text[i:j]))]
        if cut[-1] != j:
            cut.append(j)
        segs, feats = [], []
        spelt = any(x in text[i:j] for x in (" at ", "[at]", "(at)"))
        at = {p: b for b, p in enumerate(cut)} if spelt else {}
        for a in range(len(cut) - 1):
            start = cut[a]
            inside = start > 0 and _LOCAL.match(text[start - 1])
            m = at and not inside and _SPELT.match(text, start, j)
            if m and m.end() in at:  # the whole of an address, however long
                segs.append((a, at[m.end()]))
                feats.append(_features(text, start, m.end()))
            shapes = _START.match(text, start, j) and [p for p in _BOUNDED if p.match(text, start, j)]
            for b in range(a + 1, len(cut)) if shapes else ():
                if cut[b] - start > MOST_CHARS:
                    break
                if any(p.fullmatch(text, start, cut[b]) for p in shapes):
                    segs.append((a, b))
                    feats.append(_features(text, start, cut[b]))
        return cut, segs, np.array(feats).reshape(-1, N_FEATURES)

    def marginals(self, n: int, segs: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
        """Probability of each segment under each label, of n tokens."""
        fore, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        fore[0] = back[n] = 0
        ends: dict[int, list[int]] = {}
        starts: dict[int, list[int]] = {}
        for k, (a, b) in enumerate(segs):
            ends.setdefault(b, []).append(k)
            starts.setdefault(a, []).append(k)
        whole = np.logaddexp.reduce(scores, axis=1) if len(segs) else np.zeros(0)
        for p in range(1, n + 1):
            fore[p] = np.logaddexp.reduce([fore[p - 1], *(fore[segs[k][0]] + whole[k] for k in ends.get(p, ()))])
        for p in range(n - 1, -1, -1):
            back[p] = np.logaddexp.reduce([back[p + 1], *(back[segs[k][1]] + whole[k] for k in starts.get(p, ()))])
        return np.array([np.exp(fore[a] + scores[k] + back[b] - fore[n]) for k, (a, b) in enumerate(segs)]).reshape(-1, len(KINDS))

    def best(self, n: int, segs: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
        """(segment, label) of the best reading: boundaries and labels chosen together."""
        top, by = np.zeros(n + 1), [None] * (n + 1)
        ends: dict[int, list[int]] = {}
        for k, (_, b) in enumerate(segs):
            ends.setdefault(b, []).append(k)
        for p in range(1, n + 1):
            top[p] = top[p - 1]
            for k in ends.get(p, ()):
                y = int(scores[k].argmax())
                if top[segs[k][0]] + scores[k, y] > top[p]:
                    top[p], by[p] = top[segs[k][0]] + scores[k, y], (k, y)
        out, p = [], n
        while p:
            if by[p]:
                out.append(by[p])
                p = segs[by[p][0]][0]
            else:
                p -= 1
        return out[::-1]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        out = []
        for i, j in _regions(text):
            cut, segs, feats = self.candidates(text, i, j)
            if not segs:
                continue
            scores = feats @ self.w.T
            sure = self.marginals(len(cut) - 1, segs, scores)
            out += [(KINDS[y], cut[segs[k][0]], cut[segs[k][1]]) for k, y in self.best(len(cut) - 1, segs, scores) if sure[k, y] >= MARGIN]
        return out

    def fit(self, data: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 120, rate: float = 1.0, prior: float = 0.0001) -> SemiMarkov:
        """Ascend the conditional likelihood of labelled texts, with AdaGrad."""
        known = []
        for text, gold in data:
            cut, segs, feats = self.candidates(text, 0, len(text))
            at = {(cut[a], cut[b]): k for k, (a, b) in enumerate(segs)}
            want = np.zeros((len(segs), len(KINDS)))
            for kind, i, j in gold:
                if (i, j) in at:
                    want[at[i, j], KINDS.index(kind)] = 1
            if segs:
                known.append((len(cut) - 1, segs, feats, want))
        past = np.full_like(self.w, 1e-6)
        for _ in range(rounds):
            step = np.zeros_like(self.w)
            for n, segs, feats, want in known:
                step += (want - self.marginals(n, segs, feats @ self.w.T)).T @ feats
            step = step / max(1, len(known)) - prior * self.w
            past += step**2
            self.w += rate * step / np.sqrt(past)
        return self


def examples(n: int = TRAINED_ON, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled sentences made by rule: entities in their usual settings, and look-alikes that aren't any."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("ta", "re", "lo", "min", "ser", "and", "vo")) for _ in range(r.randint(1, 4)))

    def account() -> str:
        body = num(r.choice((14, 16, 18)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        s = f"DE{check:02d}{body}"
        return s if r.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    made = {
        "email": lambda: f"{word()}{r.choice(('.', ''))}{num(r.randint(0, 2))} {r.choice(('at', '[at]', '(at)'))} {word()} {r.choice(('dot', '[dot]', '(dot)'))} com",
        "phone": lambda: r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(4)} {num(4)}")),
        "ssn": lambda: f"{num(3)}-{num(2)}-{num(4)}",
        "iban": account,
    }
    cue = {"email": ("mail", "write to", "contact"), "phone": ("call", "phone:", "tel", "reach us on"), "ssn": ("ssn", "social security number", "SSN:"), "iban": ("IBAN", "account", "transfer to")}
    plain = (
        lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: num(r.randint(1, 12)), lambda: f"{num(1)}.{num(2)}.{num(1)}", lambda: f"${num(3)}.{num(2)}",
        lambda: f"order {num(3)}-{num(3)}-{num(4)}", lambda: f"isbn {num(3)}-{num(2)}-{num(4)}", lambda: f"part {num(3)}-{num(2)}-{num(4)}",
        lambda: f"meet at {word()} dot {word()}", lambda: f"{num(3)}-{num(2)}-{num(4)}-{num(3)}", lambda: f"AB{num(2)} {num(4)} {num(4)}", lambda: f"serial {num(3)}.{num(3)}.{num(4)}",
    )
    out = []
    for k in range(n):
        head, tail = " ".join(word() for _ in range(r.randint(2, 4))), " ".join(word() for _ in range(r.randint(1, 3)))
        if k % 2:
            out.append((f"{head} {r.choice(plain)()} {tail}", []))
        else:
            kind = r.choice(tuple(made))
            s = made[kind]()
            lead = f"{head} {r.choice(cue[kind])} "
            out.append((f"{lead}{s} {tail}", [(kind, len(lead), len(lead) + len(s))]))
    return out


def bare(n: int = 24, seed: int = 6) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled sentences of addresses in brackets without a word that announces them."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice(("ta", "re", "lo", "min", "ser", "and", "vo")) for _ in range(r.randint(1, 4)))
    for _ in range(n):
        at, dot = r.choice((("[at]", "[dot]"), ("(at)", "(dot)")))
        lead, s = r.choice(("", f"{word()} ", f"{r.randint(1, 99)} ")), f"{word()}{r.choice(('', r.randint(0, 99)))} {at} {word()} {dot} com"
        out.append((f"{lead}{s}{r.choice(('', f' {word()}'))}", [("email", len(lead), len(lead) + len(s))]))
    return out


@lru_cache(1)
def trained() -> np.ndarray:
    return SemiMarkov().fit(examples() + bare()).w


def find(text: str, field: SemiMarkov) -> tuple[list, list]:
    """Base spans, and all spans by kind and start: the field's are added where they touch no base span or one another."""
    base = base_spans(text)
    ends: list[int] = []
    begins: list[int] = []
    for i, j in sorted((i, j) for _, i, j in base):  # stretches that base spans cover
        if ends and i < ends[-1]:
            ends[-1] = max(ends[-1], j)
        else:
            begins.append(i)
            ends.append(j)
    added = []
    for kind, i, j in field.spans(text):
        k = bisect_right(ends, i)
        if k == len(begins) or begins[k] >= j:
            added.append((kind, i, j))
    order = {k: n for n, k in enumerate(KINDS)}
    return base, sorted([*base, *added], key=lambda s: (order[s[0]], s[1], s[2]))


class _Find:
    def __init__(self, weights):
        self.weights = weights

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = SemiMarkov(self.weights)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            both = [find(x.as_py() or "", field) if (x.as_py() or "") else ([], []) for x in b.column("text")]
            shown = [[[{"kind": k, "start": i, "end": j} for k, i, j in x[side]] for x in both] for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(s, kind) for s in shown)], names=["doc_id", "base", "spans"])


def find_personal_data(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and spans, arrays of (kind, start, end) in code points, ends exclusive.

    base has the patterns' matches, spans also what the field adds. Every text is read whole, in one stage without a
    shuffle, in time in proportion to its length; the field looks at stretches around digits and spelt-out addresses.

    Null or empty text: no spans. Null doc_id and repeated rows: kept. Of spans that overlap, base ones all stay and added
    ones are left out. Empty table: no rows. Other columns are ignored.
    """
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    span = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(_Find(trained()), f"doc_id long, base {span}, spans {span}")
