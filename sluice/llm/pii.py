"""Personal data: exact patterns, and a skip-chain conditional random field beside them.

Base spans come from four fixed patterns with their checks.  The field labels the
tokens that hold a digit or ``@`` (all others are O by construction) as O, email, ip,
card or phone.  Neighbouring tokens share chain potentials; tokens of one document
that repeat, or are similar (same digits, same local part or host), share skip
potentials however far apart they are, each linked to the previous one of its kind,
so edges grow with the tokens.  Tokens inside base spans are evidence.  Loopy
message passing then yields one belief per token, and runs of tokens with the same
label that pass the kind's own check become added spans: numbers whose neighbours made
a pattern swallow too much, and repeats or variants of what was found elsewhere.

Weights are trained here, by gradient ascent on the pseudo-likelihood of the base
labels, on a bounded sample of documents (``SAMPLE_DOCS``, drawn by a hash of doc_id);
tokens that a pattern matched but its check refused are left out of the training.

Documents are independent: one Arrow pass, nothing is shuffled; a task holds a batch.

Defined cases: NULL text is empty; texts without digits or ``@`` have no spans; runs
of thousands of digits or letters are scanned in linear time; repeated rows give equal
results; an empty table, or one without any base span, leaves the weights untrained and
only base spans are returned; further columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is O

SAMPLE_DOCS = 3000
# Rows with equal doc_id fall into the sample together; never take more than this.
MOST_SAMPLE_DOCS = 6000
STEPS = 300
ROUNDS = 12
CLAMP = 12.0
SURE = 0.5

_HINT = re.compile(r"[0-9@]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits starts: no rescans of long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'<>[]{}|"


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def ip_ok(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(
        # int() refuses thousands of digits, leading zeros included.
        p and all("0" <= c <= "9" for c in p) and len(p.lstrip("0")) <= 3
        and int(p.lstrip("0") or "0") <= 255 for p in parts)


def card_ok(text: str) -> bool:
    digits = digits_of(text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def phone_ok(text: str) -> bool:
    return 10 <= len(digits_of(text)) <= 15


def _emails(text: str):
    """Leftmost matches: each ``@`` looks back over local characters, but not into the
    previous match, and forward for a host."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        free = host.end() if host else at + 1
        if host:
            yield start, free
        at = text.find("@", free)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind number, end) of what passes, by start then kind; spans that failed."""
    if not _HINT.search(text):
        return [], []
    found = [(a, 0, b) for a, b in _emails(text)]
    failed = []
    for kind, pattern, check in ((1, _IP, ip_ok), (2, _CARD, card_ok), (3, _PHONE, phone_ok)):
        for m in pattern.finditer(text):
            if check(m.group()):
                found.append((m.start(), kind, m.end()))
            elif kind != 2 or len(digits_of(m.group())) >= 7:
                failed.append(m.span())
    return sorted(found), failed


def as_text(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
        s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    """Number of spans of one kind."""
    # A second parameter of the function would be the span's place, default or not.
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


# -- the field ---------------------------------------------------------------

def tokens_of(text: str) -> list[tuple[int, int]]:
    """Spans of tokens with a digit or ``@``, punctuation trimmed at both ends."""
    if not _HINT.search(text):
        return []
    out = []
    for m in _TOKEN.finditer(text):
        word = m.group()
        if _HINT.search(word):
            start = m.start() + len(word) - len(word.lstrip(_EDGE))
            out.append((start, start + len(word.strip(_EDGE))))
    return out


def features(token: str, before: str, after: str) -> list[int]:
    """Indices of the features that hold for a token."""
    digits = digits_of(token)
    n = len(digits)
    letters = sum(c.isalpha() for c in token)
    bucket = 0 if n == 0 else 1 if n <= 3 else 2 if n <= 6 else 3 if n <= 9 else (
        4 if n <= 13 else 5 if n <= 19 else 6)
    at = token.partition("@")
    host_dots = at[2].count(".")
    return [i for i, on in enumerate((
        True, bool(at[1]) and bool(at[0]) and bool(at[2]), bool(at[1]) and host_dots > 0,
        bool(at[1]) and host_dots == 0, *(bucket == b for b in range(7)),
        n == len(token), token.startswith("+"), "(" in token and ")" in token, "-" in token,
        token.count(".") == 3, ip_ok(token), 14 <= n <= 19 and letters == 0 and luhn(digits),
        letters > 0 and not at[1], letters > n, before.startswith("+"), "(" in before,
        bool(re.search(r"[0-9]", before)), bool(re.search(r"[0-9]", after)), "(" in after,
        n <= 4 and letters == 0, "=" in token or "/" in token)) if on]


N_FEATURES = 31


def similar_keys(token: str) -> list[str]:
    keys = [f"t{token.lower()}"]
    digits = digits_of(token)
    if len(digits) >= 6:
        keys.append(f"d{digits}")
    if "@" in token:
        local, _, host = token.lower().partition("@")
        keys += [f"l{local}", f"h{host}"]
    return keys


class Graph:
    """Tokens of many documents as one graph; documents share no edge."""

    def __init__(self, texts: list[str]):
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.base: list[list[tuple[int, int, int]]] = []
        self.doubtful: list[bool] = []
        rows, chain, skip, given = [], [], [], []
        for doc, text in enumerate(texts):
            base, failed = base_spans(text)
            self.base.append(base)
            spans = tokens_of(text)
            words = [text[a:b] for a, b in spans]
            last: dict[str, int] = {}
            first = len(self.spans)
            next_base = next_failed = 0
            failed.sort()
            reach = -1
            for i, (a, b) in enumerate(spans):
                node = first + i
                near = i > 0 and not text[spans[i - 1][1]:a].strip(" " + _EDGE)
                follows = i + 1 < len(spans) and not text[b:spans[i + 1][0]].strip(" " + _EDGE)
                rows.append(features(words[i], words[i - 1] if near else "",
                                     words[i + 1] if follows else ""))
                if near:
                    chain.append((node - 1, node))
                for key in similar_keys(words[i]):
                    if key in last and (not skip or skip[-1] != (last[key], node)):
                        skip.append((last[key], node))
                    last[key] = node
                while next_base < len(base) and base[next_base][2] <= a:
                    next_base += 1
                label = next((k + 1 for s, k, e in base[next_base:next_base + 4]
                              if s < b and e > a), 0)
                while next_failed < len(failed) and failed[next_failed][0] < b:
                    reach = max(reach, failed[next_failed][1])
                    next_failed += 1
                given.append(label)
                self.doubtful.append(label == 0 and reach > a)
                self.spans.append((doc, a, b))
        n = len(self.spans)
        self.x = np.zeros((n, N_FEATURES), np.float64)
        for i, row in enumerate(rows):
            self.x[i, row] = 1.0
        self.given = np.array(given, np.int64)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)


class Field:
    """Weights: unary (feature, label), chain (label, label), skip (agreement by label)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    @staticmethod
    def train(graph: Graph, steps: int = STEPS, rate: float = 0.5,
              decay: float = 1e-4) -> Field | None:
        """Gradient ascent on the pseudo-likelihood of the given labels."""
        use = np.flatnonzero(~np.array(graph.doubtful, bool))
        if not len(use) or not graph.given.any():
            return None
        y = np.eye(LABELS)[graph.given]
        left, right, agree = (np.zeros_like(y) for _ in range(3))
        np.add.at(left, graph.chain[:, 1], y[graph.chain[:, 0]])
        np.add.at(right, graph.chain[:, 0], y[graph.chain[:, 1]])
        np.add.at(agree, graph.skip[:, 1], y[graph.skip[:, 0]])
        np.add.at(agree, graph.skip[:, 0], y[graph.skip[:, 1]])
        agree = np.minimum(agree, 4.0)
        x, t, left, right, agree = graph.x[use], y[use], left[use], right[use], agree[use]
        unary, chain = np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS))
        skip = np.zeros(LABELS)
        # Rare labels count as much as frequent ones.
        weight = (1.0 / np.maximum(t.sum(0), 1.0))[graph.given[use]]
        weight = (weight / weight.sum())[:, None]
        for _ in range(steps):
            score = x @ unary + left @ chain + right @ chain.T + agree * skip
            score -= score.max(1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(1, keepdims=True)
            error = (t - p) * weight
            unary += rate * 20 * (x.T @ error - decay * unary)
            chain += rate * 20 * (left.T @ error + (right.T @ error).T - decay * chain)
            skip += rate * 20 * ((agree * error).sum(0) - decay * skip)
        return Field(unary, chain, np.maximum(skip, 0.0))

    def beliefs(self, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Label probabilities per token, by loopy message passing; base labels are given."""
        local = graph.x @ self.unary
        fixed = graph.given > 0
        local[fixed] = 0.0
        local[fixed, graph.given[fixed]] = CLAMP
        ends = np.concatenate((graph.chain, graph.skip))
        if len(ends):
            agree = np.diag(self.skip)
            forward = np.concatenate((np.repeat(self.chain[None], len(graph.chain), 0),
                                      np.repeat(agree[None], len(graph.skip), 0)))
            source = np.concatenate((ends[:, 0], ends[:, 1]))
            target = np.concatenate((ends[:, 1], ends[:, 0]))
            pair = np.concatenate((forward, forward.transpose(0, 2, 1)))
            back = np.concatenate((np.arange(len(ends)) + len(ends), np.arange(len(ends))))
            message = np.zeros((2 * len(ends), LABELS))
            for _ in range(rounds):
                total = local.copy()
                np.add.at(total, target, message)
                out = (total[source] - message[back])[:, :, None] + pair
                top = out.max(1, keepdims=True)
                new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                new -= new.max(1, keepdims=True)
                message = 0.5 * message + 0.5 * new
            np.add.at(local, target, message)
        local -= local.max(1, keepdims=True)
        p = np.exp(local)
        return p / p.sum(1, keepdims=True)


def _email_ok(text: str) -> bool:
    local, _, host = text.partition("@")
    return bool(local) and set(local) <= _LOCAL and bool(re.fullmatch(r"[A-Za-z0-9.-]+", host))


CHECKS = (_email_ok, ip_ok, card_ok, phone_ok)


def all_spans(texts: list[str], field: Field | None) -> list[tuple[list, list]]:
    """Per text: base spans and added spans."""
    graph = Graph(texts)
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if field is not None and graph.spans:
        p = field.beliefs(graph)
        label = p.argmax(1)
        label[p.max(1) < SURE] = 0
        label[graph.given > 0] = 0
        joined = set(map(tuple, graph.chain.tolist()))
        i = 0
        while i < len(label):
            if not label[i]:
                i += 1
                continue
            kind, j = label[i] - 1, i + 1
            text = texts[graph.spans[i][0]]
            # A phone number may span tokens; a plus sign starts another.
            while (kind == 3 and j < len(label) and label[j] == label[i]
                   and (j - 1, j) in joined and text[graph.spans[j][1]] != "+"):
                j += 1
            doc, start, _ = graph.spans[i]
            end = graph.spans[j - 1][2]
            clear = all(e <= start or s >= end for s, _, e in graph.base[doc])
            if clear and CHECKS[kind](text[start:end]):
                added[doc].append((start, int(kind), end))
            i = j
    return list(zip(graph.base, added, strict=True))


def train(docs: DataFrame, most: int = SAMPLE_DOCS) -> Field | None:
    """A field trained on about ``most`` documents that hold a digit or ``@``."""
    hinted = docs.filter(F.col("text").rlike("[0-9@]"))
    count = hinted.count()
    if not count:
        return None
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30))
    sample = (hinted.filter(place < int((1 << 30) * min(1.0, most / count)))
              .orderBy(place, F.xxhash64("text")).select("doc_id", "text").limit(MOST_SAMPLE_DOCS))
    # What leaves the tasks is bounded: only the surroundings of tokens.
    rows = sample.select(F.pandas_udf(_surroundings, "string")(F.col("text")).alias("t"))
    return Field.train(Graph(sorted(r["t"] for r in rows.toLocalIterator())))


def _surroundings(texts: pd.Series) -> pd.Series:
    """The stretches of a text around its tokens, joined, at most 20 kB of them."""
    out = []
    for text in texts:
        spans = tokens_of(text or "")
        parts = [(text or "")[max(0, a - 40):b + 40] for a, b in spans[:200]]
        out.append("\n".join(parts)[:20_000])
    return pd.Series(out, dtype=object)


def find(text: Column, field: Field | None) -> Column:
    """A struct: base and added spans as arrays of (start, kind, end)."""
    def scan(texts: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        rows = [([dict(zip(("start", "kind", "end"), s, strict=True)) for s in base],
                 [dict(zip(("start", "kind", "end"), s, strict=True)) for s in added])
                for base, added in all_spans(texts, field)]
        return pd.DataFrame(rows, columns=["base", "added"])
    span = "array<struct<start:int,kind:int,end:int>>"
    return F.pandas_udf(scan, f"base {span}, added {span}")(text)

