"""Personal data by candidates and boosted trees.

Four strict patterns give the base spans, which always stay. High-recall generators then propose
further, overlapping spans: addresses written around, phone numbers without a plus, numbers that a base
match swallowed whole, and every run of digits. Boosted trees judge each proposal from its
format and its surroundings; one threshold for each kind, set on rows that the trees have not
seen, decides. They learn from base spans of a bounded sample, which are also
rewritten the way people disguise them, against the sample's other proposals. A chosen span
never overlaps a base span of its kind.

Results by case: a null or empty text has no span; equal rows get equal results; among overlapping
proposals of a kind the likelier one wins, then the earlier, then the longer; an empty table
gives an empty result; without base spans in the sample nothing is added. Columns other than
id and text are not read. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Rows whose base spans and proposals the trees learn from: the first by a hash of the id.
FIT_ROWS = 4000
#: Of the proposals a threshold lets through, at least this share must be right on held-out rows.
PRECISION = 0.995

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _octets_fit(text: str) -> bool:
    return all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """The strict patterns' spans, by kind, then start. Every scan is linear in the text."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:  # the local part ends at this sign, and starts where the run of its letters does
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets_fit(m[0])]
    found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


_AT, _DOT = r"\s?(?:\(at\)|\[at\]|\{at\}|@|\sat\s)\s?", r"\s?(?:\(dot\)|\[dot\]|\{dot\}|\.|\sdot\s)\s?"
_WRITTEN = re.compile(rf"(?<![\w.+-])[\w.+-]{{1,64}}{_AT}[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}}){{1,5}}", re.I)
_HINT = re.compile(r"[(\[{](?:at|dot)[)\]}]|\sdot\s", re.I)
_RUN = re.compile(r"[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9])*")
_SPACES = re.compile(r"[^\x20]+")


def proposals(text: str, bases: list[Span]) -> list[Span]:
    """Everything that might be personal data: overlapping, and mostly not."""
    out: set[Span] = set()
    reach = 0
    for hint in _HINT.finditer(text):
        if hint.start() >= reach:
            reach = hint.end() + 200
            low = max(0, hint.start() - 200)
            out.update(("email", low + m.start(), low + m.end()) for m in _WRITTEN.finditer(text[low : reach + 200]) if low + m.start() <= reach)
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        pieces = [(m.start(), m.end())]
        if " " in m[0]:
            pieces += [(m.start() + p.start(), m.start() + p.end()) for p in _SPACES.finditer(m[0])]
        for start, end in pieces:
            n = len(_digits(text[start:end]))
            if 13 <= n <= 19:
                out.add(("card", start, end))
            if 7 <= n <= 15:
                out.add(("phone", start, end))
            if text.count(".", start, end) == 3 and 4 <= n <= 12:
                out.add(("ip", start, end))
    by_kind: dict[str, list[tuple[int, int]]] = {k: sorted((s, e) for kind, s, e in bases if kind == k) for k in KINDS}
    starts = {k: np.array([s for s, _ in v], np.int64) for k, v in by_kind.items()}

    def free(span: Span) -> bool:
        own, at = by_kind[span[0]], int(np.searchsorted(starts[span[0]], span[2])) - 1
        return at < 0 or own[at][1] <= span[1]

    return sorted(s for s in out if free(s))


#: Words next to a span that hint at a kind, and at something else. Fixed values.
CUES = ("mail", "contact", "write", "tel", "phone", "call", "fax", "mobile", "card", "visa", "credit", "ip", "host", "server")
COUNTER_CUES = ("token", "version", "isbn", "order", "id", "serial", "license", "hash", "key", "page", "sku")
FEATURES = 22


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    own, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    digits = _digits(own)
    groups = re.findall("[0-9]+", own)
    word = (re.findall(r"\w+", before) or [""])[-1].lower()
    return [
        float(KINDS.index(kind)), float(len(own)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(own[:1] == "+"), float("(" in own), float(own.count(" ")), float(own.count("-")), float(own.count(".")), float(own.count("/")),
        float(bool(digits) and luhn(digits)), float(len(set(digits))), float(all(len(g) <= 3 and int(g) <= 255 for g in groups)), float(digits[:1] in ("4", "5", "3", "6")),
        float(bool(re.search(r"[(\[{]at[)\]}]|\sat\s", own, re.I))), float(bool(re.search(r"[(\[{]dot[)\]}]|\sdot\s", own, re.I))),
        float(any(c in word for c in CUES)), float(word in COUNTER_CUES), float(before[-1:].isalnum() or before[-1:] in ("_", '"')), float(after[:1].isalnum() or after[:1] in ("_", '"')),
    ]


@dataclass
class Forest:
    """Trees of depth ``DEPTH`` on binned features, boosted for the logistic loss."""

    ROUNDS, DEPTH, RATE, BINS, LEAST = 60, 3, 0.25, 32, 4
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += value[node - (2**self.DEPTH - 1)]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        inner = 2**self.DEPTH - 1
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.BINS + 1)[:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)  # bin b: above cut b-1
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        margin = np.full(len(y), self.start)
        for _ in range(self.ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            g, h = y - p, p * (1 - p)
            feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
            for depth in range(self.DEPTH):
                for own in range(2**depth - 1, 2 ** (depth + 1) - 1):
                    rows = np.flatnonzero(node == own)
                    best = (1e-6, 0, np.inf)
                    if len(rows) >= 2 * self.LEAST:
                        total_g, total_h = g[rows].sum(), h[rows].sum()
                        for f, c in enumerate(cuts):
                            left_g, left_h, n = (np.cumsum(np.bincount(binned[rows, f], w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                            gain[(n < self.LEAST) | (len(rows) - n < self.LEAST)] = -1
                            if len(gain) and gain.max() > best[0]:
                                best = (float(gain.max()), f, float(c[gain.argmax()]))
                    feature[own], cut[own] = best[1], best[2]
                deeper = node >= 2**depth - 1
                node = np.where(deeper, 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node]), node)
            leaf = node - inner
            value = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1) * self.RATE
            self.trees.append((feature, cut, value))
            margin += value[leaf]
        return self


@dataclass(frozen=True)
class PiiModel:
    forest: Forest | None = None
    least: tuple[float, ...] = (np.inf,) * len(KINDS)

    def added(self, text: str, bases: list[Span]) -> list[Span]:
        spans = proposals(text, bases) if self.forest else []
        if not spans:
            return []
        margin = self.forest.margin(np.array([features(text, s) for s in spans]))
        taken: list[Span] = []
        for i in sorted(range(len(spans)), key=lambda i: (-margin[i], spans[i][1], -spans[i][2])):
            kind, start, end = spans[i]
            if margin[i] >= self.least[KINDS.index(kind)] and all(k != kind or e <= start or end <= s for k, s, e in taken):
                taken.append(spans[i])
        return taken


def _disguised(text: str, span: Span) -> Iterator[tuple[str, Span]]:
    """The same personal data as it is written to escape the strict patterns."""
    kind, start, end = span
    own = text[start:end]
    if kind == "email":
        name, host = own.split("@", 1)
        for at, dot in ((" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", " (dot) ")):
            new = name + at + host.replace(".", dot)
            yield text[:start] + new + text[end:], (kind, start, start + len(new))
    elif kind == "phone":
        groups = re.findall("[0-9]+", own)
        if len(groups) >= 3:
            for new in (f"({groups[-3]}) {groups[-2]}-{groups[-1]}", f"{groups[-3]}-{groups[-2]}-{groups[-1]}", f"00{groups[0]} {' '.join(groups[1:])}"):
                yield text[:start] + new + text[end:], (kind, start, start + len(new))
    elif kind == "card":
        d = _digits(own)
        for new in (".".join(d[i : i + 4] for i in range(0, len(d), 4)), "  ".join(d[i : i + 4] for i in range(0, len(d), 4))):
            yield text[:start] + new + text[end:], (kind, start, start + len(new))
        yield text[:start] + own + " " + d[::-1] + text[end:], (kind, start, end)


def fit_pii(docs: DataFrame, fit_rows: int = FIT_ROWS) -> PiiModel:
    """Trees and thresholds from at most ``fit_rows`` rows; their ids are chosen before any text is read."""
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit("pii")), F.col("doc_id")]
    chosen = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(*order).limit(fit_rows)
    own = docs.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")  # fit_rows ids at most
    x, y, half = [], [], []
    for i, text in enumerate(dict.fromkeys(r["text"] for r in own.orderBy(*order, "text").limit(fit_rows).collect())):
        bases = base_spans(text)
        for span in proposals(text, bases):
            inside = text[span[1] : span[2]]
            strict = any(s[1] >= 0 for s in base_spans(inside) if s[0] == span[0])
            x.append(features(text, span))
            y.append(float(strict))
            half.append(i % 2)
        for span in bases:
            low = max(0, span[1] - 80)
            near, moved = text[low : span[2] + 80], (span[0], span[1] - low, span[2] - low)
            for new, where in _disguised(near, moved):
                if where in (p := proposals(new, base_spans(new))):
                    for other in p:
                        if other == where or other[0] != where[0]:
                            x.append(features(new, other))
                            y.append(float(other == where))
                            half.append(i % 2)
            if span[0] == "card":  # a number that fails its check digit is no card
                digits = near[moved[1] : moved[2]]
                broken = digits[:-1] + str((int(digits[-1]) + 3) % 10)
                new = near[: moved[1]] + broken + near[moved[2] :]
                x.append(features(new, moved))
                y.append(0.0)
                half.append(i % 2)
    if len(y) < 40 or not 0 < sum(y) < len(y):
        return PiiModel()
    x, y, half = np.array(x), np.array(y), np.array(half)
    if not (half == 0).any() or not (half == 1).any():
        return PiiModel()
    forest = Forest().fit(x[half == 0], y[half == 0])
    margin, right, kind = forest.margin(x[half == 1]), y[half == 1], x[half == 1][:, 0]
    least = []
    for k in range(len(KINDS)):
        m, r = margin[kind == k], right[kind == k]
        order_ = np.argsort(-m, kind="stable")
        share = np.cumsum(r[order_]) / np.arange(1, len(m) + 1)
        below = np.append(m[order_][1:], -np.inf)
        good = np.flatnonzero((share >= PRECISION) & (below < m[order_]))
        least.append(float(max((m[order_][good[-1]] + below[good[-1]]) / 2, 0.0)) if len(good) else np.inf)
    return PiiModel(forest, tuple(least))


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """``doc_id, base`` and ``spans`` (``kind:start:end``, comma-joined, by kind as listed, then start) of every row."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text) if text else []
                base.append(_said(own))
                spans.append(_said(own + model.added(text, own)) if text else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(found, "doc_id long, base string, spans string")


def redact(text: str | None, spans: str) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, named for the first."""
    text, out, end = text or "", [], 0
    for kind, start, stop in sorted(((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)), key=lambda x: (x[1], -x[2])):
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and a SHA-256 of the base spans, beside all spans."""
    each = F.split("base", ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(each, lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


