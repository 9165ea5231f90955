"""Personal data: exact base rules, and boosted trees over generated candidates.

Base spans follow fixed rules and always stay. Beyond them, generators with high recall propose
overlapping spans (numbers in any grouping, dotted quads, hexadecimal addresses, plain and spelt-out
mail addresses); gradient-boosted trees score them by format and context, and a threshold per kind,
calibrated on held-out texts, selects. No labels exist, so the trees learn from what the base
rules find: positives are base spans and the same data written in other ways, negatives are
candidates without a base span and base spans spoilt so that they break a rule. :func:`fit` learns
from the examples of three quarters of all texts and calibrates on those of the others, both by sums
that Spark adds up; :func:`train` does it at hand, for a few texts.

All patterns run in time linear in the text; positions are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import beside, slices, stored
from isobar.operators import boosting

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
Span = tuple[int, int, int]  # kind, start, end

# Precision that a threshold must reach, and the steps between 0 and 1 of thresholds from counts.
PRECISION = 0.98
STEPS = 10_000
TREES = 60
# Examples that a task of the fit holds, about.
BLOCK_ROWS = 1 << 19

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS_DATA = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _mails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield EMAIL, start, end
        at = text.find("@", max(at + 1, end))


def _quads(text: str) -> Iterator[tuple[int, int, list[str]]]:
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts, at = chain[0].split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            quad = parts[k:k + 4]
            size = sum(map(len, quad)) + 3
            yield at, at + size, quad
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed rules, by kind and then by start."""
    if not _HAS_DATA.search(text):
        return []
    spans = list(_mails(text))
    spans += [(IP, a, b) for a, b, quad in _quads(text)
              if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in quad))]
    for m in _CARD.finditer(text):
        digits = _only_digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((CARD, *m.span()))
    spans += [(PHONE, *m.span()) for m in _PHONE.finditer(text)
              if 9 <= len(_only_digits(m[0])) <= 15]
    return spans


# Generators. Counts are bounded, so every start costs a bounded number of steps.
_NUMBER = re.compile(r"(?<![0-9])\+?\(?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,18}(?![0-9])")
_HEX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_SPELT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?"
    r"[A-Za-z0-9-]{1,64}(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{1,32}){1,4}")
_CUES = (
    re.compile(r"(?i)mail|contact|write"), re.compile(r"(?i)\bip\b|host|server|address"),
    re.compile(r"(?i)card|visa|credit|pay"), re.compile(r"(?i)phone|tel|call|mobile|fax"),
)


def candidates(text: str) -> list[Span]:
    """Proposed spans of any kind; they may overlap."""
    out = list(_mails(text)) if "@" in text else []
    if "dot" in text:
        out += [(EMAIL, *m.span()) for m in _SPELT.finditer(text)]
    if not _HAS_DATA.search(text):
        return out
    out += [(IP, a, b) for a, b, _ in _quads(text)]
    if ":" in text:
        out += [(IP, *m.span()) for m in _HEX.finditer(text)]
    for m in _NUMBER.finditer(text):
        out += [(CARD, *m.span()), (PHONE, *m.span())]
    return out


FEATURES = ("email ip card phone digits length separators separator_kinds longest_run groups first "
            "last luhn plus bracket dots largest_part letters domain_letters at prev_alnum "
            "next_alnum prev_symbol cue spelt").split()


def features(kind: int, span: str, before: str, after: str) -> list[float]:
    """Format of a span and its context, of at most 24 characters on either side."""
    digits = _only_digits(span)
    marks = [c for c in span if not c.isalnum()]
    runs = re.findall("[0-9]+", span) or [""]
    tail = re.split(r"[^A-Za-z]+", span)[-1]
    return [*(float(kind == k) for k in range(4)), len(digits), len(span), len(marks),
            len(set(marks)), max(map(len, runs)), len(runs), len(runs[0]), len(runs[-1]),
            float(12 < len(digits) < 20 and luhn(digits)), float(span.startswith("+")),
            float("(" in span), span.count("."), min(max(int(r[-6:] or 0) for r in runs), 9_999),
            sum(c.isalpha() for c in span) / max(len(span), 1), len(tail), span.count("@"),
            float(before[-1:].isalnum()), float(after[:1].isalnum()),
            float(before[-1:] in tuple("$€#.-/=")), float(bool(_CUES[kind].search(before))),
            float(kind == EMAIL and "@" not in span)]


def _rewritten(kind: int, span: str) -> list[str]:
    """The same data in other spellings, which the base rules miss."""
    if kind == EMAIL:
        name, _, host = span.partition("@")
        return [f"{name} at {host.replace('.', ' dot ')}", f"{name}[at]{host.replace('.', '[dot]')}"]
    digits = _only_digits(span)
    if kind == PHONE and len(digits) >= 10:
        n = digits[-10:]
        return [f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}",
                f"{n[:3]}.{n[3:6]}.{n[6:]}"]
    if kind == CARD:
        return [sep.join(digits[k:k + 4] for k in range(0, len(digits), 4)) for sep in "./"]
    return []


def _spoilt(kind: int, span: str) -> list[str]:
    """The span with one rule broken."""
    if kind == EMAIL:
        return [span.partition("@")[0] + "@" + span.rpartition(".")[2]]
    if kind == IP:
        return [".".join(str(int(p) + 256) for p in span.split("."))]
    wrong = span[:-1] + str((int(span[-1]) + 1) % 10)
    return [wrong, wrong[: len(wrong) // 2]] if kind == CARD else [span + span[1:], span[:6]]


@dataclass
class Trees:
    """Boosted trees of fixed depth: per inner node a feature and a cut, per leaf a value."""

    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2,
          least: int = 8) -> Trees:
    """Gradient boosting on log loss with Newton leaves; cuts at 32 quantiles of a feature."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(start=float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33))[:-1]) for j in range(x.shape[1])]
    odds = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        inner = (1 << depth) - 1
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 0.0
            if len(rows) >= 2 * least:
                g, h = grad[rows], hess[rows]
                whole = g.sum() ** 2 / (h.sum() + 1)
                for j, options in enumerate(cuts):
                    left = x[rows, j][:, None] <= options
                    n, gl, hl = left.sum(axis=0), g @ left, h @ left
                    gain = (gl ** 2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole)
                    gain[(n < least) | (len(rows) - n < least)] = 0
                    if len(gain) and gain.max() > best + 1e-12:
                        best, feature[k], cut[k] = gain.max(), j, options[gain.argmax()]
            node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
        at = node - inner
        leaf = rate * (np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + 1))
        odds += leaf[at]
        for store, value in zip((model.feature, model.cut, model.leaf), (feature, cut, leaf)):
            store.append(value)
    return model


@dataclass
class Model:
    trees: Trees
    thresholds: list[float]  # by kind; above 1: no span of the kind is added


def examples(text: str) -> Iterator[tuple[list[float], int]]:
    """Feature rows and weak labels of a text."""
    base = base_spans(text)
    for kind, a, b in base:
        before, after, span = text[max(a - 24, 0):a], text[b:b + 24], text[a:b]
        for form in (span, *_rewritten(kind, span)):
            yield features(kind, form, before, after), 1
        for form in _spoilt(kind, span):
            yield features(kind, form, before, after), 0
        digits = CARD if kind == PHONE else PHONE if kind == CARD else None
        if digits is not None:
            yield features(digits, span, before, after), 0
    for kind, a, b in candidates(text):
        if all(b <= s or e <= a for _, s, e in base):
            yield features(kind, text[a:b], text[max(a - 24, 0):a], text[b:b + 24]), 0


def train(texts: Sequence[str | None], seed: int = 6, precision: float = PRECISION) -> Model | None:
    """Trees and thresholds from a sample; None if it shows only one class."""
    pairs = [p for text in texts if text for p in examples(text)]
    y = np.array([label for _, label in pairs], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([row for row, _ in pairs], dtype=np.float64)
    held = np.random.default_rng(seed).random(len(y)) < 0.25
    model = boost(x[~held], y[~held])
    p, y, kind = 1 / (1 + np.exp(-model.odds(x[held]))), y[held], x[held][:, :4].argmax(axis=1)
    thresholds = []
    for k in range(4):
        mine = kind == k
        order = np.argsort(-p[mine], kind="stable")
        hits = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero((hits >= precision) & (p[mine][order] >= 0.5))
        thresholds.append(float(p[mine][order][good[-1]]) if len(good) >= 20 else 2.0)
    return Model(model, thresholds)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*FEATURES, "label", "held"]
    for batch in batches:
        texts = batch.column("text")
        for at, n in slices(texts, 1 << 20):
            held = batch.column("held").slice(at, n).to_pylist()
            rows = [(*x, y, h) for text, h in zip(texts.slice(at, n).to_pylist(), held)
                    for x, y in examples(text)]
            columns = zip(*rows) if rows else ((),) * len(names)
            kinds = [*[pa.float64()] * len(FEATURES), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(v) for v in c] if pa.types.is_float64(k) else list(c), k)
                 for c, k in zip(columns, kinds)], names)


def _as_trees(model: boosting.Boosted, depth: int) -> Trees:
    """The boosted trees with cuts in place of bins, nodes that end early with one value below."""
    out, inner = Trees(), (1 << depth) - 1
    for (tree,) in model.rounds:
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        leaf = np.zeros(inner + 1)
        at = {0: 0}  # nodes of this level, and their places among all nodes
        for d, level in enumerate(tree):
            below = {}
            for node, place in at.items():
                if level.feature[node] < 0:  # all below go to the left
                    width = 1 << depth - d
                    first = (place + 1) * width - (inner + 1)
                    leaf[first:first + width] = level.value[node]
                else:
                    feature[place] = level.feature[node]
                    cut[place] = model.cuts[level.feature[node]][level.bin[node] - 1]
                    for side in (0, 1):
                        below[int(level.child[node]) + side] = 2 * place + 1 + side
            at = below
        for store, value in zip((out.feature, out.cut, out.leaf), (feature, cut, leaf)):
            store.append(value)
    return out


def _thresholds(held: DataFrame, trees: Trees, precision: float) -> list[float]:
    """Per kind the lowest step at which the precision of all examples from there on suffices."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in FEATURES])
            p = 1 / (1 + np.exp(-trees.odds(x)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[:, :4].argmax(axis=1)), pa.array((p * STEPS).astype(np.int64)),
                 batch.column("label")], ["kind", "step", "label"])

    counted = (held.select(*FEATURES, "label").mapInArrow(score, "kind bigint, step bigint, label int")
               .filter(F.col("step") >= STEPS // 2).groupBy("kind", "step")
               .agg(F.count("*").alias("n"), F.sum("label").alias("hits")).toArrow())
    kind, step, n, hits = (counted.column(c).to_numpy() for c in ("kind", "step", "n", "hits"))
    out = []
    for k in range(4):
        mine = np.flatnonzero(kind == k)
        mine = mine[np.argsort(-step[mine])]
        seen = np.cumsum(n[mine])
        good = np.flatnonzero((np.cumsum(hits[mine]) >= precision * seen) & (seen >= 20))
        out.append(float(step[mine][good[-1]] / STEPS) if len(good) else 2.0)
    return out


def fit(docs: DataFrame, text_col: str = "text", seed: int = 6,
        precision: float = PRECISION) -> Model | None:
    """A model from the examples of all texts; None if they show only one class.

    A hash of the text holds every fourth text out for the thresholds. The trees come from sums over
    all other examples, the thresholds from counts over all that are held out; only these sums and
    counts reach the driver.
    """
    text = F.col(text_col)
    found = docs.filter(text.rlike("[0-9@]|dot")).select(
        text.alias("text"), (F.pmod(F.xxhash64(F.lit(seed), text), F.lit(4)) == 0).alias("held"))
    rows = stored(found.mapInArrow(_examples, ", ".join(f"{c} double" for c in FEATURES)
                                   + ", label int, held boolean"), "examples")
    learned = rows.filter(~F.col("held"))
    if learned.select("label").distinct().count() < 2:
        return None
    settings = boosting.Settings(n_estimators=TREES, max_depth=3, learning_rate=0.2,
                                 min_child_weight=2.0, bins=33, random_state=seed)
    trees = _as_trees(boosting.fit(learned.select(*FEATURES, "label"), FEATURES, settings,
                                   block_rows=BLOCK_ROWS), settings.max_depth)
    return Model(trees, _thresholds(rows.filter("held"), trees, precision))


def added_spans(text: str, base: Sequence[Span], model: Model | None) -> list[Span]:
    """Selected candidates that overlap no base span and no better candidate."""
    open_ = [c for c in candidates(text) if all(c[2] <= s or e <= c[1] for _, s, e in base)]
    if model is None or not open_:
        return []
    x = np.array([features(k, text[a:b], text[max(a - 24, 0):a], text[b:b + 24])
                  for k, a, b in open_], dtype=np.float64)
    p = 1 / (1 + np.exp(-model.trees.odds(x)))
    out: list[Span] = []
    for i in sorted(range(len(open_)), key=lambda i: (-p[i], open_[i])):
        kind, a, b = open_[i]
        if p[i] >= model.thresholds[kind] and all(b <= s or e <= a for _, s, e in out):
            out.append(open_[i])
    return out


def _listed(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, model: Model | None, text_col: str = "text",
         keep: Sequence[str] | None = None, redact: bool = True) -> DataFrame:
    """``docs`` in a struct ``doc`` with the number of base spans per kind, ``base_sha256``,
    ``spans`` (all, listed as ``kind:start:end``) and ``redacted``, the text with tags for spans
    (null unless ``redact``).

    Null texts count as empty, and stay null in ``redacted``. Rows are searched alone, so copies
    agree; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_of(batch)
            for at, n in slices(texts):
                rows = []
                for text in texts.slice(at, n).to_pylist():
                    base = base_spans(text or "")
                    spans = [*base, *added_spans(text or "", base, sent.value)]
                    rows.append(([sum(k == kind for k, _, _ in base) for kind in range(4)],
                                 hashlib.sha256(_listed(base).encode()).hexdigest(),
                                 _listed(spans), _redacted(text, spans) if redact else None))
                counts = np.array([r[0] for r in rows], dtype=np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(at, n), *(pa.array(counts[:, k]) for k in range(4)),
                     *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3))],
                    ["doc", *names, "base_sha256", "spans", "redacted"])

    rows, text_of, kind = beside(docs, text_col, keep)
    return rows.mapInArrow(run, f"doc {kind}, " + "".join(f"{c} bigint, " for c in names)
                           + "base_sha256 string, spans string, redacted string")


def _redacted(text: str | None, spans: Sequence[Span]) -> str | None:
    if not text or not spans:
        return text
    out, end = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if b > end:
            out += [text[end:max(a, end)], f"[{KINDS[k]}]"]
            end = b
    return "".join(out) + text[end:]
