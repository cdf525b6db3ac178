"""Quality by a generalised additive model with pairwise interactions (shallow boosted trees).

Every feature of a text has a table with a value for each of its bins, and some pairs of features
have one over coarser bins; a text's score is the logistic of their sum. Tables are learned by
boosting in turn: each round fits, for one feature after the other, a tree of at most four leaves on
the gradients by bin, and adds a part of it to that feature's table. Pairs are ranked by what one
cut on both axes gains on what the single features leave, and the best are boosted likewise. One
model is fitted for each fold, stopped where that fold's loss is least; tables add up, so the
average of these models is one model again. Scoring looks up bins and adds.

Features are shares and means over the whole text, read in pieces, so that a very long text needs no
memory beyond its distinct words and lines. A share of nothing (no words, no letters) has a bin of
its own.

Defined cases: null texts count as empty ones, which get a score like others; where there are no
labelled texts the score is 0.5, and where there are fewer than 8, or fewer than 2 of a class, it is
the smoothed share of label 1; a key with several labels counts with its lowest, a repeated training
text once; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample

NAMES = ("log_words", "word_length", "symbols", "upper", "digits", "marks", "worst_symbols", "worst_upper", "repeated_lines", "distinct_words", "top_word", "same_neighbours", "distinct_triples", "line_words", "lone_signs", "ends", "shouts", "other")
BINS, PAIR_BINS, PAIRS, FOLDS, ROUNDS, RATE, LEAST = 32, 8, 10, 4, 250, 0.1, 5
#: Characters of a piece, of a block for the worst shares; triples of a run of words that are compared
PIECE, BLOCK, RUN = 1 << 19, 256, 256
_SPACE, _LOWER, _UPPER, _DIGIT, _MARK, _SYMBOL, _OTHER = range(7)
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """A class for each code point below 65536; those beyond count as the last."""
    global _classes
    if _classes is None:
        of = {"Zs": _SPACE, "Cc": _SPACE, "Lu": _UPPER, "Lt": _UPPER, "Nd": _DIGIT}
        table = np.full(1 << 16, _OTHER, np.uint8)
        for c in range((1 << 16) - 1):
            kind = unicodedata.category(chr(c))
            table[c] = of.get(kind, _LOWER if kind[0] == "L" else _MARK if kind[0] == "P" else _SYMBOL if kind[0] == "S" else _OTHER)
        table[[ord(c) for c in "#*%&$|<>_~^=\\/@{}[]"]] = _SYMBOL
        _classes = table
    return _classes


def _pieces(text: str):
    """The text in pieces that end at white space, where there is some within a piece's length."""
    at = 0
    while len(text) - at > PIECE:
        end = max(text.rfind(" ", at + PIECE // 2, at + PIECE), text.rfind("\n", at + PIECE // 2, at + PIECE)) + 1 or at + PIECE
        yield text[at:end]
        at = end
    yield text[at:]


def features_of(text: str | None) -> list[float]:
    nan = math.nan
    table, kinds = _class_table(), np.zeros(7, np.int64)
    words, lines = Counter(), Counter()
    n = same = triples = distinct = 0
    worst = [nan, nan]
    for piece in _pieces(text or ""):
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        cls = table[np.minimum(code, 65535)]
        kinds += np.bincount(cls, minlength=7)
        starts = np.arange(0, max(len(cls) - BLOCK // 2, 1), BLOCK)
        if len(cls):
            size = np.diff(np.append(starts, len(cls)))
            for j, k in enumerate((_SYMBOL, _UPPER)):
                share = float((np.add.reduceat((cls == k).astype(np.int32), starts) / size).max())
                worst[j] = share if worst[j] != worst[j] else max(worst[j], share)
        own = piece.split()
        words.update(own)
        n += len(own)
        same += sum(map(eq, own, own[1:]))
        triples += max(len(own) - 2, 0)
        for i in range(0, len(own) - 2, RUN):
            w = own[i : i + RUN + 2]
            distinct += len(set(zip(w, w[1:], w[2:], strict=False)))
        lines.update(x for x in piece.split("\n") if x.strip())
    chars, letters, solid = int(kinds.sum()), int(kinds[_LOWER] + kinds[_UPPER]), int(kinds.sum() - kinds[_SPACE])
    n_lines, all_lines = sum(lines.values()), sum(len(x) * k for x, k in lines.items())
    per = lambda a, b: a / b if b else nan
    return [
        math.log1p(n), per(solid, n), per(kinds[_SYMBOL], solid), per(kinds[_UPPER], letters), per(kinds[_DIGIT], solid), per(kinds[_MARK], n), *worst,
        per(all_lines - sum(map(len, lines)), all_lines), per(len(words), n), per(max(words.values(), default=0), n), per(same, n), per(distinct, triples), per(math.log(n) if n else 0.0, 1) - math.log(max(n_lines, 1)) if n else nan,
        per(sum(k for w, k in words.items() if len(w) == 1 and not w.isalnum()), n), per(sum(k for w, k in words.items() if w[-1] in ".!?…。"), n), per(sum(k for w, k in words.items() if w[-1] in "!?"), n), per(kinds[_OTHER], chars),
    ]


def features(texts: list[str | None]) -> np.ndarray:
    return np.array([features_of(t) for t in texts], float).reshape(-1, len(NAMES))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Bounds between distinct values near the quantiles."""
    v = np.sort(x[~np.isnan(x)])
    if not len(v):
        return v
    distinct = np.unique(v)
    middle = (distinct[1:] + distinct[:-1]) / 2
    if len(middle) < bins:
        return middle
    at = np.searchsorted(middle, np.quantile(v, np.arange(1, bins) / bins))
    return middle[np.unique(np.clip(at, 0, len(middle) - 1))]


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0 for undefined values, else from 1 on."""
    return np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, x, "right"))


def _leaf(g, h):
    return -g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The best place to cut a row of bins in two, and what it gains; 0 if none is allowed."""
    if len(g) < 2:
        return 0.0, 0
    a, b, m = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - _gain(g.sum(), h.sum())
    gain = np.where((m >= LEAST) & (n.sum() - m >= LEAST), gain, -1.0)
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values by bin of a tree of the given depth."""
    gain, k = _cut(g, h, n) if depth else (0.0, 0)
    if not k:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([tree(g[:k], h[:k], n[:k], depth - 1), tree(g[k:], h[k:], n[k:], depth - 1)])


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int, np.ndarray]:
    """The best crossed cut of a table of bins: gain over none, where, and the four values."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (a, b):
        x, right, low, whole = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        parts.append(np.stack([x, right - x, low - x, whole - right - low + x]))
    gain = _gain(*parts).sum(0) - _gain(a[-1, -1], b[-1, -1])
    p, q = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[p, q]), int(p) + 1, int(q) + 1, _leaf(parts[0][:, p, q], parts[1][:, p, q])


@dataclass
class Additive:
    """``tables``: values by bin of each feature; ``pairs``: (i, j, values by both coarse bins)."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            s += t[binned(x[:, j], e)]
        if self.pairs:
            used = {k: binned(x[:, k], self.coarse[k]) for i, j, _ in self.pairs for k in (i, j)}
            for i, j, t in self.pairs:
                s += t[used[i], used[j]]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _loss(s, y, w):
    return float((w * (np.logaddexp(0, s) - y * s)).sum() / w.sum())


class _Boost:
    """Scores and gradients of the texts, and the best state on the held-back ones."""

    def __init__(self, s, y, w, own, other):
        self.s, self.y, self.w, self.own, self.other = s, y, w, own, other
        self.best, self.at, self.kept = np.inf, 0, None

    def gradients(self):
        p = 1 / (1 + np.exp(-self.s[self.own]))
        w = self.w[self.own]
        return w * (p - self.y[self.own]), w * p * (1 - p)

    def watch(self, round_: int, tables) -> bool:
        """Keeps the tables if the held-back loss is the least so far; False after 30 rounds without."""
        now = _loss(self.s[self.other], self.y[self.other], self.w[self.other])
        if now < self.best - 1e-6:
            self.best, self.at, self.kept = now, round_, [t.copy() for t in tables]
        return round_ - self.at < 30


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, seed: int = 11) -> Additive:
    w = np.ones(len(y)) if w is None else w
    y = y.astype(float)
    if len(y) < 8 or y.sum() < 2 or y.sum() > len(y) - 2:
        rate = (w @ y + 1) / (w.sum() + 2)
        return Additive(float(np.log(rate / (1 - rate))))
    edges = [cuts(x[:, j], BINS) for j in range(x.shape[1])]
    coarse = [cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    code = [binned(x[:, j], e) for j, e in enumerate(edges)]
    rough = [binned(x[:, j], e) for j, e in enumerate(coarse)]
    rate = float(w @ y / w.sum())
    base = math.log(rate / (1 - rate))
    # folds alike in both classes
    fold = np.empty(len(y), int)
    rng = np.random.default_rng(seed)
    for k in (0, 1):
        at = rng.permutation(np.flatnonzero(y == k))
        fold[at] = np.arange(len(at)) % FOLDS
    tables = [np.zeros(len(e) + 2) for e in edges]
    for k in range(FOLDS):
        own, other = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        state, now = _Boost(np.full(len(y), base), y, w, own, other), [np.zeros_like(t) for t in tables]
        state.watch(0, now)
        for r in range(1, ROUNDS + 1):
            for j, c in enumerate(code):
                g, h = state.gradients()
                own_bins, size = c[own], len(now[j])
                step = RATE * tree(*(np.bincount(own_bins, v, size) for v in (g, h)), np.bincount(own_bins, minlength=size))
                now[j] += step
                state.s += step[c]
            if not state.watch(r, now):
                break
        for t, kept in zip(tables, state.kept, strict=True):
            t += kept / FOLDS
    singles = base + sum(t[c] for t, c in zip(tables, code, strict=True))
    size = [len(e) + 2 for e in coarse]
    flat = lambda i, j: rough[i] * size[j] + rough[j]
    every = _Boost(singles, y, w, np.arange(len(y)), np.arange(0))
    g, h = every.gradients()
    ranked = []
    for i in range(len(size)):
        for j in range(i + 1, len(size)):
            if size[i] > 2 and size[j] > 2:
                cells = [np.bincount(flat(i, j), v, size[i] * size[j]).reshape(size[i], size[j]) for v in (g, h)]
                ranked.append((-quadrants(*cells)[0], i, j))
    chosen = [(i, j) for _, i, j in sorted(ranked)[:PAIRS]]
    crossed = [np.zeros((size[i], size[j])) for i, j in chosen]
    for k in range(FOLDS) if chosen else ():
        own, other = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        state, now = _Boost(singles.copy(), y, w, own, other), [np.zeros_like(t) for t in crossed]
        state.watch(0, now)
        for r in range(1, ROUNDS + 1):
            for (i, j), t in zip(chosen, now, strict=True):
                g, h = state.gradients()
                place = flat(i, j)
                cells = [np.bincount(place[own], v, t.size).reshape(t.shape) for v in (g, h)]
                _, p, q, leaf = quadrants(*cells)
                step = np.zeros_like(t)
                step[:p, :q], step[:p, q:], step[p:, :q], step[p:, q:] = RATE / 2 * leaf
                t += step
                state.s += step.ravel()[place]
            if not state.watch(r, now):
                break
        for t, kept in zip(crossed, state.kept, strict=True):
            t += kept / FOLDS
    return Additive(base, edges, coarse, tables, [(i, j, t) for (i, j), t in zip(chosen, crossed, strict=True)])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = 6000) -> Additive:
    """Fits on about ``rows`` labelled texts, half of each class or all of a rarer one, weighted back
    to the shares of all labelled texts. Features are found where the texts are."""
    scratch = Scratch(docs.sparkSession)
    own = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.min("y").cast("int").alias("y"))
    use = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    known = scratch.save(own.join(use.select("k"), "k", "left_semi"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    have = {y: n.get(y, 0) for y in (0, 1)}
    picked = [bounded_sample(known.where(f"y = {y}"), "k", max(rows // 2, rows - have[1 - y])) for y in (0, 1)]
    got = _described(use.join(F.broadcast(picked[0].union(picked[1])), "k").select("t", "y")).distinct().collect()  # at most 2 * rows, or what ids stand for
    scratch.drop(known)
    if not got:
        return Additive(0.0)
    got.sort()
    x, y = np.array([r.f for r in got], float), np.array([r.y for r in got])
    share = {k: max(int((y == k).sum()), 1) for k in (0, 1)}
    return fit(x, y, np.array([have[k] / share[k] for k in y]) * len(y) / sum(have.values()))


def _described(df: DataFrame) -> DataFrame:
    """(y, f): the label and the features of t; undefined ones as NaN."""

    @F.pandas_udf("array<double>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([features_of(s) for s in t], dtype=object)

    return df.select("y", run("t").alias("f"))


def score(docs: DataFrame, model: Additive, text: str = "text", out: str = "quality") -> DataFrame:
    """The input with a column ``out``; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(features([s if isinstance(s, str) else None for s in t])))

    return docs.withColumn(out, run(F.col(f"`{text}`")))
