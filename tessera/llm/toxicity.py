"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is the mean of trained embeddings of all its character 3-grams, a trained embedding
of the word's slot, and the word's log-odds between labelled toxic and other texts. Words end at
white space; a longer run than ``LONGEST`` is split at marks too, and what is still longer, or is
written in a script without blanks, is read as overlapping pieces. The network reads
windows of ``WIDTH`` (48) words, of which the last 16 begin the next, over the whole text; attention pools
a window's states into one logit; a document's score is that of its highest window. Training in
numpy follows this: in every step each document's gradient goes through its highest window. The
log-odds that a document is trained with come from the other folds.

Defined cases: null and empty texts, and all texts where there are fewer than 8 labelled texts or
fewer than 2 of a class, get the share of toxic labelled texts as score; equal texts get equal scores; repeated training texts count once;
texts of any length are scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample

WIDTH, STRIDE, HIDDEN, DIM, SLOTS, LONGEST, PIECE = 48, 32, 12, 8, 4096, 32, 2
INPUT = 2 * DIM + 1
#: Share of words whose embeddings are shown in a step, and decay of embeddings: against learning texts by heart
SHOWN, DECAY = 0.3, 3.0
_EDGES = ".,;:!?\"'()[]{}<>*#-_/\\&%$|"


_MARKS = re.compile(f"[{re.escape(_EDGES)}]+")
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+)")


def _cut(run: str, size: int) -> list[str]:
    """Pieces of ``size`` characters, half of each overlapping the next."""
    return [run[i : i + size] for i in range(0, max(len(run) - size // 2, 1), size // 2)]


def words_of(text: str) -> list[str]:
    words = [w.strip(_EDGES) or w for w in text.lower().split()]
    if any(len(w) > LONGEST for w in words):
        words = [p for w in words for p in ([w] if len(w) <= LONGEST else [q for q in _MARKS.split(w) if q] or [w])]
    if not text.isascii() and _UNSPACED.search(text):
        parts = [p for w in words for p in _UNSPACED.split(w) if p]
        words = [q for p in parts for q in (_cut(p, PIECE) if _UNSPACED.match(p) else [p])]
    if any(len(w) > LONGEST for w in words):
        words = [q for w in words for q in _cut(w, LONGEST)]
    return words


def _slots(word: str) -> tuple[int, list[int]]:
    """The word's slot, and those of its character 3-grams."""
    b = f"^{word}$".encode("utf-8", "surrogatepass")
    return zlib.crc32(b) % SLOTS, [zlib.crc32(b[i : i + 3]) % SLOTS for i in range(max(len(b) - 2, 1))]


def taken(words: tuple, at: np.ndarray) -> tuple:
    """The rows ``at`` of a lexicon's arrays."""
    slot, grams, count, value = words
    n = count[at].astype(np.int64)
    first = np.cumsum(count, dtype=np.int64)[at] - n
    places = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    return slot[at], grams[places], count[at], value[at]


class Lexicon:
    """Rows of a table of words: slot, 3-gram slots (of all words in one list), their numbers and
    log-odds."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.row = odds, {}
        self.slot, self.grams, self.count, self.value = array("i"), array("i"), array("f"), array("f")

    def add(self, words) -> None:
        for w in words:
            if w not in self.row:
                self.row[w] = len(self.slot)
                s, g = _slots(w)
                self.slot.append(s)
                self.grams.extend(g)
                self.count.append(len(g))
                self.value.append(self.odds.get(w, 0.0))

    def arrays(self, start: int = 0, grams: int = 0):
        """From row ``start`` on, whose first 3-gram is at ``grams``."""
        return np.array(self.slot[start:], np.int32), np.array(self.grams[grams:], np.int32), np.array(self.count[start:], np.float32), np.array(self.value[start:], np.float32)


def log_odds(bags: list[set[str]], y: np.ndarray) -> dict[str, float]:
    """Of words in 3 texts or more, from numbers of texts, scaled to about -1..1."""
    n: dict[str, list[int]] = {}
    for bag, label in zip(bags, y, strict=True):
        for w in bag:
            n.setdefault(w, [0, 0])[label] += 1
    pos, neg = max(int(y.sum()), 1), max(int(len(y) - y.sum()), 1)
    out = {}
    for w, (b, a) in n.items():
        if a + b >= 3:
            v = np.log((a + 0.5) / (pos + 1)) - np.log((b + 0.5) / (neg + 1))
            s = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            out[w] = float(np.clip(v / (1 + s) / 2, -1.5, 1.5))
    return out


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    odds: dict[str, float] = field(default_factory=dict)
    rate: float = 0.0
    constant: bool = False

    @classmethod
    def new(cls, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *s, k=0.2: (rng.standard_normal(s) * k).astype(np.float32)
        p = {"ew": make(SLOTS, DIM, k=0.05), "ec": make(SLOTS, DIM, k=0.1), "wa": make(2 * HIDDEN, DIM), "va": make(DIM), "wo": make(2 * HIDDEN, k=0.5), "bo": np.zeros(1, np.float32)}
        for d in "fb":
            p |= {f"x{d}": make(INPUT, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": make(HIDDEN, 3 * HIDDEN)}
            p[f"x{d}"][-1] *= 5
        return cls(p)

    def inputs(self, slot, grams, count, value, seen: np.ndarray | None = None) -> np.ndarray:
        """``seen``: which words show their embeddings (in training); all if None."""
        first = np.cumsum(count, dtype=np.int64) - count.astype(np.int64)
        total = np.add.reduceat(self.p["ec"][grams], first, axis=0)
        own = np.concatenate([self.p["ew"][slot], total / count[:, None]], 1)
        own = own if seen is None else own * seen[:, None]
        return np.concatenate([own, value[:, None]], 1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Per word, what it adds to the gates of both directions."""
        return np.concatenate([x @ self.p["xf"] + self.p["bf"], x @ self.p["xb"] + self.p["bb"]], 1)

    def run(self, g: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False):
        """g: gates by word row; idx, mask: (N, T). Logits, and what the gradients need."""
        n, steps = idx.shape
        hs, tapes = [], []
        for k, d in enumerate("fb"):
            u, h = self.p[f"u{d}"], np.zeros((n, HIDDEN), np.float32)
            out, tape = np.empty((n, steps, HIDDEN), np.float32), []
            own = g[:, 3 * HIDDEN * k : 3 * HIDDEN * (k + 1)]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x, hu = own[idx[:, t]], h @ u
                rz = _sig(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                m = mask[:, t, None]
                new = h + m * (1 - z) * (c - h)
                if keep:
                    tape.append((t, h, r, z, c, hu[:, 2 * HIDDEN :], m))
                h = new
                out[:, t] = h
            hs.append(out)
            tapes.append(tape)
        h = np.concatenate(hs, 2)
        a = np.tanh(h @ self.p["wa"])
        s = a @ self.p["va"] + np.where(mask > 0, 0, -1e4).astype(np.float32)
        w = np.exp(s - s.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        ctx = (w[:, :, None] * h).sum(1)
        return ctx @ self.p["wo"] + self.p["bo"], (h, a, w, ctx, tapes)

    def gradients(self, words, idx: np.ndarray, mask: np.ndarray, y: np.ndarray, seen: np.ndarray | None = None) -> dict[str, np.ndarray]:
        slot, grams, count, value = words
        x = self.inputs(slot, grams, count, value, seen)
        logit, (h, a, w, ctx, tapes) = self.run(self.gates(x), idx, mask, True)
        p, n = self.p, len(y)
        dl = ((_sig(logit) - y) / n).astype(np.float32)
        out = {"wo": ctx.T @ dl, "bo": dl.sum(keepdims=True)}
        dctx = dl[:, None] * p["wo"]
        dh = w[:, :, None] * dctx[:, None]
        dw = (h * dctx[:, None]).sum(2)
        ds = w * (dw - (w * dw).sum(1, keepdims=True))
        out["va"] = np.einsum("nt,ntd->d", ds, a)
        da = ds[:, :, None] * p["va"] * (1 - a * a)
        out["wa"] = np.einsum("nth,ntd->hd", h, da)
        dh = dh + da @ p["wa"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, du = p[f"u{d}"], np.zeros_like(p[f"u{d}"])
            dg = np.zeros((len(x), 3 * HIDDEN), np.float32)
            acc = np.zeros((n, HIDDEN), np.float32)
            for t, old, r, z, c, hn, m in reversed(tapes[k]):
                acc = acc + dh[:, t, HIDDEN * k : HIDDEN * (k + 1)]
                dc = acc * m * (1 - z) * (1 - c * c)
                dz = -acc * m * (c - old) * z * (1 - z)
                dr = dc * hn * r * (1 - r)
                dhu = np.concatenate([dr, dz, dc * r], 1)
                np.add.at(dg, idx[:, t], np.concatenate([dr, dz, dc], 1))
                du += old.T @ dhu
                acc = acc * (1 - m * (1 - z)) + dhu @ u.T
            out |= {f"u{d}": du, f"x{d}": x.T @ dg, f"b{d}": dg.sum(0)}
            dx += dg @ p[f"x{d}"].T
        dx = dx if seen is None else dx * seen[:, None]
        out["ew"], out["ec"] = np.zeros_like(p["ew"]), np.zeros_like(p["ec"])
        np.add.at(out["ew"], slot, dx[:, :DIM])
        np.add.at(out["ec"], grams, np.repeat(dx[:, DIM : 2 * DIM] / count[:, None], count.astype(np.int64), axis=0))
        return out


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words; together they hold every word."""
    return np.arange(0, max(n - (WIDTH - STRIDE), 1), STRIDE)


def laid_out(lengths: list[int], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the concatenated words, mask and owner of every window."""
    starts = [windows(n) for n in lengths]
    owner = np.repeat(np.arange(len(lengths)), [len(s) for s in starts])
    local = np.concatenate(starts)[:, None] + np.arange(WIDTH) if starts else np.zeros((0, WIDTH), int)
    mask = local < np.array(lengths)[owner][:, None]
    return np.where(mask, local + at[owner][:, None], 0), mask.astype(np.float32), owner


class Scorer:
    """Per worker. A table of words' gates is kept and begun anew at ``limit`` words."""

    def __init__(self, net: Network, limit: int = 150_000, words: int = 200_000, batch: int = 2048):
        self.net, self.limit, self.words, self.batch = net, limit, words, batch
        self._reset()

    def _reset(self) -> None:
        self.lex, self.table = Lexicon(self.net.odds), np.empty((0, 6 * HIDDEN), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.lex.row)
        if len(self.lex.row) + len(new) > self.limit and self.lex.row:
            self._reset()
            new = set(words)
        if new:
            names, tables = sorted(new), [self.table]
            for lo in range(0, len(names), 20_000):
                start, grams = len(self.lex.slot), len(self.lex.grams)
                self.lex.add(names[lo : lo + 20_000])
                tables.append(self.net.gates(self.net.inputs(*self.lex.arrays(start, grams))))
            self.table = np.concatenate(tables)
        return np.fromiter(map(self.lex.row.__getitem__, words), np.int64, len(words))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.net.rate)
        if self.net.constant:
            return out
        first: dict[str, int] = {}
        same = [first.setdefault(t, i) if t else -1 for i, t in enumerate(texts)]
        todo, size, group = list(first.values()), 0, []
        bags: list[list[str]] = []
        for i in [*todo, None]:
            if i is None or size >= self.words:
                if group:
                    out[group] = self._score(bags, out[group])
                group, bags, size = [], [], 0
            if i is not None and (w := words_of(texts[i])):
                group.append(i)
                bags.append(w)
                size += len(w)
        return np.where(np.array(same) >= 0, out[same], out) if len(texts) else out

    def _score(self, bags: list[list[str]], out: np.ndarray) -> np.ndarray:
        lengths = [len(b) for b in bags]
        rows = self._rows([w for b in bags for w in b])
        idx, mask, owner = laid_out(lengths, np.cumsum([0, *lengths])[:-1])
        best = np.full(len(bags), -np.inf)
        for lo in range(0, len(idx), self.batch):
            part = slice(lo, lo + self.batch)
            logit, _ = self.net.run(self.table, rows[idx[part]], mask[part])
            np.maximum.at(best, owner[part], logit)
        return _sig(best)


def fit(texts: list[str], labels: list[int], steps: int = 320, docs: int = 36, seed: int = 5, rate: float | None = None) -> Network:
    """``rate`` is the share of toxic texts where the given ones are chosen by class. A step draws
    a third of its texts from the toxic ones, whatever the share."""
    pairs = dict(zip(texts, labels, strict=True))
    bags = [words_of(t) for t in pairs]
    y = np.array(list(pairs.values()), int)
    keep = [i for i, b in enumerate(bags) if b]
    bags, y = [bags[i] for i in keep], y[keep]
    net = Network.new(seed)
    net.rate = rate if rate is not None else float(y.mean()) if len(y) else 0.0
    if len(y) < 8 or y.sum() < 2 or y.sum() > len(y) - 2:
        net.constant = True
        return net
    sets = [set(b) for b in bags]
    rng = np.random.default_rng(seed)
    fold = rng.integers(0, 4, len(y))
    by_fold = [log_odds([s for s, f in zip(sets, fold, strict=True) if f != k], y[fold != k]) for k in range(4)]
    net.odds = log_odds(sets, y)
    names = sorted(set().union(*sets))
    lex = Lexicon({})
    lex.add(names)
    slot, grams, count, _ = lex.arrays()
    values = np.array([[o.get(w, 0.0) for w in names] for o in by_fold], np.float32)
    rows = [np.array([lex.row[w] for w in b]) for b in bags]
    up, down = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(up, docs // 3), rng.choice(down, docs - docs // 3)])
        k = step % 4
        pick = pick[fold[pick] == k] if (fold[pick] == k).sum() >= 6 else pick
        flat = np.concatenate([rows[i] for i in pick])
        used, local = np.unique(flat, return_inverse=True)
        idx, mask, owner = laid_out([len(rows[i]) for i in pick], np.cumsum([0, *(len(rows[i]) for i in pick)])[:-1])
        words = taken((slot, grams, count, values[k]), used)
        seen = (rng.random(len(used)) < SHOWN).astype(np.float32)
        idx = local[idx]
        logit, _ = net.run(net.gates(net.inputs(*words, seen)), idx, mask)
        order = np.lexsort((-logit, owner))
        top = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
        some, again = np.unique(idx[top], return_inverse=True)
        grads = net.gradients(taken(words, some), again.reshape(idx[top].shape), mask[top], y[pick[owner[top]]], seen[some])
        rate = 0.015 * (1 - step / (steps + 1)) + 1e-3
        for name, g in grads.items():
            g = np.clip(g, -1, 1)
            m[name] += 0.1 * (g - m[name])
            v[name] += 0.01 * (g * g - v[name])
            net.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            if name in ("ew", "ec"):
                net.p[name] *= np.float32(1 - DECAY * rate)
    return net


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = 4000, longest: int = 20_000) -> Network:
    """Fits on about ``rows`` labelled texts of at most ``longest`` characters, half of each class
    or all of a rarer one. A key with several labels counts as its highest."""
    scratch = Scratch(docs.sparkSession)
    own = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    use = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("length(t) between 1 and %d" % longest)
    known = scratch.save(own.join(use.select("k"), "k", "left_semi"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    other, toxic = n.get(0, 0), n.get(1, 0)
    quota = {0: max(rows // 2, rows - toxic), 1: max(rows // 2, rows - other)}
    picked = bounded_sample(known.where("y = 0"), "k", quota[0]).union(bounded_sample(known.where("y = 1"), "k", quota[1]))
    got = use.join(F.broadcast(picked), "k").select("k", "t", "y").collect()  # at most 2 * rows of these
    scratch.drop(known)
    got = sorted({(r.k, r.t, r.y) for r in got})
    rate = toxic / (other + toxic) if other + toxic > rows else None
    return fit([t for _, t, _ in got], [int(y) for _, _, y in got], rate=rate)


def score(docs: DataFrame, net: Network, text: str = "text", out: str = "toxicity") -> DataFrame:
    """The input with a column ``out``; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def run(parts: pd.Series) -> pd.Series:
        model = sent.value
        if getattr(model, "scorer", None) is None:
            model.scorer = Scorer(model)
        return pd.Series(model.scorer.score([t if isinstance(t, str) else None for t in parts]))

    return docs.withColumn(out, run(F.col(f"`{text}`")))
