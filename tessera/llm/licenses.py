"""Licence notices by a trained paragraph classifier.

A paragraph is a line, or a run of neighbouring lines made up of words of notices. Its features are
sparse word 1- to 3-grams; multinomial logistic regression, trained in numpy, predicts its class:
one of the families (from their templates, with random cuts and insertions), ``unknown`` (notices
of licences that have no family here, from general forms with invented names) or ``none`` (text of
a bounded sample, and sentences that use such words otherwise). The probabilities are calibrated
by one temperature, fitted on held-out examples; thresholds on them are set there so that at most
``accept`` of the other paragraphs pass.

A family stands only if a template of it confirms it: enough of the template's 2-grams, or of the
paragraph's where it quotes a part, are shared, and a short one holds a name of the family. What
passes for a notice but no template confirms is ``unknown``.

Every paragraph that shares a word with a template or a form is scored; the others are ``none``.

Defined cases: null and empty texts have no notice; a document may have several families, each is
listed once, in order, and ``unknown`` only where no family stands; equal texts get equal results; whole texts are read; an empty table gives
an empty result and a model of the templates alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample
from .license_texts import HINTS, NAMES, OTHERS, TEMPLATES, UNLISTED

CONFIRMED, SHORT = 0.6, 15
_WORD = re.compile(r"[a-z0-9]+")


def grams(text: str, longest: int = 3) -> list[str]:
    w = _WORD.findall(text.lower())
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def pairs(text: str) -> set[str]:
    w = _WORD.findall(text.lower())
    return set(map(" ".join, zip(w, w[1:], strict=False)))


def shared(own: set[str], templates: list[set[str]]) -> float:
    best = 0.0
    for t in templates:
        common = len(own & t)
        best = max(best, common / len(t), common / len(own) if common >= 6 and own else 0.0)
    return best


@dataclass
class Model:
    families: list[str]  # the last two are ``unknown`` and ``none``
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    templates: dict[str, list[set[str]]]
    threshold: float = 0.5  # of a family's probability
    notice: float = 0.97  # of the probability of being a notice at all
    temperature: float = 1.0

    def features(self, text: str) -> list[int]:
        """Those of ``grams``; a gram can only be known if each of its words is."""
        known, out, before, last = self.vocabulary, set(), "", ""
        for w in _WORD.findall(text.lower()):
            if w not in known:
                before = last = ""
                continue
            out.add(known[w])
            if last:
                two = f"{last} {w}"
                if two in known:
                    out.add(known[two])
                    if before and (three := f"{before} {two}") in known:
                        out.add(known[three])
            before, last = last, w
        return sorted(out)

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        z = (np.stack([self.weights[r].sum(0) / np.sqrt(max(len(r), 1)) for r in rows]) + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def confirmed(self, family: str, text: str) -> float:
        """The greatest share of 2-grams common to the paragraph and a template of the family."""
        own, words = pairs(text), set(_WORD.findall(text.lower()))
        named = not words.isdisjoint(NAMES[family])
        return shared(own, [t for t in self.templates[family] if named or len(t) >= SHORT])

    def paragraphs(self, text: str) -> list[tuple[str, list[int], int]]:
        """Each line, and each run of lines that hold a hint or mostly known grams, from its first
        line and from its first hint; with features, and only those that have some; and the number of
        the run, one of its own for a line outside of runs."""
        out, run, hint, number = [], [], None, 0
        for line in [*text.split("\n"), ""]:
            f = self.features(line)
            low = line.lower()
            hinted = any(a in low for a in HINTS)
            if line and (hinted or len(f) * 2 > len(low.split())):
                if hinted and hint is None:
                    hint = len(run)
                run.append(line)
                if f:
                    out.append((line, f, number))
                continue
            for joined in {" ".join(run[k:]) for k in (0, hint) if k is not None and len(run) - k > 1}:
                if g := self.features(joined):
                    out.append((joined, g, number))
            if f:
                out.append((line, f, number + 1))
            run, hint, number = [], None, number + 2
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, float]]:
        """(family, probability, share confirmed) of each family found, in order of name."""
        parts = self.paragraphs(text or "")
        if not parts:
            return []
        found: dict[str, tuple[float, float]] = {}
        rest: dict[int, float] = {}
        known: set[int] = set()
        for (p, _, run), prob in zip(parts, self.probabilities([f for _, f, _ in parts]), strict=True):
            k = int(prob[:-2].argmax())
            share = self.confirmed(self.families[k], p) if prob[k] >= self.threshold else 0.0
            if share >= CONFIRMED:
                known.add(run)
                found[self.families[k]] = max(found.get(self.families[k], (0.0, 0.0)), (float(prob[k]), share))
            elif 1 - prob[-1] >= self.notice:
                rest[run] = max(rest.get(run, 0.0), float(1 - prob[-1]))
        alone = [p for run, p in rest.items() if run not in known]  # a line in a known notice's run belongs to it
        if alone:
            found["unknown"] = (max(alone), 0.0)
        return [(k, *v) for k, v in sorted(found.items())]


def _examples(others: list[str], rng: np.random.Generator, n: int) -> tuple[list[str], list[int]]:
    """Templates with dropped and inserted words, filled forms of the class unknown, and others."""
    families, texts, labels = list(TEMPLATES), [], []
    fill = [w for o in others[:200] for w in o.split()[:20]] or ["lorem", "ipsum", "dolor"]
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters, int(rng.integers(3, 9))))
    for _ in range(n):
        k = int(rng.integers(0, len(families) + 12))
        if len(families) <= k < len(families) + 4:
            w = str(UNLISTED[rng.integers(0, len(UNLISTED))]).split()
            w = [x.replace("YEAR", str(rng.integers(1980, 2026))).replace("NAME", " ".join(word() for _ in range(rng.integers(1, 4)))) for x in w if len(w) < 5 or rng.random() > 0.08]
            texts.append(" ".join(w))
            labels.append(len(families))
        elif k < len(families):
            w = TEMPLATES[families[k]][rng.integers(0, len(TEMPLATES[families[k]]))].split()
            if len(w) > 15:
                w = [x for x in w if rng.random() > 0.08]
                if rng.random() < 0.3:
                    a = int(rng.integers(0, len(w) - 12))
                    w = w[a : a + int(rng.integers(12, len(w) + 1))]
            if rng.random() < 0.3:
                w = [str(rng.choice(fill)) for _ in range(rng.integers(1, 6))] + w
            texts.append(" ".join(w))
            labels.append(k)
        else:
            pool = others if others and rng.random() < 0.5 else OTHERS
            w = str(pool[rng.integers(0, len(pool))]).split()
            if rng.random() < 0.5:
                w = [str(rng.choice(fill)) for _ in range(rng.integers(1, 10))] + w
            texts.append(" ".join(w[:120]))
            labels.append(len(families) + 1)
    return texts, labels


def fit(others: list[str], n: int = 2600, steps: int = 120, accept: float = 0.002, seed: int = 2) -> Model:
    rng = np.random.default_rng(seed)
    texts, labels = _examples(others, rng, n)
    vocabulary: dict[str, int] = {}
    for t in [*(x for f in TEMPLATES.values() for x in f), *OTHERS, *(x.replace("NAME", "").replace("YEAR", "") for x in UNLISTED)]:
        for g in grams(t):
            vocabulary.setdefault(g, len(vocabulary))
    k = len(TEMPLATES) + 2
    model = Model([*TEMPLATES, "unknown", "none"], vocabulary, np.zeros((len(vocabulary), k)), np.zeros(k), {f: [pairs(t) for t in x] for f, x in TEMPLATES.items()})
    rows = [model.features(t) for t in texts]
    y = np.array(labels)
    held = np.arange(n) % 5 == 0
    train = np.flatnonzero(~held)
    flat = np.concatenate([np.array(rows[i], int) for i in train])
    owner = np.repeat(np.arange(len(train)), [len(rows[i]) for i in train])
    value = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(train)), 1))
    order = np.argsort(flat, kind="stable")
    used, first = np.unique(flat[order], return_index=True)
    size = np.full(model.weights.shape, 1e-6)
    for _ in range(steps):
        z = np.zeros((len(train), k))
        np.add.at(z, owner, model.weights[flat])
        z = z * value[:, None] + model.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(train)), y[train]] -= 1
        g = np.add.reduceat((p * value[:, None])[owner[order]], first, axis=0) / len(train)
        size[used] += g * g
        model.weights[used] -= 0.3 * g / np.sqrt(size[used]) + 1e-4 * model.weights[used]
        model.bias -= 0.5 * p.mean(0)
    at = np.flatnonzero(held)
    likely = []
    for model.temperature in np.geomspace(0.3, 3, 24):
        likely.append((float(np.log(model.probabilities([rows[i] for i in at])[np.arange(len(at)), y[at]] + 1e-12).mean()), float(model.temperature)))
    model.temperature = max(likely)[1]
    # thresholds: on the held-out examples, and on lines of the sample that were not drawn for them
    p = model.probabilities([rows[i] for i in at])
    free = [f for o in others if (f := model.features(o))]
    other = np.concatenate([p[y[at] == k - 1], *([model.probabilities(free)] if free else [])])
    model.threshold = float(max(0.3, np.quantile(other[:, :-2].max(1), 1 - accept))) if len(other) else 0.5
    model.notice = float(max(0.97, np.quantile(1 - other[:, -1], 1 - accept))) if len(other) else 0.97
    return model


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = 400, longest: int = 20_000) -> Model:
    """Fits on the templates and on lines that confirm no template of about ``rows`` documents."""
    use = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("length(t) between 1 and %d" % longest)
    lines = [x for r in bounded_sample(use, "k", rows).orderBy("k").collect() for x in r.t.split("\n")]
    templates = [pairs(t) for f in TEMPLATES.values() for t in f]
    return fit([x for x in lines if x.strip() and shared(pairs(x), templates) < CONFIRMED])


def scan(docs: DataFrame, model: Model, text: str = "text", out: str = "licences") -> DataFrame:
    """The input with an array column ``out`` of structs family (or ``unknown``), probability,
    confirmed; empty without a notice. A column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<family:string,probability:double,confirmed:double>>")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("family", "probability", "confirmed"), x, strict=True)) for x in sent.value.scan(t)] for t in col], dtype=object)

    return docs.withColumn(out, run(F.col(f"`{text}`")))
