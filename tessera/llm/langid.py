"""Language identification by error-correcting output codes.

Every learned language has a codeword of +1 and -1; for each bit a binary classifier over hashed
byte n-grams (2, 3 and 4 bytes of the lower-cased UTF-8 text) tells on which side the text lies:
the log-odds of the n-grams on either side, averaged over the whole text, then scaled by a fitted
logistic slope and offset. Decoding weighs the logistic loss of every bit by the bit's training
accuracy, takes the codeword of least loss and flags a text as ambiguous where two codewords are
nearly equal.

Defined cases: null, empty and letterless texts get ``und`` with score 0; rows without a language
are never learned from; with no learnable row every text is ``und``; with one language that one is
predicted; equal texts get equal results; texts of any length are read whole, in slices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, tidy

BITS = 16
SIZES = (2, 3, 4)
#: texts are scored in slices of so many bytes
SLICE = 1 << 18
_WORDLIKE = re.compile(r"[^\W\d_]")
_MIX = np.uint32(2654435761)


def has_letter(text: str) -> bool:
    """Whether a code point of a letter category (L*) occurs; numerals such as ½ are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k codewords, +1 or -1: for up to 6 languages every way to split them, else the best of
    several random tables by least distance."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 6:
        rows = [[1 if (m >> i) & 1 else -1 for m in range(1 << (k - 1)) if m] for i in range(k - 1)]
        return np.array([[-1] * len(rows[0]), *rows] if rows else [[-1]], np.float32)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(k)))
    for _ in range(50):
        c = rng.choice([-1, 1], (k, bits)).astype(np.float32)
        d = int(((bits - c @ c.T) / 2 + bits * np.eye(k)).min())
        if d > far and (np.abs(c.sum(0)) < k).all():
            best, far = c, d
    return best


def _slots(buf: np.ndarray, n: int) -> np.ndarray:
    """The table row of each n-gram that starts in ``buf`` without its last 3 bytes."""
    m = len(buf) - 3
    x = buf[:m].astype(np.uint32)
    for i in range(1, n):
        x |= buf[i : i + m].astype(np.uint32) << np.uint32(8 * i)
    return x if n == 2 else (x * _MIX + np.uint32(n)) >> np.uint32(32 - BITS)


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer for all texts, each between blanks, and where each begins; the last entry is the end."""
    parts = [b" " + t.lower().encode("utf-8", "replace") + b"   " for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def sums(texts: list[str], tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its n-grams' table rows, and the number of n-grams."""
    buf, at = packed(texts)
    out = np.zeros((len(texts), tables[0].shape[1]))
    end = len(buf) - 3
    for s in range(0, max(end, 0), SLICE):
        e = min(s + SLICE, end)
        first, last = np.searchsorted(at, s, "right") - 1, np.searchsorted(at, e, "left") - 1
        cuts = np.maximum(at[first : last + 1], s) - s
        for n, table in zip(SIZES, tables, strict=True):
            rows = table[_slots(buf[s : e + 3], n)]
            out[first : last + 1] += np.add.reduceat(rows, np.minimum(cuts, len(rows) - 1), axis=0)
    return out, np.maximum(np.diff(at) - 3, 1) * len(SIZES)


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    tables: list[np.ndarray]
    slope: np.ndarray
    offset: np.ndarray
    weight: np.ndarray
    gap: float = 0.02

    def margins(self, texts: list[str]) -> np.ndarray:
        total, n = sums(texts, self.tables)
        return total / n[:, None] * self.slope + self.offset

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang, score, ambiguous of each text."""
        lang, score, vague = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        use = [i for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        lo = 0
        while lo < len(use):  # a few MB at a time
            hi, size = lo, 0
            while hi < len(use) and (hi == lo or size + len(texts[use[hi]]) <= 4 * SLICE):
                size += len(texts[use[hi]])
                hi += 1
            part = use[lo:hi]
            m = np.clip(self.margins([texts[i] for i in part]), -30, 30)
            loss = (np.log1p(np.exp(-m[:, None, :] * self.codes[None])) * self.weight).sum(-1)
            p = np.exp(loss.min(1, keepdims=True) - loss)
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            top = np.sort(p, axis=1)
            for j, i in enumerate(part):
                lang[i], score[i] = self.langs[best[j]], float(p[j, best[j]])
                vague[i] = p.shape[1] > 1 and top[j, -1] - top[j, -2] < self.gap
            lo = hi
        return pd.DataFrame({"lang": lang, "score": np.clip(score, 0.0, 1.0), "ambiguous": vague})


def fit(texts: list[str], langs: list[str], snippet: int = 400) -> Model:
    """From whole labelled texts; snippets of them fit the slopes, for texts of any length."""
    names = sorted(set(langs))
    codes = codewords(len(names))
    y = np.array([names.index(x) for x in langs], int)
    wide = 1 << 16
    counts = [np.zeros((len(names), wide)) for _ in SIZES]
    for k in range(len(names)):
        buf, _ = packed([t for t, j in zip(texts, y, strict=True) if j == k])
        for c, n in zip(counts, SIZES, strict=True):
            c[k] = np.bincount(_slots(buf, n), minlength=wide)[:wide]
    tables = []
    for c in counts:
        p = (c + 0.05) / (c + 0.05).sum(1, keepdims=True)
        up, down = codes > 0, codes < 0
        mean = lambda side: (side.T.astype(float) @ p) / np.maximum(side.sum(0), 1)[:, None] + 1e-9
        tables.append(np.clip(np.log(mean(up)) - np.log(mean(down)), -8, 8).T.astype(np.float32))
    cut = [(t[i : i + snippet], j) for t, j in zip(texts, y, strict=True) for i in range(0, min(len(t), 3 * snippet), snippet) if has_letter(t[i : i + snippet])]
    model = Model(names, codes, tables, np.ones(codes.shape[1]), np.zeros(codes.shape[1]), np.ones(codes.shape[1]))
    if not names:
        return model
    m, sign = model.margins([c[0] for c in cut]), codes[[c[1] for c in cut]]
    a, b = np.full(m.shape[1], 4.0), np.zeros(m.shape[1])
    for _ in range(300):  # logistic slope and offset of each bit
        g = -sign / (1 + np.exp(np.clip(sign * (a * m + b), -30, 30)))
        a -= 2.0 * ((g * m).mean(0) + 1e-4 * a)
        b -= 2.0 * g.mean(0)
    model.slope, model.offset = a, b
    model.weight = np.maximum(2 * ((np.sign(a * m + b) == sign).mean(0)) - 1, 0.05)
    return model


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = 3000, longest: int = 20_000) -> Model:
    """Fits on about ``rows`` labelled texts of at most ``longest`` characters, a bounded sample."""
    use = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("y")).where("y is not null and t is not null and length(t) between 1 and %d" % longest)
    got = sorted({(r.t, r.y) for r in bounded_sample(use, "k", rows).select("t", "y").collect()})
    return fit([t for t, _ in got], [y for _, y in got])


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """The input with a struct column ``out`` (lang, score, ambiguous); a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for col in parts:
                yield sent.value.predict([t if isinstance(t, str) else None for t in col])
        finally:
            tidy()

    return docs.withColumn(out, predict(F.col(f"`{text}`")))
