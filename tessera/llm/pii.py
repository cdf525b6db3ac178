"""Personal data by fixed patterns and a character-level BiLSTM with CRF transitions.

The base patterns (email, ip, card, phone) find spans as stated in ``base_spans``. The network reads
overlapping windows of the whole text, is decoded by Viterbi and adds spans that the patterns miss
(cards with dots, phones without a plus sign, addresses with blanks, ...). Spans of all windows are
reconciled over the text: an address gets its own first and last character as edges, those cut by a
window's edge give way to whole ones, longer ones go first, overlapping ones and those that touch a
base span are dropped, and each must pass its kind's check (digits, checksum, parts). No span passes a check without a digit, an @, (at) or [at], so a
window with none of these needs no network.

The network is trained in numpy from labelled spans: base matches in a bounded sample of documents,
and written variants of such data set into text of the sample.

Defined cases: null and empty texts have no spans; equal texts get equal spans; texts of any length
are read whole; offsets are code points, ends exclusive; an empty table gives an empty result and
a network trained on generated text alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, tidy

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
WIDTH, STRIDE, HIDDEN, VOCAB = 128, 64, 16, 99
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits begins: elsewhere in a run it would meet the same dots
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]|\(dot\)|\[dot\]")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?(?P<at>@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?:(?:\.| \. | ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]+)+")
_WHOLE_ADDRESS = re.compile(f"(?<![A-Za-z0-9._%+-]){_ADDRESS.pattern}")  # linear on long runs
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: a local part holds no @, so each @ decides for the run before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in order; kind is a place in ``KINDS``."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:  # 19 digits and as many blanks or dashes between them
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_AT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?")
_TAIL = re.compile(r"\S+? (?:\.|\(dot\)|\[dot\]) ?\S+|\S+?(?:\.|\(dot\)|\[dot\]) \S+")
_INNER = re.compile(r"(?s)\S(?:\.|\(dot\)|\[dot\])\S")


def _address(s: str) -> bool:
    """Whether ``s`` is name, at, name, dot, name, of any length, with a blank at most beside the two
    signs. Of signs without a blank the first serves as well as any."""
    if sum(map(str.isspace, s)) > 4:
        return False
    signs = [m for m in _AT.finditer(s) if m.start()]
    for m in [*signs[:1], *(m for m in signs[1:] if " " in m[0])]:
        name, rest = s[: m.start()], s[m.end() :]
        if not any(map(str.isspace, name)) and (_TAIL.fullmatch(rest) if any(map(str.isspace, rest)) else _INNER.search(rest)):
            return bool(re.search(r"[A-Za-z]", s))
    return False


def plausible(kind: int, s: str) -> bool:
    """The check that an added span of the kind must pass."""
    parts = _DIGITS.findall(s)
    d = "".join(parts)
    if kind == 0:
        return _address(s)
    if kind == 1:
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and bool(re.fullmatch(r"[0-9]+((\.| \. |\[\.\]|\(\.\))[0-9]+){3}", s))
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch(r"[0-9]+([ ./_-]{1,3}[0-9]+)*", s))
    return 9 <= len(d) <= 15 and len(parts) >= 3 and bool(re.fullmatch(r"[+(]{0,2}[0-9][0-9 ().\-/]+[0-9]", s))


def char_ids(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where((c >= 32) & (c < 127), c - 31, np.where(c < 32, 96, 97)).astype(np.int16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, u: np.ndarray, back: bool, keep: bool = False):
    """x: (N, T, 4H) inputs of the gates. The states, and what the backward pass needs."""
    n, steps, h4 = x.shape
    hid = h4 // 4
    h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    out, tape = np.empty((n, steps, hid), np.float32), []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        z = x[:, t] + h @ u
        s = _sigmoid(z[:, : 3 * hid])
        g = np.tanh(z[:, 3 * hid :])
        old, before = c, h
        c = s[:, hid : 2 * hid] * c + s[:, :hid] * g
        tc = np.tanh(c)
        h = s[:, 2 * hid :] * tc
        out[:, t] = h
        if keep:
            tape.append((t, s, g, old, before, tc))
    return out, tape


def _lstm_back(dout: np.ndarray, tape, u: np.ndarray):
    n, steps, hid = dout.shape
    dx, du = np.empty((n, steps, 4 * hid), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    for t, s, g, old, before, tc in reversed(tape):
        dh = dh + dout[:, t]
        i, f, o = s[:, :hid], s[:, hid : 2 * hid], s[:, 2 * hid :]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dx[:, t] = dz
        du += before.T @ dz
        dh, dc = dz @ u.T, dc * f
    return dx, du


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large negative number."""
    a = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        a[[t for t in range(TAGS) if t not in (inside - 1, inside)], inside] = -1e4
    return a


@dataclass
class Network:
    x: list[np.ndarray]
    u: list[np.ndarray]
    w: np.ndarray
    b: np.ndarray
    trans: np.ndarray

    @classmethod
    def new(cls, seed: int = 3, hidden: int = HIDDEN) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) * 0.25).astype(np.float32)
        x = [make(VOCAB, 4 * hidden) for _ in range(2)]
        for a in x:
            a[:, hidden : 2 * hidden] += 1  # remember at first
        return cls(x, [make(hidden, 4 * hidden) for _ in range(2)], make(2 * hidden, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))

    def params(self) -> list[np.ndarray]:
        return [*self.x, *self.u, self.w, self.b, self.trans]

    def emissions(self, ids: np.ndarray, keep: bool = False):
        runs = [_lstm(self.x[d][ids], self.u[d], bool(d), keep) for d in range(2)]
        h = np.concatenate([r[0] for r in runs], 2)
        return h @ self.w + self.b, h, [r[1] for r in runs]

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        n, steps = ids.shape
        em, h, tapes = self.emissions(ids, True)
        tr = self.trans + _allowed()
        first = np.where(np.arange(TAGS) % 2 == 0, -1e4, 0.0).astype(np.float32)
        first[0] = 0
        alpha = np.empty_like(em)
        alpha[:, 0] = em[:, 0] + first
        for t in range(1, steps):
            alpha[:, t] = em[:, t] + _logsum(alpha[:, t - 1, :, None] + tr, 1)
        z = _logsum(alpha[:, -1], 1)
        beta, dtr = np.zeros_like(em[:, 0]), np.zeros_like(tr)
        dem = np.empty_like(em)
        dem[:, -1] = np.exp(alpha[:, -1] - z[:, None])
        for t in range(steps - 1, 0, -1):
            pair = np.exp(np.minimum(alpha[:, t - 1, :, None] + tr + (em[:, t] + beta)[:, None, :] - z[:, None, None], 0))
            dtr += pair.sum(0)
            beta = _logsum(tr + (em[:, t] + beta)[:, None, :], 2)
            dem[:, t - 1] = np.exp(np.minimum(alpha[:, t - 1] + beta - z[:, None], 0))
        rows, cols = np.arange(n)[:, None], np.arange(steps)
        gold = em[rows, cols, tags].sum(1) + tr[tags[:, :-1], tags[:, 1:]].sum(1)
        dem[rows, cols, tags] -= 1
        np.add.at(dtr, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        dem /= n
        dh = dem @ self.w.T
        flat = dem.reshape(-1, TAGS)
        hid = self.u[0].shape[0]
        hot = np.zeros((n * steps, VOCAB), np.float32)
        hot[np.arange(n * steps), ids.ravel()] = 1
        dx, du = [], []
        for d in range(2):
            gx, gu = _lstm_back(dh[:, :, d * hid : (d + 1) * hid], tapes[d], self.u[d])
            dx.append(hot.T @ gx.reshape(n * steps, -1))
            du.append(gu)
        return float((z - gold).mean()), [*dx, *du, h.reshape(-1, 2 * hid).T @ flat, flat.sum(0), dtr / n]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tag path of each window."""
        em, _, _ = self.emissions(ids)
        tr = (self.trans + _allowed()).T[None]
        n, steps, _ = em.shape
        score = em[:, 0] + np.where((np.arange(TAGS) % 2 == 0) & (np.arange(TAGS) > 0), -1e4, 0)
        back = np.empty((n, steps, TAGS), np.int8)
        for t in range(1, steps):
            s = score[:, None, :] + tr
            back[:, t] = s.argmax(2)
            score = s.max(2) + em[:, t]
        path = np.empty((n, steps), np.int8)
        path[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[np.arange(n), t, path[:, t]]
        return path


class Finder:
    """Spans of texts, windows of many texts decoded together and equal windows once."""

    def __init__(self, net: Network, batch: int = 512):
        self.net, self.batch = net, batch

    def added(self, texts: list[str], base: list[list]) -> list[list[tuple[int, int, int]]]:
        where: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(texts):
            if t and _TRIGGER.search(t):
                for s in range(0, max(len(t) - STRIDE, 1), STRIDE):
                    if _TRIGGER.search(t, s, s + WIDTH):
                        where.setdefault(t[s : s + WIDTH], []).append((i, s))
        found: list[list] = [[] for _ in texts]
        names = list(where)
        for lo in range(0, len(names), self.batch):
            part = names[lo : lo + self.batch]
            ids = np.zeros((len(part), WIDTH), np.int16)
            for j, w in enumerate(part):
                ids[j, : len(w)] = char_ids(w)
            paths = self.net.decode(ids)
            for j in np.flatnonzero((paths > 0).any(1)):
                spans = _runs(paths[j], len(part[j]))
                for i, at in where[part[j]]:
                    for k, s, e in spans:
                        cut = (s == 0 and at > 0) or (e == len(part[j]) and at + e < len(texts[i]))
                        found[i].append((cut, s - e, at + s, k, at + e))
        return [_reconcile(t, f, b) for t, f, b in zip(texts, found, base, strict=True)]

    def spans(self, texts: list[str | None]) -> tuple[list[list], list[list]]:
        """Base spans and all spans, as (start, kind, end)."""
        texts = [t or "" for t in texts]
        base: list[list] = []
        whole: list[list] = []
        for lo in range(0, len(texts), 256):
            part = texts[lo : lo + 256]
            b = [base_spans(t) for t in part]
            base += b
            whole += [sorted(x + y) for x, y in zip(b, self.added(part, b), strict=True)]
        return base, whole


def _runs(path: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    out, t = [], 0
    while t < n:
        if path[t] % 2 == 1:
            k, s = int(path[t]) // 2, t
            t += 1
            while t < n and path[t] == 2 * k + 2:
                t += 1
            out.append((k, s, t))
        else:
            t += 1
    return out


def _edges(text: str, found: tuple) -> list[tuple]:
    """A found address from its first to its last character, where the network began or ended it
    among the words around it; other spans as they are."""
    cut, _, s, k, e = found
    lo = max(0, s - STRIDE)
    whole = [m.span() for m in _ADDRESS.finditer(text, lo, e + STRIDE) if s < m.end("at") and m.start("at") < e] if k == 0 else []
    return [(cut, a - b, a, k, b) for a, b in whole] or [found]


def _reconcile(text: str, found: list, base: list) -> list[tuple[int, int, int]]:
    # spans so far, those of the base (which may overlap) as their unions: starts and ends ascend
    starts, ends, out = [], [], []
    for s, _, e in sorted(base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for _, _, s, k, e in sorted({y for x in set(found) for y in _edges(text, x)}):
        while s < e and text[s] in " \t\n,;:":
            s += 1
        while e > s and text[e - 1] in " \t\n,;:.":
            e -= 1
        word = (s > 0 and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum())
        at = bisect_right(ends, s)
        if s < e and not word and (at == len(starts) or e <= starts[at]) and plausible(k, text[s:e]):
            starts.insert(at, s)
            ends.insert(at, e)
            out.append((s, k, e))
    return out


def _variants(rng: np.random.Generator) -> tuple[int, str]:
    """A written variant of a kind of data."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda a, b: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(a, b))))
    kind = int(rng.integers(0, 4))
    if kind == 0:
        ways = [("@", "."), (" @ ", "."), (" @ ", " . "), ("(at)", "."), ("[at]", "."), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), (" [at] ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] ")]
        at, dot = ways[rng.integers(0, len(ways))]
        local = word(3, 9) + ("", "." + digits(2), "." + word(2, 8))[rng.integers(0, 3)]
        return 0, f"{local}{at}{word(3, 8)}{digits(1) if rng.random() < 0.5 else ''}{dot}{word(2, 8)}" + (f"{dot}com" if rng.random() < 0.5 else "")
    if kind == 1:
        return 1, [".", " . ", "[.]", "."][rng.integers(0, 4)].join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        d = "4" + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return 2, ["", " ", "-", ".", "/"][rng.integers(0, 5)].join([d[:4], d[4:8], d[8:12], d[12:]])
    a, b, c = digits(3), digits(3), digits(4)
    return 3, [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"00{digits(2)} {a} {b} {c}"][rng.integers(0, 6)]


def _examples(texts: list[str], n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of 64 characters and their tags: half around data of the sample (or any place that
    has a digit or an address written with at), half with a variant set into text."""
    rng, size = np.random.default_rng(seed), 64
    ids, tags = np.zeros((n, size), np.int16), np.zeros((n, size), np.int8)
    letters = list("eetaoinshrdlu     ")
    plain = [t for t in texts if len(t) > 80] or ["".join(rng.choice(letters, 400)) for _ in range(40)]
    marked = [(t, base_spans(t) + [(m.start(), 0, m.end()) for m in _WHOLE_ADDRESS.finditer(t) if m["at"] != "@"]) for t in plain if _TRIGGER.search(t)]
    for r in range(n):
        mark = []
        if r % 2 and marked:
            t, spans = marked[rng.integers(0, len(marked))]
            hits = [m.start() for m in _TRIGGER.finditer(t)]
            at = max(0, int(hits[rng.integers(0, len(hits))]) - int(rng.integers(0, size)))
            piece = t[at : at + size]
            mark = [(s - at, k, e - at) for s, k, e in spans if s < at + size and e > at]
        else:
            t = plain[rng.integers(0, len(plain))]
            at = int(rng.integers(0, len(t)))
            left, right = t[max(0, at - int(rng.integers(0, 50))) : at], t[at : at + size]
            if rng.random() < 0.2:  # a number that is no such data
                piece = f"{left} {''.join(map(str, rng.integers(0, 10, int(rng.integers(1, 9)))))} {right}"[:size]
            else:
                k, s = _variants(rng)
                piece = f"{left} {s} {right}"[:size]
                mark = [(len(left) + 1, k, len(left) + 1 + len(s))]
        ids[r, : len(piece)] = char_ids(piece)
        for s, k, e in mark:
            if s < len(piece):
                tags[r, max(s, 0) : e] = 2 + 2 * k
                tags[r, max(s, 0)] = 1 + 2 * k
    return ids, tags


def fit(texts: list[str], steps: int = 350, batch: int = 64, seed: int = 3) -> Network:
    net = Network.new(seed)
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    ids, tags = _examples(texts, steps * batch // 3, seed)
    order = np.random.default_rng(seed)
    for step in range(1, steps + 1):
        at = order.integers(0, len(ids), batch)
        _, grads = net.gradients(ids[at], tags[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * (1 - step / (steps + 1)) + 1e-3
        for p, g, a, b in zip(net.params(), grads, m, v, strict=True):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = 800, longest: int = 20_000) -> Network:
    """Fits on about ``rows`` documents of at most ``longest`` characters that hold what a span must hold."""
    use = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("length(t) between 1 and %d" % longest).where(F.col("t").rlike(_TRIGGER.pattern))
    return fit(sorted({r.t for r in bounded_sample(use, "k", rows).select("t").collect()}))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the union goes."""
    out, end = [], 0
    for s, k, e in spans:
        if s >= end:
            out += [text[end:s], f"<{KINDS[k].upper()}>"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def find(docs: DataFrame, net: Network, text: str = "text", out: str = "pii") -> DataFrame:
    """The input with a struct column ``out``: base and spans (strings), the base counts n_email,
    n_ip, n_card, n_phone, and redacted (null for a null text). A column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    counts = [f"n_{k}" for k in KINDS]

    @F.pandas_udf("base string, spans string, " + ", ".join(f"{c} long" for c in counts) + ", redacted string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for col in parts:
                texts = [t if isinstance(t, str) else None for t in col]
                base, whole = Finder(sent.value).spans(texts)
                rows = [(joined(b), joined(w), *[sum(k == j for _, k, _ in b) for j in range(4)], None if t is None else redact(t, w)) for t, b, w in zip(texts, base, whole, strict=True)]
                yield pd.DataFrame(rows, columns=["base", "spans", *counts, "redacted"])
        finally:
            tidy()

    return docs.withColumn(out, run(F.col(f"`{text}`")))
