"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

A suffix automaton of all vocabulary strings is read along a pre-token; at every byte it gives the
tokens that end there. The last token of a prefix is the one of them that is compatible with the
last token of the prefix before it: two tokens are compatible if encoding their joined bytes gives
back the pair. Exactly one is, so one array of last tokens holds the encoding of every prefix, and
the back-pointers (a token's length) give the ids.

The automaton is built once on the driver from the vocabulary file and sent as three arrays of a
size given by the vocabulary. Pre-tokens are memoised in a bounded table.

Defined cases: null and empty texts have no ids and an empty decoding; added tokens in a text get
their own id, as the file says; texts and single pre-tokens of any length take linear time; equal
rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretoken import Memo, Splitter, added_tokens, byte_chars


def suffix_automaton(words: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Generalised automaton of ``words``: (state * 256 + byte) and target of every transition, and
    for every state its link, longest length and the token that is its longest string, or -1. A
    token is a word of its own, so it is always the longest string of its state."""
    nxt: list[dict[int, int]] = [{}]
    link, length, token = [-1], [0], [-1]

    def new(n: int, edges: dict[int, int]) -> int:
        nxt.append(edges)
        length.append(n)
        link.append(-1)
        token.append(-1)
        return len(nxt) - 1

    def split(p: int, c: int, q: int) -> int:
        clone = new(length[p] + 1, dict(nxt[q]))
        link[clone], link[q] = link[q], clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    for word, ident in words:
        last = 0
        for c in word:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else split(last, c, q)
                continue
            cur, p = new(length[last] + 1, {}), last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p < 0:
                link[cur] = 0
            else:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else split(p, c, q)
            last = cur
        token[last] = ident
    keys = np.fromiter((s << 8 | c for s, e in enumerate(nxt) for c in e), np.int64)
    to = np.fromiter((t for e in nxt for t in e.values()), np.int32)
    return keys, to, np.array(link, np.int32), np.array(length, np.int32), np.array(token, np.int32)


@dataclass
class Vocabulary:
    """What a byte-level BPE file says, and the automaton."""

    strings: list[bytes]
    parts: dict[int, tuple[int, int]]  # of a merged token
    rank: dict[int, int]  # of the merge that makes it; single bytes have -1
    merged: dict[tuple[int, int], int]  # rank of a pair's merge
    added: dict[str, int]
    automaton: tuple = field(repr=False)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        model, chars, added = json.loads(spec)["model"], byte_chars(), added_tokens(spec)
        ids = model["vocab"]
        strings = [b""] * (1 + max([*ids.values(), *added.values()]))
        for s, i in ids.items():
            strings[i] = s.encode() if s in added else bytes(chars[c] for c in s)
        for s, i in added.items():
            strings[i] = s.encode()
        parts, rank, merged = {}, {i: -1 for s, i in ids.items() if len(s) == 1}, {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (ids[a], ids[b]), ids[a + b]
            merged[pair] = r
            if whole not in parts:
                parts[whole], rank[whole] = pair, r
        words = [(strings[i], i) for i in rank]
        return cls(strings, parts, rank, merged, added, suffix_automaton(words))


class Encoder:
    """Per worker: lookups made from a vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v = v
        keys, to, link, length, token = v.automaton
        self.step = dict(zip(keys.tolist(), to.tolist(), strict=True))
        self.link, self.length, self.token = link.tolist(), length.tolist(), token.tolist()
        # the nearest state along the links, itself included, that holds a token
        near, order = list(range(len(self.link))), np.argsort(length, kind="stable").tolist()
        for s in order:
            if self.token[s] < 0 and s:
                near[s] = near[self.link[s]]
        self.near, self.fits = near, {}
        self.splitter = Splitter(v.added, Memo(self.word))

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b joined encode to the pair (a, b): taking their merges
        back in reverse order of time, the pair at the seam must never have had an earlier merge."""
        rank, parts, merged = self.v.rank, self.v.parts, self.v.merged
        limit = 1 << 60
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, parts[a][1]
            elif rb >= 0:
                limit, b = rb + 1, parts[b][0]
            else:
                return True

    def word(self, text: str) -> bytes:
        """The ids of one pre-token."""
        w = text.encode("utf-8", "surrogatepass")
        step, link, length, token, near, fits, strings = self.step, self.link, self.length, self.token, self.near, self.fits, self.v.strings
        last, state, size = [-1], 0, 0
        for i, c in enumerate(w, 1):
            to = step.get(state << 8 | c)
            while to is None:
                state = link[state]
                size = length[state]
                to = step.get(state << 8 | c)
            state, size = to, size + 1
            at = near[state] if size == length[state] else near[link[state]]
            while True:  # every token that ends here, the longest first
                t = token[at]
                before = last[i - len(strings[t])]
                if before < 0:
                    if i == len(strings[t]):
                        break
                else:
                    ok = fits.get((before, t))
                    if ok is None:
                        if len(fits) > 2_000_000:
                            fits.clear()
                        ok = fits[before, t] = self.compatible(before, t)
                    if ok:
                        break
                at = near[link[at]]
            last.append(t)
        out, i = [], len(w)
        while i:
            out.append(last[i])
            i -= len(strings[last[i]])
        return np.array(out[::-1], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.splitter.encode(text) if text else b""

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _encoder(v: Vocabulary) -> Encoder:
    """The worker's encoder, kept with the broadcast vocabulary."""
    if getattr(v, "encoder", None) is None:
        v.encoder = Encoder(v)
    return v.encoder


_vocabularies: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary.load(path)
    return _vocabularies[path]


def encode_decode(docs: DataFrame, path: str, text: str = "text", digests: bool = False) -> DataFrame:
    """The input with ``ids`` (array<int>) and ``decoded``; with ``digests`` instead n_tokens,
    ids_sha256 and decoded_sha256 of them. Columns of these names are replaced."""
    from hashlib import sha256

    sent = docs.sparkSession.sparkContext.broadcast(load(path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    def run(col: pd.Series) -> pd.DataFrame:
        e, rows = _encoder(sent.value), []
        for t in col:
            ids = e.encode(t)
            back = e.decode(ids)
            if digests:
                rows.append((len(ids) // 4, sha256(ids).hexdigest(), sha256(back.encode()).hexdigest()))
            else:
                rows.append((np.frombuffer(ids, "<u4").astype(np.int32), back))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])

    names = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    out = docs.withColumn("__bpe", run(F.col(f"`{text}`")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], *[F.col("__bpe")[n].alias(n) for n in names])
