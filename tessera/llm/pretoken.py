"""Byte-level pre-tokens and a bounded memo of their ids."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import regex

#: The published split pattern of the byte-level BPE vocabularies (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT, LONGEST = 400_000, 200


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for: printable bytes for
    themselves, the others from code point 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """Ids of pre-tokens as little-endian unsigned 32-bit integers. Two generations of ``LIMIT``
    entries bound the memory: what the older one holds and is used again moves to the newer."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
            if len(word) > LONGEST:
                return ids
        if len(self) >= LIMIT:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Splitter:
    """Cuts a text at added tokens, then into pre-tokens, and joins the memo's ids."""

    def __init__(self, added: dict[str, int], memo: Memo):
        self.added = {k: np.uint32(v).tobytes() for k, v in added.items()}
        self.cut = regex.compile("|".join(regex.escape(k) for k in sorted(added, key=len, reverse=True))) if added else None
        self.words, self.memo = regex.compile(PATTERN), memo

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.words.findall(text)))

    def encode(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


def added_tokens(spec: str) -> dict[str, int]:
    return {x["content"]: x["id"] for x in json.loads(spec).get("added_tokens", [])}
