"""URL rules in a sorted digest array.

A rule is a verdict for a host with all its subdomains and a path prefix. The table is three flat
files: 64-bit xxhash digests in order, places of the stored strings, and the strings themselves.
Executors get the files from the shared folder and map them into memory. A URL's keys (each suffix
of its host at a dot, with each prefix of its path of a length that the table has) are probed by
vectorised binary search; suffixes longer than the longest stored host are not made, as they can't
match, so that a host of any length costs no more than reading it; a hit counts only if the stored full string is equal, so colliding
digests cannot decide. The longest fitting rule wins; without one the default verdict holds, and a
URL without a host is blocked.

Defined cases: a null URL, or one without ``://``, has empty host and path and is blocked; hosts
are compared after lower-casing A-Z, paths as they are; a host with no path fits no rule, as rules'
paths begin with a slash; of repeated rules the last holds; equal URLs get equal rows; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import share_file

#: (verdict, host, path) of the registered query
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_URL = re.compile(r"\A.*?://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url: str | None) -> tuple[str, str]:
    m = _URL.match(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def build(rules) -> tuple[bytes, bytes, bytes]:
    """(digests, places, strings) of the table; a stored string is ``host path verdict`` by NUL."""
    rows = {(h.translate(_LOWER), p): v for v, h, p in rules}
    keyed = sorted((xxhash.xxh64_intdigest(f"{h}\0{p}"), f"{h}\0{p}\0{v}".encode()) for (h, p), v in rows.items())
    ends = np.cumsum([0, *(len(s) for _, s in keyed)]).astype(np.int64)
    return np.array([d for d, _ in keyed], np.uint64).tobytes(), ends.tobytes(), b"".join(s for _, s in keyed)


class Table:
    """The mapped files."""

    def __init__(self, digests: np.ndarray, places: np.ndarray, strings: np.ndarray, lengths: list[int], longest: int):
        self.digests, self.places, self.strings, self.lengths, self.longest = digests, places, strings, lengths, longest

    def stored(self, i: int) -> str:
        return bytes(self.strings[self.places[i] : self.places[i + 1]]).decode()

    def judge(self, urls: list[str | None], default: str) -> pd.DataFrame:
        split = [parts(u) for u in urls]
        keys, owner = [], []
        for i, (host, path) in enumerate(split):
            cuts = [n for n in self.lengths if n <= len(path)]
            at = 0 if len(host) <= self.longest else host.find(".", len(host) - self.longest - 1) + 1
            while cuts and host and len(host) - at <= self.longest:
                keys += [f"{host[at:]}\0{path[:n]}" for n in cuts]
                owner += [i] * len(cuts)
                at = host.find(".", at) + 1
                if not at:
                    break
        probe = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        rule: list[str | None] = [None] * len(urls)
        verdict = [default if h else "block" for h, _ in split]
        if len(self.digests):
            place = np.searchsorted(self.digests, probe)
            hits = np.flatnonzero(self.digests[np.minimum(place, len(self.digests) - 1)] == probe)
            for k in hits.tolist():
                j = int(place[k])
                while j < len(self.digests) and self.digests[j] == probe[k]:  # equal digests side by side
                    host, path, v = self.stored(j).split("\0")
                    i = owner[k]
                    if f"{host}\0{path}" == keys[k] and (rule[i] is None or len(host + path) > len(rule[i])):
                        rule[i], verdict[i] = host + path, v
                    j += 1
        return pd.DataFrame({"host": [h for h, _ in split], "path": [p for _, p in split], "rule": pd.Series(rule, dtype=object), "verdict": verdict})


def judge(pages: DataFrame, rules=RULES, default: str = "allow", url: str = "url", out: str = "judged") -> DataFrame:
    """The input with a struct column ``out``: host, path, rule, verdict. A column of that name is replaced."""
    spark = pages.sparkSession
    names = []
    for kind, data in zip(("digests", "places", "strings"), build(rules), strict=True):
        name = f"urls_{xxhash.xxh64_hexdigest(data)}.{kind}"
        spark.sparkContext.addFile(share_file(spark, name, data))
        names.append(name)
    lengths, longest, kinds = sorted({len(p) for _, _, p in rules}), max((len(h) for _, h, _ in rules), default=0), json.dumps(names)

    def mapped(name: str, kind) -> np.ndarray:
        path = SparkFiles.get(name)
        try:
            return np.memmap(path, kind, "r")
        except ValueError:  # an empty file can't be mapped
            return np.empty(0, kind)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def run(col: pd.Series) -> pd.DataFrame:
        d, p, s = json.loads(kinds)
        table = Table(mapped(d, np.uint64), mapped(p, np.int64), mapped(s, np.uint8), lengths, longest)
        return table.judge([u if isinstance(u, str) else None for u in col], default)

    return pages.withColumn(out, run(F.col(f"`{url}`")))
