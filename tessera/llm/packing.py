"""Packing token sequences by minimum bin slack.

Each document's ids are cut into pieces of at most ``capacity``; of a longer document the first
piece takes the remainder, so that all others are full. A piece's length is all that matters for
packing, so the plan is made on the driver from the counts of the at most ``capacity`` lengths:
take the longest piece left, find by a bitset subset-sum over the lengths left the combination that
fills its bin fullest, repeat it as often as the counts allow, remove it, go on. Each combination
uses up a length (or brings its count below what one bin takes of it), so the plan's size depends
on ``capacity`` alone. Pieces find their place by their rank among those of their length, from
counts of each written part and length; no group is ever gathered.

Defined cases: a null text is empty; an empty text is the end token alone; a document of exactly
``capacity`` is one full piece; pieces of equal length are interchangeable; null or repeated ids
are packed row by row; runs of any length of blanks, digits or letters are encoded whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, frame, ids_of
from .common import with_ids as keyed
from .pretoken import PATTERN, added_tokens, byte_chars


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the greatest sum up to ``room``: longer lengths
    are tried first, so small ones are left for later bins."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for n in sorted((n for n in counts if n <= room), reverse=True):
        left, k = min(counts[n], room // n), 1
        while left > 0:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + k
            at -= n * k
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, number of bins) until no piece is left."""
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        top = max(left)
        left[top] -= 1
        mix = fullest({n: c for n, c in left.items() if c}, capacity - top)
        left[top] += 1
        mix[top] = mix.get(top, 0) + 1
        times = min(left[n] // m for n, m in mix.items())
        for n, m in mix.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
        out.append((mix, times))
    return out


def places(steps: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length its ranges of ranks: first rank, pieces in a bin, first bin, first offset."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    bins = 0
    for mix, times in steps:
        offset = 0
        for n, m in mix.items():
            rows.setdefault(n, []).append((used.get(n, 0), m, bins, offset))
            used[n] = used.get(n, 0) + m * times
            offset += n * m
        bins += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


_encoders: dict[int, Callable[[str], bytes]] = {}


def ranked(spec: str) -> dict[bytes, int] | None:
    """Byte strings by id of a byte-level BPE file whose ids follow the order of its merges; None
    of any other file."""
    data = json.loads(spec)
    model, chars, added = data["model"], byte_chars(), added_tokens(spec)
    pre = data.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or data.get("normalizer"):
        return None
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocab[a + b] for a, b in merges]
    plain = {s: i for s, i in vocab.items() if s not in added}
    if order != sorted(order) or len(set(order)) != len(order) or len(plain) != 256 + len(order):
        return None
    return {bytes(chars[c] for c in s): i for s, i in plain.items()}


def encoder(spec: str) -> Callable[[str], bytes]:
    """Text to the ids that the tokenizers library gives (without special tokens around the text),
    as little-endian unsigned 32-bit integers. A byte-level file in merge order is run by
    tiktoken's merger, which gives the same ids in a quarter of the time; any other file, and a
    text that its pattern engine gives up on (a very long run of blanks), by tokenizers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library: list = []

    def plain(text: str) -> bytes:
        if not library:
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_str(spec))
            library[0].no_truncation()
            library[0].no_padding()
        return np.array(library[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    ranks = ranked(spec)
    if ranks is None:
        return plain
    import tiktoken

    enc = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(spec))

    def fast(text: str) -> bytes:
        try:
            return enc.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:
            return plain(text)

    return fast


def _encoder(spec: str) -> Callable[[str], bytes]:
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = encoder(spec)
    return _encoders[key]


def _pieces(batches: Iterator[pd.DataFrame], spec, capacity: int, end: int, with_ids: bool) -> Iterator[pd.DataFrame]:
    encode, tail, part = _encoder(spec.value), np.uint32(end).tobytes(), TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for pdf in batches:
        rows = []
        for doc, text in zip(ids_of(pdf), pdf["t"].tolist(), strict=True):
            ids = (encode(text) if text else b"") + tail
            n = len(ids) // 4
            s, p = 0, 0
            while s < n:
                m = (n % capacity or capacity) if p == 0 else capacity
                rank = seen.get(m, 0)
                seen[m] = rank + 1
                own = ids[4 * s : 4 * (s + m)]
                rows.append((doc, p, s, m, zlib.crc32(own), part, rank, *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else [])))
                s, p = s + m, p + 1
        yield frame(rows, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if with_ids else [])], ("doc_id",))


def pack(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``) of each piece.
    ``spec`` is the text of a tokenizer file."""
    spark = docs.sparkSession
    scratch, sent = Scratch(spark), spark.sparkContext.broadcast(spec)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids
    own = keyed(docs, key, t=F.col(f"`{text}`"))
    pieces = scratch.save(own.mapInPandas(lambda it: _pieces(it, sent, capacity, end, with_ids), schema))
    counted = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for m in np.unique(n):
            t, at = table.value[int(m)], np.flatnonzero(n == m)
            row = t[np.searchsorted(t[:, 0], r[at], "right") - 1]
            q = r[at] - row[:, 0]
            seq[at] = row[:, 2] + q // row[:, 1]
            off[at] = row[:, 3] + q % row[:, 1] * m
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select("length", "part", F.coalesce(before, F.lit(0)).alias("skip"))
    out = pieces.join(starts, ["length", "part"]).withColumn("p", place("length", F.col("rank") + F.col("skip")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("p.sequence_id").alias("sequence_id"), F.col("p.offset").alias("offset"), *(["ids"] if with_ids else []))
