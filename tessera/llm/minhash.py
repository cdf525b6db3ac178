"""Near-duplicate documents by min-max hashing, with links confirmed on full shingle sets.

Under each of ``perms`` permutations a document keeps both its minimum and its maximum, so half the
hash evaluations give as many signature values; bands of four permutations (eight values) make the
bucket keys. The number of bands follows from the threshold; with 50 bands a pair at similarity 0.8 shares a bucket with probability 0.9999, one at
0.3 (texts that share a passage) with 0.003.

1. Documents of equal shingle sets collapse to their smallest id (sets agree by 128-bit digest).
2. The sets, and longer one-byte signatures, of documents that share a bucket are made in a second
   pass over the texts, which a Bloom filter of at most ``FILTER_BITS`` bits restricts to them.
3. In each bucket one member is the hub (first the one with most bucket mates, then by salted
   hashes); documents of other components are checked against the hubs that they meet most often.
   Hubs come from grouped maxima, never from gathered groups. Rounds go on while they find links
   and more pairs of different components share buckets than a multiple of the documents concerned.
4. Buckets that still hold several components are compared in blocks of bounded size on the long
   signatures; pairs of different components that can reach the threshold go to the check.
5. A pair links if 100 * |A & B| >= percent * |A | B| on the full sets. Components follow.

Steps 3 and 4 lose no link that meets in a bucket except where it would join what is joined already,
or where a signature of 1024 values lies ``DEVIATIONS`` standard deviations too low.

Defined cases: null and empty texts and texts without words have empty sets and link with nothing;
a text of fewer than k words is one shingle of all its words; rows of equal id are one document;
rows with a null id link with nothing, have a null component and are kept; an empty table gives an
empty result; only the id and text columns are read; texts of any length are hashed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, Bloom, Scratch, components, frame, hits, ids_of, tidy, with_ids

PER_BAND, BLOCK, PART, CHUNK = 4, 1024, 512, 1 << 19
LONG, ROUNDS, MISSED, DEVIATIONS = 512, 6, 1.1e-4, 4.0
U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(n, U(base))
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=U)
    return _powers["up"], _powers["down"]


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    lo = 0
    while lo < len(raw):
        hi, size = lo, 0
        while hi < len(raw) and (hi == lo or size + len(raw[hi]) < CHUNK):
            size += len(raw[hi]) + 1
            hi += 1
        buf = np.frombuffer(b"\n".join(raw[lo:hi]) + b"\n", np.uint8)
        at = np.cumsum([0, *(len(r) + 1 for r in raw[lo:hi])])
        blank = _BLANK[buf]
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        s, e = edge[0::2], edge[1::2]
        up, down = _pow(len(buf) + 1)
        total = np.zeros(len(buf) + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=total[1:])
        h = _mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * U(0xD1342543DE82EF95))
        first = np.searchsorted(s, at)
        acc = h.copy()
        for j in range(1, k):
            acc[: len(h) - j] = _mix(acc[: len(h) - j] * U(0xA0761D6478BD642F) + h[j:] + U(j))
        for d in range(hi - lo):
            a, b = first[d], first[d + 1]
            if b - a >= k:
                yield np.unique(acc[a : b - k + 1])
            elif b > a:
                yield np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=int(b - a))], U)
            else:
                yield np.empty(0, U)
        lo = hi


def permutations(percent: int) -> int:
    """How many permutations it takes that a pair at the threshold shares no bucket with a
    probability of at most ``MISSED``: 200 for 80."""
    j = percent / 100
    if j >= 1:
        return PER_BAND
    return PER_BAND * math.ceil(math.log(MISSED) / math.log1p(-(j ** (2 * PER_BAND))))


def least_share(percent: int, deviations: float = DEVIATIONS) -> float:
    """The share of equal values of the long signatures from which a pair is checked: ``deviations``
    standard deviations below the threshold; with infinitely many, every pair is checked."""
    j = percent / 100
    return j - deviations * math.sqrt(j * (1 - j) / (2 * LONG)) if math.isfinite(deviations) else -1.0


def _perms(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U) * U(2) + U(1)
    return draw()[:, None], draw()[:, None]


def min_max(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a non-empty set under each permutation."""
    lows, highs = [], []
    for i in range(0, len(values), 4096):
        x = values[None, i : i + 4096] * a
        x += b
        lows.append(x.min(1))
        highs.append(x.max(1))
    return np.min(lows, 0), np.max(highs, 0)


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _signed(batches: Iterator[pd.DataFrame], k: int, perms: int) -> Iterator[pd.DataFrame]:
    a, b = _perms(perms)
    salt = _mix(np.arange(1, perms // PER_BAND + 1, dtype=U))
    w = _perms(2 * PER_BAND, 23)[0][:, 0]
    for pdf in batches:
        ids = ids_of(pdf)
        for lo in range(0, len(ids), 500):
            rows = []
            part = ids[lo : lo + 500]
            for i, v in zip(part, shingle_sets(pdf["t"].iloc[lo : lo + 500].tolist(), k), strict=True):
                if not len(v):
                    rows.append((i, 0, None, None, None))
                    continue
                low, high = min_max(v, a, b)
                both = np.stack([low, high], 1)
                keys = _mix((both.reshape(-1, 2 * PER_BAND) * w).sum(1) + salt)
                d = np.frombuffer(xxhash.xxh3_128_digest(v.tobytes()), np.int64)
                rows.append((i, len(v), int(d[0]), int(d[1]), _as_long(keys)))
            yield frame(rows, ["id", "n", "f1", "f2", "keys"], ("id", "f1", "f2"))


def _sets(batches: Iterator[pd.DataFrame], k: int, wanted) -> Iterator[pd.DataFrame]:
    """The set of each text whose id passes the Bloom filter, and a signature of 2 * ``LONG`` bytes."""
    a, b = _perms(LONG, 31)
    for pdf in batches:
        pdf = pdf[hits(wanted.value, pdf["places"])]
        for lo in range(0, len(pdf), 500):
            part, rows = pdf.iloc[lo : lo + 500], []
            for i, v in zip(part["id"].tolist(), shingle_sets(part["t"].tolist(), k), strict=True):
                if len(v):
                    both = np.stack(min_max(v, a, b), 1).ravel()
                    rows.append((i, len(v), _as_long(v), (_mix(both) >> U(56)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "n", "s", "sig"])


def _block_pairs(batches: Iterator[pd.DataFrame], percent: int, floor: float) -> Iterator[pd.DataFrame]:
    """Pairs of different components in each block pair; rows come sorted by (key, lo, hi)."""

    def compare(g: pd.DataFrame) -> pd.DataFrame | None:
        if len(g) < 2:
            return None
        sig = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(len(g), -1)
        ids, comp, n, blk = (g[c].to_numpy() for c in ("id", "comp", "n", "blk"))
        keys = np.stack(g["keys"].to_list())
        band = int((keys == g["key"].iloc[0]).any(0).argmax())
        found = []
        left = np.flatnonzero(blk == g["lo"].iloc[0])
        right = np.flatnonzero(blk == g["hi"].iloc[0])
        for i in left:
            r = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            if g["lo"].iloc[0] == g["hi"].iloc[0]:
                r = r[r > i]
            if len(r):
                # a pair that shares several buckets is taken in that of its first common band
                r = r[(keys[r] == keys[i]).argmax(1) == band]
                r = r[(sig[r] == sig[i]).mean(1) >= floor]
                found += [(ids[i], ids[j]) for j in r]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64") if found else None

    for out in map(compare, whole_groups(batches, ["key", "lo", "hi"])):
        if out is not None:
            yield out


def _tidied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        yield from frames
    finally:
        _powers.clear()
        tidy()


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by ``keys``; one group is held at a time."""
    carry: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(pdf)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            part = pdf.iloc[s:e]
            if carry and s == 0 and (carry[0][keys].iloc[0].to_numpy() != k[0]).any():
                yield pd.concat(carry, ignore_index=True)
                carry = []
            if s > 0:
                yield pd.concat(carry, ignore_index=True) if len(carry) > 1 else carry[0]
                carry = []
            carry.append(part)
    if carry:
        yield pd.concat(carry, ignore_index=True)


def confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, hub, size) that reach the threshold on the full sets. The hub, one of
    the two, may be in about ``size`` pairs: its set is sent once to each part of them, so that the
    sets of a hub's pairs are spread over as many tasks."""
    other = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    p = pairs.select("hub", other.alias("id"), F.ceil(F.col("size") / PART).alias("parts"))
    hubs = p.groupBy("hub").agg(F.max("parts").alias("parts")).join(sets.select(F.col("id").alias("hub"), F.col("s").alias("sh")).hint("merge"), "hub")
    hubs = hubs.select("hub", "sh", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    p = p.select("hub", "id", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    both = p.join(sets.select("id", "s").hint("merge"), "id").join(hubs.hint("merge"), ["hub", "part"])
    sized = both.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"), F.size(F.array_intersect("s", "sh")).alias("i"), (F.size("s") + F.size("sh")).alias("u"))
    return sized.where((F.col("i") > 0) & (100 * F.col("i").cast("long") >= percent * (F.col("u") - F.col("i")).cast("long"))).select("a", "b").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _parts(rows: DataFrame) -> DataFrame:
    """Rows (id, c, ...) of buckets of c rows, in parts of about ``PART`` of them: a join by bucket
    and part has no large key."""
    return rows.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / PART)))


def _every_part(buckets: DataFrame) -> DataFrame:
    """What is known of a bucket (of c rows), once for each of its parts."""
    return buckets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / PART) - 1))).drop("c")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, block: int = BLOCK, deviations: float = DEVIATIONS) -> DataFrame:
    """id, n_shingles, component_id, kept: one row for each row of ``docs``. The numbers of
    permutations and the bound of step 4 follow from ``percent``; ``block`` bounds the rows of one
    side of a comparison in step 4. ``deviations`` infinite: no pair that shares a bucket is left out
    of the check on full sets by its signature."""
    if not 50 <= percent <= 100:
        raise ValueError("percent lies between 50 and 100")
    perms, floor = permutations(percent), least_share(percent, deviations)
    scratch = Scratch(docs.sparkSession)
    docs = with_ids(docs, key, t=F.col(f"`{text}`"))
    signed = scratch.save(docs.mapInPandas(lambda it: _tidied(_signed(it, k, perms)), "id long, n long, f1 long, f2 long, keys array<long>"))
    full = signed.where("n > 0 and id is not null")
    heads = full.groupBy("f1", "f2").agg(F.min(F.struct("id", "keys")).alias("h")).select("f1", "f2", F.col("h.id").alias("rep"), F.col("h.keys").alias("keys"))
    heads = scratch.save(heads)
    rows = heads.select(F.explode("keys").alias("key"), F.col("rep").alias("id"))
    many = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    many = scratch.save(many)
    # a merge of two plain shuffles: adaptive execution splits the partition of a large bucket
    met = scratch.save(rows.join(many.hint("merge"), "key"))
    scratch.drop(many)
    bloom = Bloom(met.select("id").distinct(), FILTER_BITS)
    wanted = bloom.sent
    sets = scratch.save(docs.where("not none").select("id", "t", bloom.places("id").alias("places")).mapInPandas(lambda it: _tidied(_sets(it, k, wanted)), "id long, n long, s array<long>, sig binary"))
    mates = met.groupBy("id").agg(F.sum("c").alias("p"))
    links = seen = joined = None
    here = met.withColumn("comp", F.col("id"))  # rows of buckets that hold several components
    gained = 1.0
    for turn in range(ROUNDS):
        if turn:
            load = here.groupBy("key").agg(F.count("*").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"), F.sum("m").alias("rows")).first()
            if not load["rows"] or load["pairs"] <= 16 * load["rows"] or gained < 0.05:
                break
        scored = here.join(mates, "id") if turn == 0 else here.withColumn("p", F.xxhash64("id", F.lit(turn)))
        hubs = scored.groupBy("key").agg(F.max(F.struct("p", "id", "comp")).alias("h"), F.max("c").alias("c")).select("key", "c", F.col("h.id").alias("hub"), F.col("h.comp").alias("hub_comp"))
        shared = _parts(here).join(_every_part(hubs), ["key", "part"]).where("comp != hub_comp").groupBy("id", "hub").agg(F.count("*").alias("n"), F.max("c").alias("size"))
        best = shared.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "hub", "size")), False), 1, 1 if turn == 0 else 3).alias("m"))  # at most one hub a band
        drawn = best.select(F.explode("m").alias("h"), "id").select(F.least("h.hub", "id").alias("a"), F.greatest("h.hub", "id").alias("b"), "h.hub", "h.size")
        pairs = drawn.groupBy("a", "b").agg(F.max(F.struct("size", "hub")).alias("h")).select("a", "b", "h.hub", "h.size")
        pairs = scratch.save(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"))
        found = scratch.save(confirm(sets, pairs, percent))
        gained = found.count() / max(pairs.count(), 1)
        links, seen = (found, pairs.select("a", "b")) if links is None else (links.union(found), seen.union(pairs.select("a", "b")))
        joined = components(scratch, links)
        now = here.drop("comp").join(joined.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "c", F.coalesce("root", "id").alias("comp"))
        open_ = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("c").alias("c")).where("x != y").select("key", "c")
        old, here = met, scratch.save(_parts(now).join(_every_part(open_), ["key", "part"]).drop("part"))
        scratch.drop(old)
        met = here

    blocks = F.ceil(F.col("c") / block).cast("long")
    split = (
        here.join(sets.select("id", "n", "sig").hint("merge"), "id")
        .join(heads.select(F.col("rep").alias("id"), "keys"), "id")
        .withColumn("blk", F.pmod(F.xxhash64("id"), blocks))
        .select("key", "id", "comp", "n", "sig", "keys", "blk", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("o"))
        .select("key", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"), "id", "comp", "n", "sig", "keys", "blk")
        .repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
    )
    more = _ordered(split.mapInPandas(lambda it: _tidied(_block_pairs(it, percent, floor)), "a long, b long"))
    more = scratch.save(more.join(seen, ["a", "b"], "left_anti"))  # read twice
    often = more.groupBy("a").agg(F.count("*").alias("size"))
    more_sized = more.join(often, "a").select("a", "b", F.col("a").alias("hub"), "size")
    extra = scratch.save(confirm(sets, scratch.save(more_sized), percent))
    scratch.drop(met, more, sets)
    final = joined if extra.isEmpty() else components(scratch, links.union(extra))
    labels = heads.select("f1", "f2", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("root", "rep").alias("label"))
    out = signed.select("id", "n", "f1", "f2").join(labels, ["f1", "f2"], "left")
    comp = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("label", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))
