"""Quality rules as a short-circuit cascade, DataFrame expressions only.

``features`` computes the base counts of every whole text. ``RULES`` reject documents by further
ratios. ``plan_cascade`` measures each rule on a bounded sample (seconds a document, share
rejected) and orders the rules by rejection per cost; ``judge`` evaluates them in this order inside
one CASE, so a document that a rule rejects is not shown to the later rules. The order changes the
time, never a verdict.

Defined cases: a null text counts as empty; an empty text has zero counts, fails the base rule and
is not kept; rows with equal ids are judged each for itself; an empty table gives an empty result
and the rules in their written order; further columns of the input pass through ``judge``
untouched, and columns that have an output's name are replaced.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

log = logging.getLogger(__name__)

#: ASCII white space, the separators of words
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, size: int = 5) -> Column:
    """Words that lie in windows of ``size`` words found twice or more, the first included.

    Windows are compared by a 64-bit hash chained over their words. Texts whose windows are all
    distinct end after one hash set; the others sort (hash, start) and keep starts whose neighbour
    has the same hash, so a text of n words costs n log n.
    """

    def starts(h: Column) -> Column:
        def pick(s: Column) -> Column:
            same = lambda x, k, j: (k + j >= 0) & (k + j < F.size(s)) & (F.get(s, k + j)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["i"]))

        return bound(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), pick)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - x, F.lit(size))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(starts(h), covered)))

    return F.when(F.size(words) <= size, F.lit(0)).otherwise(bound(words, counted))


def features(text: Column) -> Column:
    """The base counts as a struct of longs."""
    t = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return (F.size(x) - F.size(F.array_distinct(x))).cast("long")

    inner = bound(words_of(t), of_words)
    return F.struct(
        inner.alias("w"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines_of(t), of_lines).alias("n_dup_lines"),
    )


@dataclass(frozen=True)
class Rule:
    """``failed`` gets the text (never null) and the base counts by name; true rejects."""

    name: str
    failed: object


def _share(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


#: Limits as of the published web-corpus filters, on ratios of whole texts
RULES = (
    Rule("symbol_ratio", lambda t, f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("word_length", lambda t, f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"])),
    Rule("duplicate_lines", lambda t, f: 10 * f["n_dup_lines"] > 3 * F.size(lines_of(t))),
    Rule("upper_case", lambda t, f: 2 * _share(t, r"\p{Lu}") > f["word_chars"]),
    Rule("letters", lambda t, f: 2 * _share(t, r"\p{L}") < f["word_chars"]),
    Rule("ellipsis_lines", lambda t, f: 10 * F.size(F.filter(lines_of(t), lambda x: F.rtrim(x).endswith("..."))) > 3 * F.size(lines_of(t))),
    Rule("bullet_lines", lambda t, f: 10 * F.size(F.filter(lines_of(t), lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))) > 9 * F.size(lines_of(t))),
)


def base_failed(f) -> Column:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """The input with the base counts, as columns that replace any of the same name."""
    made = {"__quality", *FEATURES}
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made or c == text], features(F.col(f"`{text}`")).alias("__quality"))
    q = F.col("__quality")
    rest = [F.col(f"`{c}`") for c in own.columns if c != "__quality"]
    return own.select(*rest, q["w"]["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"), q["w"]["n_repeat_words"].alias("n_repeat_words"))


def plan_cascade(docs: DataFrame, text: str = "text", key: str = "doc_id", rules=RULES, rows: int = 400, copies: int = 16) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a document, share rejected) in the order of falling rejection per cost,
    measured on a sample of about ``rows`` documents (the only part that does not see all
    documents). A rule's cost is the time of a job that evaluates it ``copies`` times on every
    document of the sample, less that of the same job without a rule."""
    sample = _counted(bounded_sample(docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")), key, rows), "text").persist()
    try:
        total = sample.count()
        if not total:
            return [(r, 0.0, 0.0) for r in rules]
        f = {k: F.col(k) for k in FEATURES}
        shares = sample.agg(*[F.avg(r.failed(F.col("text"), f).cast("double")).alias(r.name) for r in rules]).first()
        many = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

        def seconds(condition: Column) -> float:
            began = time.perf_counter()
            many.agg(F.count_if(condition)).first()
            return time.perf_counter() - began

        idle = seconds((F.col("copy") > 0) & (F.length("text") >= 0) & (F.col("n_words") >= 0))
        out = [(r, max(seconds(r.failed(F.col("text"), f)) - idle, 0.0) / (copies * total), float(shares[r.name] or 0.0)) for r in rules]
    finally:
        sample.unpersist()
    out = sorted(out, key=lambda x: (-x[2] / max(x[1], 1e-8), x[1], x[0].name))
    log.info("cascade: %s", ", ".join(f"{r.name} ({1e6 * s:.1f} us, {share:.3f} rejected)" for r, s, share in out))
    return out


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", rules=RULES, order=None) -> DataFrame:
    """The input with the base counts, ``base_failed`` and ``kept``."""
    order = [r for r, _, _ in plan_cascade(docs, text, key, rules)] if order is None else order
    df = _counted(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("base_failed", "kept")]), text)
    t, f = F.coalesce(F.col(f"`{text}`"), F.lit("")), {k: F.col(k) for k in FEATURES}
    verdict = F.when(base_failed(f), False)
    for r in order:
        verdict = verdict.when(r.failed(t, f), False)
    return df.withColumn("base_failed", base_failed(f)).withColumn("kept", verdict.otherwise(True))
