"""Spelling variants of a lexicon by minimal acyclic automata read forward and backward.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Of a
word of ``L`` code points, either the first ``L // 2`` stand unchanged at the start of a near word,
or the rest stands unchanged at its end. So every word is dealt by its beginnings and by its endings
of the lengths that a near word may ask for; where words of one beginning meet, an automaton of them
is walked along the unchanged half exactly and on to the end with one error. For endings, words and
automaton are reversed, and what the forward automaton finds is left out. The automaton is minimal,
and its edges carry how many words go before, so that a walk ends with the number of the word found:
its place in the sorted list, which holds counts. Each task sums up its finds for a word (a number
and the best), so that no list of pairs is shuffled.

A beginning of more than ``block`` words is dealt to several automata, and those who ask go to each.

Defined cases: null texts have no words; a null word or count, and a count of the same word twice, is
left out or added up; words shorter than two code points have no half and are near to nothing;
an empty lexicon gives an empty result; forms lead to words of at least ``ratio`` times the count, so
that they end. ``ratio`` must be over 1.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of runs, as a character class
LETTERS = "A-Za-zÀ-ÿ"


class Automaton:
    """The minimal acyclic automaton of ``words``, which are distinct and in code-point order."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []  # by state: code point -> (state, words before)
        self.final: list[bool] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[list] = [[False]]  # open states: whether final, then code points and states in turn
        before = ""
        for w in words:
            k, most = 0, min(len(before), len(w))
            while k < most and before[k] == w[k]:
                k += 1
            self._close(path, before, k)
            for _ in range(k, len(w)):
                path.append([False])
            path[-1][0] = True
            before = w
        self._close(path, before, 0)
        self.start = self._state(path[0])
        del self._known

    def _close(self, path: list[list], word: str, depth: int) -> None:
        for i in range(len(path) - 1, depth, -1):
            path[i - 1] += (word[i - 1], self._state(path.pop()))

    def _state(self, own: list) -> int:
        key = tuple(own)
        at = self._known.get(key)
        if at is None:
            at = self._known[key] = len(self.edges)
            n, edges = int(own[0]), {}
            for c, t in zip(own[1::2], own[2::2], strict=True):
                edges[c] = (t, n)
                n += self.size[t]
            self.edges.append(edges)
            self.final.append(own[0])
            self.size.append(n)
        return at

    def _end(self, state: int, number: int, rest: str) -> int:
        """The number of the word that ends ``rest`` from here, or -1."""
        edges = self.edges
        for c in rest:
            step = edges[state].get(c)
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if self.final[state] else -1

    def number(self, word: str) -> int:
        return self._end(self.start, 0, word)

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with the first ``exact`` code points of ``word`` and
        differ from it by one error after these."""
        edges, end, out = self.edges, self._end, set()
        state, number = self.start, 0
        for c in word[:exact]:
            step = edges[state].get(c)
            if step is None:
                return out
            state, number = step[0], number + step[1]
        for i in range(exact, len(word) + 1):
            here, rest, after = word[i : i + 1], word[i:], word[i + 1 :]
            if here:
                out.add(end(state, number, after))
            for c, (to, skip) in edges[state].items():
                if c != here:  # an equal one is inserted further on, or is no error
                    out.add(end(to, number + skip, rest))
                    if here:
                        out.add(end(to, number + skip, after))
            step = edges[state].get(here)
            if step is None:
                break
            state, number = step[0], number + step[1]
        out.discard(-1)
        return out


class Matcher:
    """Near words among ``entries`` (word -> count), on one side."""

    def __init__(self, entries: dict[str, int], backward: bool):
        turned = sorted((w[::-1] if backward else w) for w in entries)
        self.backward, self.automaton = backward, Automaton(turned)
        self.names = [w[::-1] for w in turned] if backward else turned
        self.counts = [entries[w] for w in self.names]

    def ask(self, words: list[str]) -> pd.DataFrame:
        """(word, n_near, best, best_n): the number of a word's near ones, and the one of the largest
        count, then the smallest; only words that have one."""
        names, counts, rows = self.names, self.counts, []
        for w in words:
            half = len(w) // 2
            found = self.automaton.near(w[::-1], len(w) - half) if self.backward else self.automaton.near(w, half)
            head = w[:half]
            own = [(-counts[i], names[i]) for i in found if names[i] != w and not (self.backward and names[i].startswith(head))]
            if own:
                n, best = min(own)
                rows.append((w, len(own), best, -n))
        return pd.DataFrame(rows, columns=["word", "n_near", "best", "best_n"])


def runs(text: str = "text", least: int = 1, letters: str = LETTERS) -> Column:
    """A text's maximal runs of letters of at least ``least`` code points, A-Z lower-cased: an array."""
    return F.regexp_extract_all(F.translate(F.col(f"`{text}`"), UPPER, LOWER), F.lit(f"[{letters}]{{{least},}}"), F.lit(0))


def lexicon(words: DataFrame, least: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n) from a one-column frame of words."""
    word = words.select(F.col(f"`{words.columns[0]}`").alias("word")).where(F.length("word") >= least)
    return word.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _dealt(scratch: Scratch, lex: DataFrame, block: int) -> DataFrame:
    """A row for each place (side, key, part) where a word is held, or asks; a place of a divided key
    stands alone."""
    rows = lex.select("word", "n", F.length("word").alias("size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    # an asker of size s keeps s // 2 at the start, or s - s // 2 at the end
    keeps = [F.when(F.col("side") == 0, F.floor((F.col("size") + j) / 2)).otherwise(F.ceil((F.col("size") + j) / 2)).cast("int") for j in (-1, 0, 1)]
    rows = rows.withColumn("keep", F.explode(F.array_distinct(F.array(*keeps)))).where("keep between 1 and size")
    asks = F.col("keep") == keeps[1]
    key = F.when(F.col("side") == 0, F.expr("substring(word, 1, keep)")).otherwise(F.expr("right(word, keep)"))
    rows = scratch.save(rows.select("word", "n", "side", key.alias("key"), asks.alias("asks")))
    many = rows.groupBy("side", "key").agg(F.count("*").alias("m")).where(F.col("m") > block)
    parts = scratch.save(many.select("side", "key", F.ceil(F.col("m") / block).cast("int").alias("parts")))
    rows = rows.join(parts, ["side", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = rows.select("word", "n", "side", "key", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), (F.col("parts") > 1).alias("alone"), F.lit(True).alias("entry"), (F.col("asks") & (F.col("parts") == 1)).alias("asks"))
    asking = rows.where("asks and parts > 1").select("word", "n", "side", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("alone"), F.lit(False).alias("entry"), F.lit(True).alias("asks"))
    return held.union(asking)


def near_words(scratch: Scratch, lex: DataFrame, block: int = 20_000) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have near ones."""
    place = ["side", "key", "part"]
    dealt = _dealt(scratch, lex, block).repartition(*place).sortWithinPartitions(*place, F.desc("entry"))

    def run(frames):
        """Whole places are gathered until they hold ``block`` words: few automata, of bounded size.
        In a place that stands alone, those who ask follow all its words and are answered in turn."""
        last, entries, askers, matcher = None, {}, [], None
        for pdf in frames:
            cols = [pdf[c].tolist() for c in ("word", "n", "side", "key", "part", "alone", "entry", "asks")]
            for word, n, side, key, part, alone, entry, asks in zip(*cols, strict=True):
                here = (side, key, part, alone)
                if here != last:
                    if last and (alone or last[3] or side != last[0] or len(entries) >= block):
                        if askers:
                            yield (matcher or Matcher(entries, last[0] == 1)).ask(askers)
                        entries, askers, matcher = {}, [], None
                    last = here
                if entry:
                    entries[word] = n
                if asks:
                    askers.append(word)
                    if alone and len(askers) >= block:
                        matcher = matcher or Matcher(entries, side == 1)
                        yield matcher.ask(askers)
                        askers = []
        if askers:
            yield (matcher or Matcher(entries, last[0] == 1)).ask(askers)
        tidy()

    found = dealt.mapInPandas(run, "word string, n_near long, best string, best_n long")
    top = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select("word", "n_near", F.col("top.w").alias("best"), (-F.col("top.m")).alias("best_n"))


def variants(lex: DataFrame, ratio: int = 10, block: int = 20_000) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``lex`` (word, n).

    form: the near word of the largest count if that is at least ``ratio`` times the word's own;
    root: where the forms of forms end."""
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    scratch = Scratch(lex.sparkSession)
    lex = scratch.save(lex.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = scratch.save(near_words(scratch, lex.where(F.length("word") > 1), block))
    good = F.col("best_n") >= F.lit(ratio) * F.col("n")
    all_words = scratch.save(lex.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")))
    # pointer doubling: every round looks twice as far
    up = scratch.save(all_words.where("form is not null").select("word", F.col("form").alias("up")))
    while True:
        far = up.select(F.col("word").alias("up"), F.col("up").alias("next"))
        new = scratch.save(up.join(far, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            break
        up = new.select("word", "up")
    return all_words.join(up.withColumnRenamed("up", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
