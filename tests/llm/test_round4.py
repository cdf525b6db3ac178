"""Quality model, spelling variants and whitening against plain versions, and their defined cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_gam, queries, spelling, whitening

SF, WIDE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# whitening


def plain_whitening(vectors, k=8):
    x = np.array([np.floor(np.array(v, float) * 1024).astype(int) + 100_000 for v in vectors])
    n, total = len(x), x.sum(0)
    gap = n * x.astype(object) - total.astype(object)
    value, direction = np.linalg.eigh(np.cov(x.T, bias=True))
    return n, (gap**2).sum(1), value[::-1][:k], direction[:, ::-1][:, :k], (x - total / n) @ direction[:, ::-1][:, :k] / np.sqrt(value[::-1][:k]), value.sum()


def test_op13_is_the_plain_whitening(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{WIDE}/embeddings.parquet").collect()]
    n, deviation, value, _, white, trace = plain_whitening([v for _, v in rows])
    at = {i: k for k, (i, _) in enumerate(rows)}
    out = queries.op13_whitening(spark, WIDE).collect()
    assert len(out) == 8 * len(rows) and {r.component for r in out} == set(range(1, 9))
    got = np.zeros((len(rows), 8))
    for r in out:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[at[r.vec_id]] and r.identity_error < 1e-9
        assert abs(r.explained - value[r.component - 1] / trace) < 1e-9
    signs = np.sign((got * white).sum(0))
    assert np.allclose(got * signs, white, atol=1e-7)


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(40)
    x = rng.integers(99_000, 101_000, (300, 5))
    want = np.cov(x.T, bias=True)
    for cuts in ([1], [1, 2, 3], [100, 101, 250]):
        parts = [whitening.Moments.of(p) for p in np.split(x, cuts)]
        rng.shuffle(parts)
        state = None
        for p in parts:
            state = whitening.merged(state, p)
        assert state.n == 300 and state.total == x.sum(0).tolist() and np.allclose(state.scatter / 300, want, rtol=1e-12)


def test_vectors_that_do_not_count(spark):
    rng = np.random.default_rng(41)
    fine = [(i, rng.standard_normal(3).tolist()) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    same = [(None, fine[0][1]), (0, fine[0][1])]
    d = spark.createDataFrame(fine + odd + same, "vec_id long, embedding array<double>").withColumns({"k": F.lit(1), "v": F.lit("x"), "whitened": F.lit(2), "deviation": F.lit(3)})
    model = whitening.fit(d.repartition(7), components=2)
    out = whitening.whiten(d, model).collect()
    n, deviation, *_ = plain_whitening([v for _, v in fine] + [v for _, v in same])
    assert model.n == n == 42 and sorted((r.vec_id is None, r.vec_id) for r in out if r.vec_id is not None)[:3] == [(False, 0), (False, 0), (False, 1)] and len(out) == 42
    assert {int(r.deviation) for r in out} == set(deviation.tolist())
    for some in (d.limit(0), d.where("vec_id = 100"), d.where("vec_id = 5"), spark.createDataFrame([(1, [2.0, 3.0])] * 5, "vec_id long, embedding array<double>")):
        assert whitening.whiten(some, whitening.fit(some)).count() == 0
    # no variance along one axis, and numbers whose squares leave 64 bits
    flat = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {len(r.whitened) for r in whitening.whiten(flat, whitening.fit(flat)).collect()} == {1}
    wide = [(i, [float(i) * 1e9, -float(i)]) for i in range(9)]
    big = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
    want = plain_whitening([v for _, v in wide])[1].tolist()
    assert [int(r.deviation) for r in whitening.whiten(big, whitening.fit(big)).orderBy("vec_id").collect()] == want


# spelling


def plain_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(lex, ratio=10):
    near = {w: [v for v in lex if plain_near(w, v)] for w in lex}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-lex[v], v), default=None)
        form[w] = best if best is not None and lex[best] >= ratio * lex[w] else None
    out = {}
    for w in lex:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (lex[w], len(near[w]), form[w], lex.get(form[w]), root)
    return out


def test_automaton_numbers_and_near_words():
    rng = random.Random(42)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(2, 9))) for _ in range(900)})
    a = spelling.Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words))) and a.number("zz") == -1
    plain = {p for w in words for p in [w[:i] for i in range(len(w) + 1)]}
    assert len(a.edges) < len(plain) / 2 and len({(f, *sorted(e.items())) for f, e in zip(a.final, a.edges, strict=True)}) == len(a.edges)
    for w in words[::7] + ["abcabca"]:
        half = len(w) // 2
        want = {i for i, v in enumerate(words) if v[:half] == w[:half] and plain_near(w, v)}
        assert {i for i in a.near(w, half) if words[i] != w} == want
    assert spelling.Automaton([]).near("abc", 1) == set() and spelling.Automaton([""]).number("") == 0


@pytest.mark.parametrize("block", [3, 40, 20_000])
def test_variants_in_any_block(spark, block):
    rng = random.Random(43)
    lex = {"aaaa" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 5))): rng.choice([1, 2, 30, 400, 5000]) for _ in range(150)}
    lex |= {"".join(rng.choice("ab") for _ in range(rng.randint(2, 4))) + "zzzz": rng.choice([1, 20, 300]) for _ in range(20)}
    lex |= {"ñandúes": 5, "ñandues": 50, "xñandues": 600, "x" * 3000: 2, "x" * 3001: 40}
    d = spark.createDataFrame(list(lex.items()), "word string, n long").withColumn("side", F.lit(9))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(d, block=block).collect()}
    assert got == plain_variants(lex) and any(v[4] != v[2] for v in got.values() if v[2])


def test_lexicon_cases(spark):
    d = spark.createDataFrame([("abcdefg", 3), ("abcdefg", 2), (None, 4), ("abcdefx", None), ("abcdefh", 50)], "word string, n long")
    assert {(r.word, r.n, r.n_near, r.form, r.root) for r in spelling.variants(d).collect()} == {("abcdefg", 5, 1, "abcdefh", "abcdefh"), ("abcdefh", 50, 1, None, "abcdefh")}
    assert spelling.variants(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(d, ratio=1)
    t = spark.createDataFrame([(None,), ("",), ("Ab ÀBÉ×x1cd",)], "text string")
    assert [r.w for r in t.select(F.explode(spelling.runs()).alias("w")).collect()] == ["ab", "ÀbÉ×x", "cd"]


def test_op12_over_the_table(spark):
    n = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    lex = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in queries.op12_spelling_variants(spark, SF).collect()} == plain_variants(lex)


# quality


def test_op11_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{WIDE}/labels.parquet").collect()}
    rows = queries.op11_quality_gam(spark, WIDE).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 70 and np.mean([p == y for p, y in held]) > 0.93


def test_tables_learn_a_crossing():
    """Labels that no single feature tells, but a pair does."""
    rng = np.random.default_rng(44)
    x = rng.random((1500, 4))
    x[::50, 3] = np.nan
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality_gam.fit(x[:1000], y[:1000])
    assert (model.pairs[0][0], model.pairs[0][1]) == (0, 1)
    assert np.mean((model.score(x[1000:]) >= 0.5) == y[1000:]) > 0.9
    z = (x[:, 2] + 0.1 * rng.standard_normal(1500) > 0.3).astype(int)
    assert np.mean((quality_gam.fit(x[:1000], z[:1000]).score(x[1000:]) >= 0.5) == z[1000:]) > 0.88


def test_scores_are_sums_over_bins():
    rng = np.random.default_rng(45)
    x = rng.random((400, 3))
    model = quality_gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.7).astype(int))
    for row in x[:20]:
        s = model.base + sum(t[1 + int((e <= v).sum())] for v, e, t in zip(row, model.edges, model.tables, strict=True))
        at = [1 + int((e <= v).sum()) for v, e in zip(row, model.coarse, strict=True)]
        s += sum(t[at[i], at[j]] for i, j, t in model.pairs)
        assert abs(model.score(row[None])[0] - 1 / (1 + np.exp(-s))) < 1e-12


def test_features_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(46)
    text = "\n".join(" ".join(rng.choice(["alpha", "Beta", "###", "7", "the"]) for _ in range(30)) + "." for _ in range(60))
    whole = quality_gam.features_of(text)
    monkeypatch.setattr(quality_gam, "PIECE", 1024)
    parts = quality_gam.features_of(text)
    for name, a, b in zip(quality_gam.NAMES, whole, parts, strict=True):
        assert abs(a - b) < (0.2 if "worst" in name or name in ("repeated_lines", "line_words", "distinct_triples") else 0.02), name
    assert len(quality_gam.features_of("x" * 3_000_000)) == len(quality_gam.NAMES)


def test_quality_cases(spark):
    d = spark.createDataFrame([(1, "One fine text."), (2, None), (3, ""), (None, "### ***"), (1, "again")], "doc_id long, text string").withColumns({"quality": F.lit("x"), "t": F.lit(1), "y": F.lit(2)})
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.quality for r in quality_gam.score(d, quality_gam.train(d, none)).collect()} == {0.5}
    few = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, 7)], "doc_id long, quality int")
    got = quality_gam.score(d, quality_gam.train(d, few)).collect()
    assert len(got) == 5 and len({r.quality for r in got}) == 1 and set(got[0].asDict()) == {"doc_id", "text", "quality", "t", "y"}
    many = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "### ### ### &&& %%%").otherwise("Plain words stand here in a row.").alias("text"))
    marks = many.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("quality"))
    model = quality_gam.train(many, marks)
    got = quality_gam.score(many, model).collect()  # texts of equal features count once: too few to learn from
    assert len(got) == 200
    assert quality_gam.score(d.limit(0), model).count() == 0


# mends


def test_hosts_of_any_length():
    """Suffixes that no stored host can equal are not made."""
    import time

    from tessera.llm import urlfilter

    d, e, s = urlfilter.build(urlfilter.RULES)
    table = urlfilter.Table(np.frombuffer(d, np.uint64), np.frombuffer(e, np.int64), np.frombuffer(s, np.uint8), [1, 4, 5], max(len(h) for _, h, _ in urlfilter.RULES))
    long = "a." * 500_000
    urls = [f"http://{long}example.org/es/x", f"http://{long}org/q", "http://example.org/es/x", "http://x.com/fr/", "http://" + "z" * 1_000_000 + "/fr/", "http://.com/de/1", "http://example.org./es/"]
    began = time.perf_counter()
    got = table.judge(urls, "allow")
    assert time.perf_counter() - began < 1
    assert got["rule"].tolist() == ["example.org/es/", "org/", "example.org/es/", "com/fr/", None, "com/de/", None]
    assert got["verdict"].tolist() == ["block", "allow", "block", "allow", "allow", "block", "allow"]


def test_unlisted_notice_beside_a_known_one():
    from tessera.llm import licenses

    from .test_llm import ALPHABETS, sentence

    rng = random.Random(47)
    model = licenses.fit([sentence(k, rng, 25) for k in ALPHABETS for _ in range(40)])
    body = sentence("en", rng, 40)
    for other in ("Copyright (c) 2020 Acme Corp", "Licensed under the Foo Commercial License, version 9"):
        assert [f for f, _, _ in model.scan(f"{other}\n{body}")] == ["unknown"]
        assert [f for f, _, _ in model.scan(f"{other}\n{body}\nReleased under the MIT License.\n{body}")] == ["MIT", "unknown"]
    assert [f for f, _, _ in model.scan(f"{body}\nCopyright (c) 2020 Acme Corp\nReleased under the MIT License.\n{body}")] == ["MIT"]


def test_added_addresses_of_any_length():
    from tessera.llm import pii

    for s in ("a(at)b(dot)c", "a @ b.c", "a@b . c", "x" * 300 + "(at)mail(dot)org", "x" * 300_000 + "@" + "y" * 300_000 + ".z", "a@b@c.d"):
        assert pii.plausible(0, s), s[:40]
    for s in ("@b.c", "a@b", "a b@c.d", "a@.c", "a@b.", "1@2.3", "a@b c.d", "@" * 100_000 + "a", "a" + "@" * 100_000):
        assert not pii.plausible(0, s), s[:40]


def test_every_candidate_checked_without_a_bound(spark):
    """Near duplicates with the signature bound off, against exact groups."""
    from tessera.llm import minhash

    from .test_llm import brute_groups

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    _, root = brute_groups(texts, 2, 80)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in minhash.near_duplicates(d, k=2, deviations=float("inf")).collect()}
    assert [got[i] for i in range(len(texts))] == root
